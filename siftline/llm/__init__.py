"""Training-data operators: counting, scoring, filtering, near duplicates,
decontamination, archives and packing over document tables.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
