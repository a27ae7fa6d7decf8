from __future__ import annotations

import corpus_pipeline
from siftline.llm import decontamination, simhash
from siftline.llm.queries import table
from siftline.llm.storage import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF))
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.collect()}
        gone = set(before) - ids
        assert ids <= set(before)
        if name == "near duplicates":
            groups = simhash.near_duplicates(docs).collect()
            assert ids == {r["component_id"] for r in groups}
        if name == "benchmark":
            items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
            assert {i for i in before if any(t in before[i] for t in items)} <= gone
            assert decontamination.contaminated(after, table(spark, SF, "benchmark")).count() == 0
        if name in ("toxicity", "quality"):
            bad = [i for i in gone if i in marks]
            wrong = [i for i in bad if (marks[i]["toxic"] == 0 if name == "toxicity" else marks[i]["quality"] == 1)]
            assert len(wrong) <= 0.2 * max(len(bad), 5)
        docs, before = after, {i: before[i] for i in ids}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_run_on_the_small_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
