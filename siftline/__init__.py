"""Listing curation on Spark: DataFrame operators from landed feed payloads to
labelled, filtered, ranked and queryable listings.

Every operator is a plain function over DataFrames or Columns. Time (``now``)
and the user profile are always parameters; nothing reads the wall clock.
"""

__version__ = "0.1.0"
