"""Working out a costly column exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and field reads refer to by value.

    After a plain projection the planner may copy the expression into every
    filter above it, so that a row's patterns run again for each. The output of a
    generator is never copied; this one yields exactly one row per input row.
    """
    kept = [c for c in frame.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select(*kept, F.inline_outer(F.array(row)))
