"""Contract type from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: hints, most specific first ---
CONTRACT_HINTS = (
    ("internship", r"\b(?:intern|internship)\b"),
    ("contract", r"\b(?:contract|contractor|freelance|b2b|consulting)\b"),
    ("part_time", r"\bpart[\s-]?time\b"),
    ("full_time", r"\bfull[\s-]?time\b"),
)
# --- End of fixed values ------------------------


def parse_contract_type(*values: Column) -> Column:
    haystack = F.concat_ws(" ", *[F.nullif(v, F.lit("")) for v in values])
    result = None
    for kind, hint in CONTRACT_HINTS:
        hit = haystack.rlike("(?iU)" + hint)
        result = F.when(hit, F.lit(kind)) if result is None else result.when(hit, F.lit(kind))
    return result.otherwise(F.lit("unknown"))
