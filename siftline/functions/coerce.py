"""Typed reads from VARIANT records whose fields change type between rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import strip_or_null

_SCALAR = r"\A(STRING|BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def kind(variant: Column) -> Column:
    """The variant's type name; null for a missing field."""
    return F.schema_of_variant(variant)


def at(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def is_object(variant: Column) -> Column:
    return F.coalesce(kind(variant).startswith("OBJECT"), F.lit(False))


def is_array(variant: Column) -> Column:
    return F.coalesce(kind(variant).startswith("ARRAY"), F.lit(False))


def as_text(variant: Column, path: str = "$") -> Column:
    """A scalar as stripped text. Booleans, nulls, lists and objects give null."""
    scalar = F.coalesce(kind(at(variant, path)).rlike(_SCALAR), F.lit(False))
    return F.when(scalar, strip_or_null(F.try_variant_get(variant, path, "string")))


def as_tags(variant: Column, path: str = "$") -> Column:
    """A list's scalars as text; an empty array for anything that is no list."""
    items = F.try_variant_get(variant, path, "array<variant>")
    texts = F.filter(F.transform(items, lambda item: as_text(item)), lambda t: t.isNotNull())
    return F.when(is_array(at(variant, path)), texts).otherwise(F.array().cast("array<string>"))


def as_epoch_millis(variant: Column, path: str) -> Column:
    """A numeric millisecond epoch as a timestamp; text is not accepted."""
    number = F.coalesce(kind(at(variant, path)).rlike(r"\A(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    millis = F.try_variant_get(variant, path, "double")
    in_range = millis.between(-62135596800000.0, 253402300799000.0)
    return F.when(number & in_range, F.timestamp_micros((millis * 1000).cast("bigint")))
