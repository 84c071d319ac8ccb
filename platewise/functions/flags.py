"""Three-valued dietary flags: true, false, null, and missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(flags, key: str) -> Column:
    """struct(present, value): a missing key is not a null value."""
    f = F.col(flags) if isinstance(flags, str) else flags
    return F.struct(F.coalesce(F.map_contains_key(f, key), F.lit(False)).alias("present"), F.try_element_at(f, F.lit(key)).alias("value"))


def value(flags, key: str) -> Column:
    f = F.col(flags) if isinstance(flags, str) else flags
    return F.try_element_at(f, F.lit(key))


def overlaps(arr, values: list[str]) -> Column:
    """Case-insensitive overlap of an array column with given values."""
    a = F.col(arr) if isinstance(arr, str) else arr
    low = F.transform(a, lambda x: F.lower(x))
    return F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")), F.lit(False))


def arrays_union(*arrs) -> Column:
    """Distinct values of several array columns in the order they come; null arrays count as empty."""
    cols = [F.coalesce(F.col(a) if isinstance(a, str) else a, F.array().cast("array<string>")) for a in arrs]
    return F.array_distinct(F.flatten(F.array(*cols)))


def arrays_join(arr, sep: str = ", ") -> Column:
    """Non-null values joined; "" for none."""
    return F.coalesce(F.array_join(F.col(arr) if isinstance(arr, str) else arr, sep), F.lit(""))


def arrays_first(arr, default=None) -> Column:
    """The first value, or the default of an empty or null array."""
    return F.coalesce(F.try_element_at(F.col(arr) if isinstance(arr, str) else arr, F.lit(1)), F.lit(default))
