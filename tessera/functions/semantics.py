"""Column helpers where the engine's meaning differs from Spark's default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """True division; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null where b is zero."""
    m = F.try_mod(a, b)
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def to_bool(text: Column) -> Column:
    """True for TRUE, 1 and YES in any case, false for other texts, null for null."""
    return F.upper(text).isin("TRUE", "1", "YES")


def ascending(c: Column) -> Column:
    return c.asc_nulls_last()


def descending(c: Column) -> Column:
    return c.desc_nulls_last()
