"""Table and column statistics, histograms and selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = 4096
#: Ranges that a histogram's distinct values are ranked in, and the values that they are found from.
RANGES, SAMPLE = 64, 4096


def columns(df: DataFrame) -> DataFrame:
    """One row for each column: distinct values, nulls, smallest and largest (as text); one scan."""
    text = lambda c: c.cast("string")
    figures = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_distinct(c).alias("n_distinct"),
            F.count_if(F.col(c).isNull()).alias("n_null"), text(F.min(c)).alias("low"), text(F.max(c)).alias("high"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*figures).alias("x")).select(F.inline("x"))


def table(df: DataFrame) -> DataFrame:
    """Rows, mean width and pages, at least one."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.avg(width).alias("width")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("n_rows") * F.coalesce("width", F.lit(0.0)) / PAGE)).cast("long")
    )


def histogram(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """Equi-depth buckets over the non-null values: low, high, rows and distinct values.

    Ranks are summed over the distinct values, so equal values stay together.  The distinct values are
    cut into ranges of about equal size, at values from a bounded sample (the smallest hashes); a range's
    offset is the sum of those before it, so no task ranks them all.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    sample = sorted(r.v for r in counts.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect())
    bounds = sample[:: max(1, len(sample) // RANGES)][1:]
    kind = counts.schema["v"].dataType
    ranges = sum((F.when(F.col("v") >= F.lit(b).cast(kind), 1).otherwise(0) for b in bounds), F.lit(0))
    counts = counts.withColumn("range", ranges)
    sums = counts.groupBy("range").agg(F.sum("n").alias("of_range"))  # a row for each range
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "range", F.coalesce(F.sum("of_range").over(before(Window.orderBy("range"))), F.lit(0)).alias("offset"),
        F.sum("of_range").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("range").orderBy("v"))), F.lit(0))
    ranked = counts.join(F.broadcast(offsets), "range").withColumn("before", F.col("offset") + inside)
    return (
        ranked.withColumn("bucket", F.floor(F.col("before") * buckets / F.col("total")).cast("int"))
        .groupBy("bucket")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"))
    )


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent non-null values; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def selectivity(
    op: str, value: float, low: float, high: float, n_distinct: int, common: dict | None = None, buckets: list[tuple] | None = None
) -> float:
    """Share of rows estimated to satisfy ``column op value``.

    Ranges are summed over a histogram's ``buckets`` (low, high, rows), linear within each; without one
    they are linear between ``low`` and ``high``.
    """
    if op == "=":
        return (common or {}).get(value, 1 / n_distinct if n_distinct else 0.1)
    buckets = buckets or ([(low, high, 1)] if high > low else [])
    if op in ("<", "<=", ">", ">=") and buckets:
        share = lambda a, b: min(1.0, max(0.0, (value - a) / (b - a))) if b > a else float(value > a or (value == a and op in ("<=", ">")))
        below = sum(n * share(a, b) for a, b, n in buckets) / sum(n for _, _, n in buckets)
        return below if op in ("<", "<=") else 1 - below
    return 0.1
