"""Proportional stratified interleaving of documents into shards (DataFrame functions only).

Rows are shuffled within each source by a seeded hash; a row of rank r among the n rows of its
source stands at (r - 1/2) / n.  Sorted by that place, every stretch of rows has the sources in
their proportions, so equal cuts give shards that match the mixture; their counts differ by one
at most.

Ranks are counted without sorting a source, or the table, in one task: rows are counted by a
prefix of their hash (or place), the counts are summed up, and only the rows of one prefix are
ranked together.  The hash is of doc_id and text, so rows without a doc_id are spread by their
texts, and rows alike in both are counted, ranked as one and dealt out again in parts.

Defined results: a null source is a stratum of its own; a null text counts as empty; a null
doc_id is shuffled like any value; repeated rows take neighbouring places; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm._shared import Workspace

#: Cells that the hash range of a source (by HEX digits), and the range of places, is counted in.
HEX = 3
CELLS = 16**HEX
#: Repeated rows that one task deals out.
PART = 1 << 16


def shard(
    docs: DataFrame,
    shards: int = 40,
    seed: str = "shuffle-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Returns doc_id, source, size (UTF-8 bytes + 16), text_crc32, place, shard and slot."""
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("_s"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    seeded = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.col("text_crc32"))
    rows = rows.withColumn("_h", F.md5(seeded.cast("binary")))
    alike = ["doc_id", "source", "_s", "size", "text_crc32", "_h"]
    rows = rows.groupBy(*alike).agg(F.count("*").alias("_n")).withColumn("_cell", F.substring("_h", 1, HEX))
    rows = ws.save(rows, "rows")

    by_source = Window.partitionBy("_s")
    before = by_source.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("_s", "_cell")
        .agg(F.sum("_n").alias("_n"))
        .select(
            "_s",
            "_cell",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(by_source).alias("_of"),
        )
    )
    in_cell = Window.partitionBy("_s", "_cell").orderBy("_h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(cells, ["_s", "_cell"]).withColumn(
        "_before", F.col("_before") + F.coalesce(F.sum("_n").over(in_cell), F.lit(0))
    )
    ranked = ws.save(ranked, "ranked")
    placed = ranked.filter("_n = 1").withColumn("_rank", F.col("_before") + 1)
    # Repeated rows are dealt out again by parts, which are spread over the tasks.
    parts = ranked.filter("_n > 1").withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / PART))))
    parts = parts.repartition("_h", "_part")
    last = F.least(F.col("_n"), (F.col("_part") + 1) * PART)
    parts = parts.withColumn("_rank", F.explode(F.sequence(F.col("_before") + F.col("_part") * PART + 1, F.col("_before") + last)))
    placed = placed.unionByName(parts.drop("_part"))
    placed = placed.withColumn("place", (F.col("_rank") - F.lit(0.5)) / F.col("_of"))
    placed = placed.withColumn("_cut", F.floor(F.col("place") * CELLS).cast("int")).drop("_before", "_of", "_cell", "_n")
    placed = ws.save(placed, "placed")

    # One row for each of CELLS cuts: small whatever the input, so one task and a broadcast will do.
    whole = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        placed.groupBy("_cut")
        .agg(F.count("*").alias("_n"))
        .select(
            "_cut",
            F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"),
        )
    )
    in_cut = Window.partitionBy("_cut").orderBy("place", "_s")  # a source has each place once
    k, n = F.col("_at") * shards, F.col("_all")
    return (
        placed.join(F.broadcast(cuts), "_cut")
        .withColumn("_at", F.col("_before") + F.row_number().over(in_cut) - 1)
        .withColumn("_shard", ((k - k % n) / n).cast("long"))
        .withColumn("_first", ((F.col("_shard") * n + (shards - 1)) / F.lit(shards)))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            "place",
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_at") - F.floor("_first").cast("long")).cast("long").alias("slot"),
        )
    )


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
