"""Line dedup against levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without \\x20 and \\x09-\\x0D at its ends, A-Z in lower case.  Keys of at
least ``min_chars`` code points that ``min_docs`` documents or more hold lose all their lines,
except in the largest doc_id that holds them.  Other lines stay.

1. Documents that hold a key are counted, and only lines of keys at the limit go on.
2. These come in batches, the largest doc_ids first.  Each batch's keys are merge-anti-joined with
   the runs: those that no run holds are met for the first time, so the batch has their largest
   doc_id, and they become the batch's own run.
3. Lines that are anti-joined with the runs, by key and doc_id, go: another document keeps the key.

A run is a table of (key hash, largest doc_id), bucketed and sorted by hash, so that its side of a
merge needs no exchange.  A batch adds one run at level 0; ``fan`` runs of a level are merged into
one of the next, so n batches leave about fan * log(n) runs and each row is rewritten log(n) times.
``keep_new`` is the one-way form, in which each new batch keeps what no run before it holds.

Keys with a large share of all lines are joined by broadcast (there are at most HEAVY of them), and
a key's lines are summed up before they move, so no key fills a task.

Defined results: a null or empty text is one empty line; a null doc_id counts as one document,
smaller than any other; repeated rows of a doc_id are one document; no rows give no rows; other
columns are passed through by ``dedup``.  Key hashes have 128 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import HEAVY, Workspace, delete, even_join

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def _text(text_col: str):
    return F.coalesce(F.col(text_col), F.lit(""))


def _key_hash(col):
    return F.xxhash64(F.lit(11), col), F.xxhash64(F.lit(23), col)


def line_keys(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line whose key is long enough: _id, _t1, _t2 (text's hash), _pos, _h1, _h2."""
    t1, t2 = _key_hash(F.col("_text"))
    lines = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), _text(text_col).alias("_text"))
    lines = lines.select("_id", t1.alias("_t1"), t2.alias("_t2"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    key = F.translate(F.btrim(F.col("_line"), F.lit(STRIPPED)), UPPER, LOWER)
    lines = lines.select("_id", "_t1", "_t2", "_pos", key.alias("_key")).filter(F.length("_key") >= min_chars)
    h1, h2 = _key_hash(F.col("_key"))
    return lines.select("_id", "_t1", "_t2", "_pos", h1.alias("_h1"), h2.alias("_h2"))


KEY = ["_h1", "_h2"]


class LineRuns:
    """The levels of sorted runs.  ``levels[i]`` holds at most ``fan - 1`` runs between calls."""

    def __init__(self, spark: SparkSession, ws: Workspace, fan: int = 4, buckets: int | None = None):
        self.spark, self.ws, self.fan = spark, ws, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def without(self, rows: DataFrame, kept: bool = False) -> DataFrame:
        """Rows whose key no run holds; or, if ``kept``, rows but those of the keepers.  A merge with
        each run, for which the rows are moved and sorted once."""
        for run in self.runs():
            run = run.select(*[F.col(k).alias(f"_run{k}") for k in KEY], "keeper").hint("merge")
            same = (F.col("_h1") == F.col("_run_h1")) & (F.col("_h2") == F.col("_run_h2"))
            rows = rows.join(run, same & (F.col("_id") >= F.col("keeper")) if kept else same, "left_anti")
        return rows

    def add(self, keys: DataFrame) -> None:
        """Add a run of (key, keeper), whose keys no run holds."""
        self._put(keys, 0)

    def _put(self, rows: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        name, path = f"tessera_run_{uuid.uuid4().hex}", self.ws.path(f"run-{level}")
        rows = rows.select(*KEY, "keeper").repartition(self.buckets, *KEY)
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.paths[name] = path
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            self._put(self._together(old), level + 1)
            self._drop(old)

    def _together(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for x in names[1:]:
            rows = rows.unionByName(self.spark.table(x))
        return rows

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE {x}")
            delete(self.spark, self.paths.pop(x))

    def close(self) -> None:
        """Delete all runs."""
        self._drop([x for level in self.levels for x in level])
        self.levels = []

    def keepers(self) -> DataFrame:
        """All runs: (key, keeper), each key once."""
        names = [x for level in self.levels for x in level]
        return self._together(names)


def _batches(lines: DataFrame, batches: int) -> list:
    """Conditions that deal out lines by _id, the largest first, in parts of about equal size."""
    share = [k / batches for k in range(batches - 1, 0, -1)]
    bounds = lines.agg(F.percentile_approx("_id", share, 1000).alias("b")).first()["b"] if share else []
    bounds = sorted(set(bounds or []), reverse=True)
    out, above = [], None
    for b in bounds:
        out.append(F.col("_id") > b if above is None else (F.col("_id") > b) & (F.col("_id") <= above))
        above = b
    return [*out, F.lit(True) if above is None else F.col("_id") <= above]


def dropped_lines(
    docs: DataFrame, min_docs: int, min_chars: int, batches: int, id_col: str, text_col: str, ws: Workspace
) -> DataFrame:
    """_id, _t1, _t2 of the texts that lose lines, and the array _gone of their positions."""
    lines = ws.save(line_keys(docs, min_chars, id_col, text_col), "lines")
    # Twice: a key's lines are first summed by document, then by key, each time before they move.
    held = lines.groupBy(*KEY, "_id").agg(F.count("*").alias("_n"))
    counts = held.groupBy(*KEY).agg(F.count("*").alias("_docs"), F.sum("_n").alias("_n"))
    often = ws.save(counts.filter(F.col("_docs") >= min_docs).select(*KEY, "_n"), "often")
    total = lines.count()
    lines = ws.save(even_join(lines, often, KEY, "_n", total), "repeated")

    runs = LineRuns(docs.sparkSession, ws)
    try:
        for part in _batches(lines, batches):
            # Written, as Catalyst would move the anti-join below the sum, and a key's lines into one task.
            keys = ws.save(lines.filter(part).groupBy(*KEY).agg(F.max("_id").alias("_id")), "keys")
            runs.add(runs.without(keys).withColumnRenamed("_id", "keeper"))
            ws.drop(keys)
        is_heavy = F.col("_n") * F.lit(HEAVY) >= F.lit(max(total, 1))
        heavy = F.broadcast(often.filter(is_heavy).select(*KEY))
        hot = runs.keepers().join(heavy, KEY, "left_semi").withColumnRenamed("keeper", "_id")  # at most HEAVY rows
        gone = lines.filter(is_heavy).join(F.broadcast(hot), [*KEY, "_id"], "left_anti")
        gone = gone.unionByName(runs.without(lines.filter(~is_heavy), kept=True))
        return ws.save(gone.groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_gone")), "gone")
    finally:
        runs.close()


def dedup(
    docs: DataFrame,
    min_docs: int = 5,
    min_chars: int = 40,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of docs with the text's remaining lines, n_lines (before) and n_dropped (these two
    replace columns of their names)."""
    ws = Workspace(docs.sparkSession, "lines")
    gone = dropped_lines(docs, min_docs, min_chars, batches, id_col, text_col, ws)
    t1, t2 = _key_hash(_text(text_col))
    # Names that a column of docs won't have.
    own = {"_id": "_tsr_id", "_t1": "_tsr_t1", "_t2": "_tsr_t2"}
    rows = docs.withColumns(
        {"_tsr_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_tsr_t1": t1, "_tsr_t2": t2}
    )
    gone = gone.withColumnsRenamed(own | {"_gone": "_tsr_gone"})
    # The few texts that lose lines are the build side; whole texts are moved once and never sorted.
    rows = rows.join(gone.hint("shuffle_hash"), list(own.values()), "left")
    rows = rows.withColumn("_tsr_lines", F.split(_text(text_col), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_tsr_lines") - 1), F.col("_tsr_gone"))
    none = F.col("_tsr_gone").isNull()
    text = F.when(none, F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at("_tsr_lines", i + 1)), "\n")
    )
    rows = rows.withColumns(
        {
            "n_lines": F.size("_tsr_lines").cast("long"),
            "n_dropped": F.when(none, F.lit(0)).otherwise(F.size("_tsr_gone")).cast("long"),
            text_col: text,
        }
    )
    return rows.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def keep_new(runs: LineRuns, batch: DataFrame, min_chars: int = 40) -> DataFrame:
    """Lines (by _id, _t1, _t2, _pos) of a new batch whose key no run holds; the batch's keys are
    its run afterwards."""
    lines = runs.ws.save(line_keys(batch, min_chars), "batch")
    kept = runs.ws.save(runs.without(lines), "kept")
    runs.add(kept.groupBy(*KEY).agg(F.max("_id").alias("keeper")))
    return kept


def digest(deduped: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
