"""A change log as a DataFrame: (lsn, xid, type, table_name, row_id, old_json, new_json, ts), and as a folder."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "lsn long, xid long, type string, table_name string, row_id long, old_json string, new_json string, ts timestamp"
CHANGES = ("INSERT", "UPDATE", "DELETE")


def _with_end(log: DataFrame) -> DataFrame:
    """Changes with _end, how their transaction ended: by its first COMMIT or ABORT after the change
    (an xid may be used again), null if by none."""
    ends = log.filter(F.col("type").isin("COMMIT", "ABORT")).groupBy("xid")
    ends = ends.agg(F.sort_array(F.collect_list(F.struct("lsn", "type"))).alias("_ends"))
    after = F.filter("_ends", lambda e: e["lsn"] > F.col("lsn"))
    changes = log.filter(F.col("type").isin(*CHANGES)).join(ends, "xid", "left")
    return changes.withColumn("_end", F.get(after, 0)["type"]).drop("_ends")


def committed(log: DataFrame) -> DataFrame:
    """Changes whose transaction committed after them."""
    return _with_end(log).filter("_end = 'COMMIT'").drop("_end")


def replay(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The rows that redo of the committed changes leaves: table_name, row_id, new_json.

    The latest change of each row wins, taken by a partial maximum rather than a sort of its history.
    """
    return _latest(committed(log if upto is None else log.filter(F.col("lsn") <= upto))).drop("lsn")


def _latest(changes: DataFrame) -> DataFrame:
    last = changes.groupBy("table_name", "row_id").agg(
        F.max_by("type", "lsn").alias("type"), F.max_by("new_json", "lsn").alias("new_json"), F.max("lsn").alias("lsn")
    )
    return last.filter(F.col("type") != "DELETE").drop("type")


def losers(log: DataFrame) -> DataFrame:
    """Changes to undo, the latest first: of transactions that neither committed nor aborted afterwards."""
    return _with_end(log).filter("_end IS NULL").drop("_end").orderBy(F.desc("lsn"))


def undo(log: DataFrame) -> DataFrame:
    """The rows as they were before the losers' changes: table_name, row_id, old_json (null: no row)."""
    return losers(log).groupBy("table_name", "row_id").agg(F.min_by("old_json", "lsn").alias("old_json"))


def since_checkpoint(log: DataFrame) -> DataFrame:
    last = log.filter(F.col("type") == "CHECKPOINT").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("_from"))
    return log.crossJoin(F.broadcast(last)).filter(F.col("lsn") > F.col("_from")).drop("_from")  # one row


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("type").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def numbered(rows: DataFrame, path: str, name: str, first: int) -> DataFrame:
    """``rows``, written to ``path``, with a dense number from ``first`` on: of tasks in their order, and rows in theirs."""
    rows.select(F.monotonically_increasing_id().alias("_at"), *rows.columns).write.parquet(path)
    written = rows.sparkSession.read.parquet(path).withColumn("_p", F.shiftright("_at", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each task
    parts = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_p"), 33)
    out = written.join(F.broadcast(parts), "_p")
    return out.withColumn(name, F.lit(first) + F.col("_before") + inside).select(name, *rows.columns)


@dataclass
class Recovery:
    """``rows``: what the committed changes leave (table_name, row_id, new_json); ``undone``: rows as they were before
    changes that never committed; the last record's number, and how many records were left out as damaged."""

    rows: DataFrame
    undone: DataFrame
    last_lsn: int
    n_damaged: int


class ChangeLog:
    """A log that grows by segments, each a Parquet folder that is never changed.

    A record carries the CRC-32 of its fields, and a segment counts once its _SUCCESS is there, so a
    torn write is no part of the log.  A transaction's changes are written before its COMMIT, which is
    what makes them count.  checkpoint() writes the rows as of then beside the log and lets
    segments go that neither they nor an open transaction need.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.lock = spark, folder.rstrip("/"), threading.RLock()
        last = self.read().agg(F.max("lsn")).first()[0] if self._segments() else None
        self.next_lsn = max(self._checkpoint(), -1 if last is None else last) + 1

    # Folders

    def _fs(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(sc._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        path, fs = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.folder))]
        names = [n for n in names if n.startswith(f"{kind}-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.split("-")[1]) for n in names)

    def _segments(self) -> list[int]:
        """First numbers of the segments."""
        return self._names("segment")

    def _checkpoint(self) -> int:
        """The number up to which the newest checkpoint reaches; -1 if there is none."""
        return max(self._names("rows"), default=-1)

    def _path(self, kind: str, lsn: int) -> str:
        return f"{self.folder}/{kind}-{lsn:020d}"

    def _delete(self, name: str) -> None:
        path, fs = self._fs()
        fs.delete(path(name), True)

    # Writing

    def write(self, xid: int, changes: DataFrame) -> int:
        """Append records (type, table_name, row_id, old_json, new_json) as a segment; returns how many."""
        with self.lock:
            first = self.next_lsn
            raw = f"{self.folder}/raw-{first:020d}"
            self._delete(raw)
            self._delete(self._path("segment", first))  # a torn one
            rows = numbered(changes.select("type", "table_name", "row_id", "old_json", "new_json"), raw, "lsn", first)
            rows = rows.withColumns({"xid": F.lit(xid).cast("long"), "ts": F.current_timestamp()})
            rows = rows.select(*[F.col(c) for c in _FIELDS]).withColumn("crc", _crc())
            rows.write.parquet(self._path("segment", first))
            n = self.spark.read.parquet(self._path("segment", first)).count()
            self._delete(raw)
            self.next_lsn = first + n
            return n

    def mark(self, xid: int, kind: str) -> None:
        """Append a BEGIN, COMMIT, ABORT or CHECKPOINT."""
        row = self.spark.createDataFrame([(kind, None, None, None, None)], "type string, table_name string, row_id long, old_json string, new_json string")
        self.write(xid, row.coalesce(1))

    def commit(self, xid: int, changes: list[DataFrame]) -> None:
        """Append a transaction's changes in the order of its statements, then its COMMIT."""
        with self.lock:
            for c in changes:
                self.write(xid, c)
            self.mark(xid, "COMMIT")

    # Reading

    def _all(self) -> DataFrame:
        paths = [self._path("segment", n) for n in self._segments()]
        if not paths:
            return self.spark.createDataFrame([], f"{SCHEMA}, crc long")
        return self.spark.read.schema(f"{SCHEMA}, crc long").parquet(*paths)

    def read(self) -> DataFrame:
        """The records, without damaged ones."""
        return self._all().filter(_crc() == F.col("crc")).drop("crc")

    def damaged(self) -> DataFrame:
        return self._all().filter(F.coalesce(_crc() != F.col("crc"), F.lit(True))).drop("crc")

    def uncommitted(self) -> DataFrame:
        """Changes of transactions that haven't ended, the latest first."""
        return losers(self.read())

    # Checkpoints and recovery

    def _rows(self) -> DataFrame:
        """The rows that the newest checkpoint and the committed changes of the log leave, with the number of their change."""
        changes = committed(self.read()).select("lsn", "type", "table_name", "row_id", "new_json")
        at = self._checkpoint()
        if at >= 0:
            saved = self.spark.read.parquet(self._path("rows", at)).withColumn("type", F.lit("INSERT"))
            changes = changes.unionByName(saved)
        return _latest(changes)

    def checkpoint(self) -> int:
        """Write the rows as of now, mark it, and drop what recovery doesn't need any more; returns the mark's number."""
        with self.lock:
            at, old = self.next_lsn, self._names("rows")
            self._delete(self._path("rows", at))
            self._rows().write.parquet(self._path("rows", at))
            self.mark(0, "CHECKPOINT")
            needed = self.uncommitted().agg(F.min("lsn")).first()[0]
            needed = at if needed is None else min(at, needed)
            segments = self._segments()
            for first, following in zip(segments, segments[1:]):
                if following <= needed:
                    self._delete(self._path("segment", first))
            for n in old:
                self._delete(self._path("rows", n))
            return at

    def recover(self) -> Recovery:
        return Recovery(self._rows().drop("lsn"), undo(self.read()), self.next_lsn - 1, self.damaged().count())


_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def _crc():
    """CRC-32 of a record's fields; null and empty differ."""
    return F.crc32(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in _FIELDS])).cast("binary"))
