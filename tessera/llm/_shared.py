"""Shared plumbing: the shared folder, and joins that stay even when one key is hot."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HEAVY of all rows is heavy; so there are at most HEAVY such keys,
#: whatever the size of the input, and a table of them may be broadcast.
HEAVY = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir if the session names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = os.path.join(tempfile.gettempdir(), "tessera-shared")  # one process: tests and single machines
        spark.sparkContext.setCheckpointDir(base)
    return str(base).rstrip("/")


class Workspace:
    """Tables written to, and read again from, the shared folder.

    A written table cuts the lineage and outlives any executor.  Names are unique for each
    workspace, so runs never see each other's files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() returned, once nothing reads it any more."""
        delete(self.spark, df._tessera_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def even_join(big: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``lookup``, which has each key once and in ``n`` its rows in ``big``.

    Heavy keys (at most HEAVY of them, as each has total/HEAVY rows or more) are joined by
    broadcast and never shuffled; no other key can fill a task.
    """
    is_heavy = F.col(n) * F.lit(HEAVY) >= F.lit(max(total, 1))
    heavy, light = lookup.filter(is_heavy), lookup.filter(~is_heavy)
    rest = big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


#: Bytes of a batch that goes to Python, unless the session sets its own.
BATCH_BYTES = 8 << 20


def _ready(spark: SparkSession) -> None:
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on after its task, and idle ones add up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _tidied(batches: Iterator) -> Iterator:
    for batch in batches:
        yield batch
        del batch
        tidy()
    tidy()


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package on the executors."""
    _ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(_tidied(batches))

    return df.mapInArrow(run, schema)


def text_udf(
    spark: SparkSession, function: Callable[[Iterator[pa.LargeStringArray]], pa.Array], kind: str, text: Column, limit: int = 2 << 20
) -> Column:
    """The column that ``function`` makes of a batch of whole texts (null: empty), which it gets in slices of about ``limit`` bytes.

    Only the text goes to Python and only the result comes back; other columns stay in the JVM.
    """
    _ready(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tessera.llm._words import slices, text_column

        for batch in _tidied(batches):
            yield function(text_column(p) for p in slices(pa.RecordBatch.from_arrays([batch], ["text"]), limit))

    return F.arrow_udf(run, kind)(text)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
