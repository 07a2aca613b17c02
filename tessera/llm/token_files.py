"""Token ids in compact binary files with a shared zstandard dictionary.

A file holds documents in ascending doc_id order, each compressed on its own, so that one short
document is read without its neighbours.  Layout (little-endian unless it says otherwise):

    8 bytes   magic "TSRZSTD1"
    32 bytes  SHA-256 of the dictionary (of nothing, if there is none)
    8 bytes   range, 8 bytes part: the file's place in the order (big-endian)
    8 bytes   ids in the file (big-endian)
    8 bytes   documents in the file (big-endian)
    n x 41    index: doc_id, 1 if doc_id is null, ids before it in the file, ids, offset and length of its frame
    ...       the zstandard frames of the ids as unsigned 32-bit integers
    1 byte    line end, left by the writer

Files go through Spark's writers, so they can be in any store, and a lost task leaves none.  The
dictionary is trained on a sample of ``sample_docs`` documents (those with the smallest hash of
doc_id, and at most ``sample_bytes`` long; the bound is the feature of a dictionary) and is kept
beside the files.

Defined results: a null text counts as empty; each document ends with ``end_id``; null doc_ids
come first; rows of one doc_id are ordered by the hash of their text; no rows give no files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import Workspace, map_arrow

MAGIC = b"TSRZSTD1"
HEADER = struct.Struct(">8s32sqqqq")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<i8"), ("n", "<i8"), ("at", "<i8"), ("size", "<i8")])
#: Compressed bytes after which a file is closed.
FILE_BYTES = 8 << 20
#: Bytes of the input (as its files or its plan tell) for each range, and ranges at most.
PART_BYTES, MOST_PARTS = 128 << 20, 200_000


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary; plain content of the samples where they are too few to train on."""
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def compressor(dictionary: bytes, level: int = 3):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))


def decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


class FileBuilder:
    def __init__(self, dictionary: bytes, order: tuple[int, int]):
        self.sha, self.order = hashlib.sha256(dictionary).digest(), order
        self.compress = compressor(dictionary).compress
        self.frames: list[bytes] = []
        self.index: list[tuple] = []
        self.size = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.compress(ids.astype("<u4", copy=False).tobytes())
        self.index.append((doc_id or 0, doc_id is None, self.ids, len(ids), self.size, len(frame)))
        self.frames.append(frame)
        self.size += len(frame)
        self.ids += len(ids)

    def done(self) -> bytes:
        head = HEADER.pack(MAGIC, self.sha, *self.order, self.ids, len(self.index))
        return b"".join([head, np.array(self.index, dtype=INDEX).tobytes(), *self.frames])


class TokenFile:
    """Reads a file by ``read(position, bytes)``: its header and index at first, and then of each
    document that is asked for its frame alone."""

    def __init__(self, read: Callable[[int, int], bytes], dictionary: bytes):
        magic, sha, self.range, self.part, self.n_ids, n = HEADER.unpack(read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.index = np.frombuffer(read(HEADER.size, n * INDEX.itemsize), dtype=INDEX)
        self.read, self.frames = read, HEADER.size + self.index.nbytes
        self.decompress = decompressor(dictionary).decompress

    @classmethod
    def of_bytes(cls, data: bytes, dictionary: bytes) -> TokenFile:
        return cls(lambda at, n: data[at : at + n], dictionary)

    @classmethod
    def open(cls, uri: str, dictionary: bytes) -> TokenFile:
        """A file in any store that Arrow's file systems know, by ranged reads."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        file = store.open_input_file(path)
        return cls(lambda at, n: file.read_at(n, at), dictionary)

    def __len__(self) -> int:
        return len(self.index)

    def raw(self, i: int) -> bytes:
        x = self.index[i]
        return self.decompress(bytes(self.read(self.frames + int(x["at"]), int(x["size"]))))

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), dtype="<u4")


def _save_files(files: DataFrame, path: str) -> None:
    """One file for each row of the binary column ``file``, byte for byte."""
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _load_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


class TokenStore:
    """A folder of token files and their dictionary."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def dictionary(self) -> bytes:
        return bytes(_load_files(self.spark, f"{self.root}/dictionary").first()[0])[:-1]

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
        files = _load_files(self.spark, f"{self.root}/files")
        number = lambda at: F.conv(F.hex(F.substring("content", at, 8)), 16, 10).cast("long")
        heads = files.select(number(41).alias("_range"), number(49).alias("_part"), number(57).alias("_ids"))
        # One row for each file, so a task can sum them up.
        before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.select("_range", "_part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
        dictionary = self.dictionary()

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    f = TokenFile.of_bytes(content.as_py(), dictionary)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(f.index["doc_id"], pa.int64(), mask=f.index["null"].astype(bool)),
                            "_range": np.full(len(f), f.range, np.int64),
                            "_part": np.full(len(f), f.part, np.int64),
                            "_start": f.index["start"],
                            "n_tokens": f.index["n"],
                            "ids_crc32": np.array([zlib.crc32(f.raw(i)) for i in range(len(f))], dtype=np.int64),
                        }
                    )

        rows = map_arrow(files, read, "doc_id long, _range long, _part long, _start long, n_tokens long, ids_crc32 long"
        )
        return rows.join(heads, ["_range", "_part"]).select(
            "doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32"
        )


def write(
    docs: DataFrame,
    vocabulary: str | None = None,
    root: str | None = None,
    end_id: int = 0,
    sample_docs: int = 1000,
    sample_bytes: int = 16384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenStore:
    """Encode all of docs into token files below ``root`` (in the shared folder if None)."""
    from tessera.llm._tokens import default_vocabulary

    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    root = root or Workspace(spark, "tokens").path("store")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    by_hash = F.xxhash64(F.lit(17), F.col("doc_id"))
    chosen = rows.select("doc_id").orderBy(by_hash).limit(sample_docs)
    sample = (
        rows.filter(F.octet_length("text") <= sample_bytes)
        .join(F.broadcast(chosen), "doc_id", "left_semi")
        .orderBy(by_hash, F.xxhash64("text"))
        .limit(sample_docs)
        .toArrow()
    )
    dictionary = train_dictionary(_serialised(sample, vocabulary, end_id))
    _save_files(spark.createDataFrame([(bytearray(dictionary),)], "file binary").coalesce(1), f"{root}/dictionary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm._tokens import encoder, with_end
        from tessera.llm._words import slices, text_column

        place, part = TaskContext.get().partitionId(), 0
        out = FileBuilder(dictionary, (place, part))
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                ids, starts = with_end(*encoder(vocabulary).encode(text_column(piece)), end_id)
                for k, doc_id in enumerate(piece.column(0).to_pylist()):
                    out.add(doc_id, ids[starts[k] : starts[k + 1]])
                    if out.size >= FILE_BYTES:
                        yield pa.RecordBatch.from_pydict({"file": pa.array([out.done()], pa.binary())})
                        part += 1
                        out = FileBuilder(dictionary, (place, part))
        if out.index:
            yield pa.RecordBatch.from_pydict({"file": pa.array([out.done()], pa.binary())})

    # Ranges are cut within a doc_id, by text, and within repeated rows, by the task that read them.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(least, min(-(-size // PART_BYTES), MOST_PARTS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    files = rows.repartitionByRange(parts, *order, F.spark_partition_id())
    files = files.sortWithinPartitions(*order, "text")
    _save_files(map_arrow(files, build, "file binary"), f"{root}/files")
    return TokenStore(spark, root)


def _serialised(sample: pa.Table, vocabulary: str, end_id: int) -> list[bytes]:
    from tessera.llm._tokens import encoder, with_end
    from tessera.llm._words import text_column

    out: list[bytes] = []
    for batch in sample.combine_chunks().to_batches():
        ids, starts = with_end(*encoder(vocabulary).encode(text_column(batch)), end_id)
        out += [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
    return out
