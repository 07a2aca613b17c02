"""Sum-of-squares online packing of token ids into windows.

Documents come one by one.  A document's whole windows are filled at once; what is left over,
shorter than a window, goes to the fill level that makes the sum over the levels of (number of
partially filled windows at the level) squared smallest, an empty window counting as level 0.  The
counts are an array with one entry for each level.  Where several levels are as good, the fullest
is taken.

Each partition packs what it reads, as it reads it, without a shuffle, and holds its partially
filled windows only.  At its end these are closed by pouring the emptiest into the gaps of the
fullest, cutting where they overflow, which leaves one window with padding in a partition at most.
Documents that no two of fit into a window (just over half of one) would leave all windows open, so
the same is done whenever ``MOST_OPEN`` windows are: that bounds the ids held to
``MOST_OPEN`` * window, and costs cuts but no padding, as the one window left goes on.

Defined results: a null text counts as empty; each document ends with ``end_id``; repeated rows
are packed each for itself; a null doc_id is kept; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import map_arrow, tidy

WINDOW = 1024
#: Partially filled windows that a partition holds at most.
MOST_OPEN = 8192
#: Text bytes that are encoded at once; windows don't depend on it.
SLICE_BYTES = 2 << 20
#: Windows that one partition may number.
PER_PARTITION = 1 << 36


class SumOfSquares:
    """The level array: ``count[h]`` windows are filled up to h; ``place`` chooses a level."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)

    def place(self, n: int) -> int:
        """The level that takes a piece of n < size; the counts follow."""
        size, count = self.size, self.count
        levels = size - n
        # From level h to h + n: 2 (count[h + n] - count[h]) + 2; a full window is no level.
        change = 2 * (count[n : n + levels + 1] - count[: levels + 1]) + 2
        change[0] = 2 * count[n] + 1
        change[levels] = 1 - 2 * count[levels]
        closed = count[: levels + 1] == 0
        closed[0] = False
        change[closed] = np.iinfo(np.int64).max
        level = levels - int(np.argmin(change[::-1]))
        if level:
            count[level] -= 1
        if level + n < size:
            count[level + n] += 1
        return level


class Packer:
    """Packs documents into windows; ``rows`` collects the pieces of closed windows."""

    def __init__(self, size: int = WINDOW, first: int = 0, most_open: int = MOST_OPEN):
        self.size, self.next, self.most_open = size, first, most_open
        self.levels = SumOfSquares(size)
        self.n_open = 0
        #: Level to the partially filled windows there, each a list of pieces (doc, start, ids).
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        """doc: what identifies the document in the rows."""
        whole = len(ids) - len(ids) % self.size
        for start in range(0, whole, self.size):
            self._close([(doc, start, ids[start : start + self.size])])
        if whole < len(ids):
            self._place((doc, whole, ids[whole:].copy()))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2])
        level = self.levels.place(n)
        window = self.open[level].pop() if level else []
        self.n_open += not level
        window.append(piece)
        if level + n == self.size:
            self._close(window)
            self.n_open -= 1
        else:
            self.open.setdefault(level + n, []).append(window)
            if self.n_open >= self.most_open:
                self._pour()

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids in window:
            self.rows.append((doc, start, ids, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Close all windows."""
        self._pour()
        for windows in self.open.values():
            for w in windows:
                self._close(w)
        self.open, self.n_open = {}, 0

    def _pour(self) -> None:
        """Pour the emptiest windows into the gaps of the fullest; one stays open at most."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.levels, self.n_open = {}, SumOfSquares(self.size), 0
        low, high = len(left) - 1, 0
        while high < low:
            gap = self.size - sum(len(p[2]) for p in left[high])
            while gap and high < low:
                doc, start, ids = left[low].pop()
                if len(ids) > gap:
                    left[low].append((doc, start, ids[:-gap]))
                    start, ids = start + len(ids) - gap, ids[-gap:]
                left[high].append((doc, start, ids))
                gap -= len(ids)
                low -= not left[low]
            if not gap:
                self._close(left[high])
                high += 1
        if high == low:
            level = sum(len(p[2]) for p in left[high])
            self.open, self.n_open = {level: [left[high]]}, 1
            self.levels.count[level] = 1


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: SCHEMA, and its ids as an array if ``with_ids``."""
    from tessera.llm._tokens import default_vocabulary

    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        column = lambda f: pa.array([f(p) for p in pieces], pa.int64())
        out = {
            "doc_id": column(lambda p: p[0][0]),
            "start": column(lambda p: p[1]),
            "length": column(lambda p: len(p[2])),
            "ids_crc32": column(lambda p: zlib.crc32(np.ascontiguousarray(p[2], dtype="<u4").tobytes())),
            "doc_tokens": column(lambda p: p[0][1]),
            "sequence_id": column(lambda p: p[3]),
            "offset": column(lambda p: p[4]),
        }
        if with_ids:
            out["ids"] = pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm._tokens import encoder, with_end
        from tessera.llm._words import slices, text_column

        packer = Packer(window, TaskContext.get().partitionId() * PER_PARTITION)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                ids, starts = with_end(*encoder(vocabulary).encode(text_column(part)), end_id)
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    packer.add((doc_id, int(starts[k + 1] - starts[k])), ids[starts[k] : starts[k + 1]])
                del ids, starts
                if packer.rows:
                    yield batch_of(packer.rows)
                    packer.rows = []
                tidy()
        packer.finish()
        if packer.rows:
            yield batch_of(packer.rows)

    return map_arrow(rows, run, SCHEMA + (", ids array<int>" if with_ids else ""))
