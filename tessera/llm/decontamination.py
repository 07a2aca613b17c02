"""Benchmark decontamination under edit distance.

Texts and items are sequences of words, in lower case and without what is no letter or digit.  A
document holds an item of ``size`` words if some stretch of its words is within ``edits`` =
floor(0.2 * size) word edits of it.

1. Starts that cannot match are left out without loss.  An edit changes two of an item's word pairs
   at most, so a match keeps size - 1 - 2 * edits of them; the places where a text has a pair of
   some item of the size are counted.  Each changed pair before the first kept one, and each
   inserted word, moves the start back, so it lies at most 2 * edits words before its first hit.
2. CGK: a random walk copies an item-sized window into 2 * size places, at each place staying on its
   word or going on, by a random bit of the place and the word.  Windows a few edits apart fall into
   step again, so edit distance becomes Hamming distance.
3. LSH: samplings of a few places of a walk; windows and items that agree in one are candidates.
   Walks are added until each kind of probe (as many edits as allowed: mixed, on every other word
   from the second on, evenly spread, only deleted or only inserted words) is found at the target
   rate.  Sizes that ``MAX_WALKS`` walks don't bring there are searched exactly: every item that
   shares enough pairs with a window is a candidate.
4. Candidates are verified by edit distance, many at once, to the best end of the stretch.

Items are used in blocks of ``BLOCK``, which bounds what is broadcast; every block goes over all
documents.  Items of fewer than ``MIN_WORDS`` words say too little and match nothing.  Defined
results: a null or empty text holds nothing; repeated documents are each found, repeated items each
reported; a null doc_id or item_id is given back; without documents or items there are no rows;
other columns, whatever their names, are passed through by ``remove``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import map_arrow, text_udf
from tessera.llm._words import Words, hash_strings, mix, ragged, slices, text_column

MIN_WORDS = 5
BLOCK = 20_000
EDIT_SHARE = 0.2
TARGET_RECALL = 0.98
MAX_WALKS, SAMPLINGS, PLACES = 8, 96, 2
#: Words of windows that wait for the index, and cells of a table of edit distances.
WAITING, CELLS = 1 << 20, 1 << 20
_END = np.uint64(0)
_BASE = 0x9FB21C651E98DF25
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def edits_of(size: int) -> int:
    return int(EDIT_SHARE * size + 1e-9)


def normal_words(col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, each text's codes into them, and bounds."""
    words = Words(col)
    text = "\n".join(words.distinct.to_pylist()).lower()
    clean = re.sub(r"[^\w\n]|_", "", text).split("\n") if len(words.distinct) else []
    h = hash_strings(pa.array(clean, pa.large_string())) | np.uint64(1)
    solid = np.array([bool(x) for x in clean], dtype=bool)
    keep = solid[words.codes] if len(words.codes) else np.empty(0, bool)
    bounds = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    return h, words.codes[keep], bounds


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the edit distance of the item to the best beginning of the text (padded by
    _END), and the length of the shortest such beginning."""
    size, width = items.shape[1], texts.shape[1]
    out, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    step = max(1, CELLS // (width + 1))
    count = np.arange(width + 1, dtype=np.int32)
    for s in range(0, len(items), step):
        a, b = items[s : s + step], texts[s : s + step]
        row = np.broadcast_to(count, (len(a), width + 1)).copy()
        for i in range(size):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]), out=new[:, 1:])
            # Insertions: the smallest of what stands before plus the distance to it.
            new -= count
            np.minimum.accumulate(new, axis=1, out=new)
            new += count
            row = new
        ends[s : s + step] = row.argmin(axis=1)
        out[s : s + step] = row.min(axis=1)
    return out, ends


def walk(x: np.ndarray, seed: int) -> np.ndarray:
    """The CGK walk of each row of x (words, padded by _END): the words at its 2 * size places."""
    n, size = x.shape
    salts = mix(np.arange(2 * size, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 12345))
    padded = np.column_stack([x, np.full(n, _END, np.uint64)]).ravel()
    first = np.arange(n) * (size + 1)
    at = np.zeros(n, np.int64)
    out = np.empty((2 * size, n), np.uint64)
    for j in range(2 * size):
        word = out[j] = padded[first + np.minimum(at, size)]
        at += ((word * _MIX + salts[j]) >> np.uint64(63)).astype(np.int64)
    return out


_MIX = np.uint64(0xD1342543DE82EF95)


@dataclass
class SizeIndex:
    """LSH tables of the items of one size; ``exact`` if they don't reach the target."""

    size: int
    items: np.ndarray  # positions of the items
    words: np.ndarray
    walks: list[tuple[int, np.ndarray]] = field(default_factory=list)  # seed, and places of each sampling
    #: Of each walk the items' keys, sorted, their rows, and which of the keys' last bits there are.
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    recall: float = 0.0
    exact: bool = False

    def keys(self, x: np.ndarray, seed: int, places: np.ndarray) -> np.ndarray:
        """samplings x rows; a key tells its sampling too."""
        out = np.empty((len(places), len(x)), np.uint64)
        step = max(1, CELLS // (2 * self.size))
        for s in range(0, len(x), step):
            words = walk(x[s : s + step], seed)
            key = np.broadcast_to(np.arange(len(places), dtype=np.uint64)[:, None], (len(places), words.shape[1]))
            for column in places.T:
                key = mix(key + words[column])
            out[:, s : s + step] = key
        return out

    def add(self, seed: int, places: np.ndarray) -> None:
        self.walks.append((seed, places))
        keys = self.keys(self.words, seed, places).ravel()
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(16 << len(keys).bit_length(), bool)
        bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        self.tables.append((keys[order], order % len(self.words), bits))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Pairs (row of x, row of words) that agree in some sampling, each once."""
        step = max(1, CELLS // SAMPLINGS)
        parts = [self._candidates(x[s : s + step]) + [[s, 0]] for s in range(0, len(x), step)]
        return np.concatenate(parts)

    def _candidates(self, x: np.ndarray) -> np.ndarray:
        found = [np.empty(0, np.int64)]
        for (seed, places), (keys, rows, bits) in zip(self.walks, self.tables):
            own = self.keys(x, seed, places).ravel()
            at = np.flatnonzero(bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)])
            low = np.searchsorted(keys, own[at])
            n = np.searchsorted(keys, own[at], side="right") - low
            found.append(np.unique(np.repeat(at % len(x), n) * len(self.words) + rows[ragged(low, n)]))
        pairs = np.unique(np.concatenate(found))
        return np.column_stack([pairs // len(self.words), pairs % len(self.words)])


def probes(words: np.ndarray, edits: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows of words with ``edits`` edits each, at their size: one array for each kind of edits."""
    size = words.shape[1]

    def new() -> np.uint64:
        return np.uint64(rng.integers(1 << 62)) | np.uint64(1)

    def edited(row: np.ndarray, kind: str) -> list:
        x = list(row)
        spread = rng.permutation(size)[:edits] if kind == "spread" else None
        for k in range(edits):
            do = kind if kind != "mixed" else ("spread", "deleted", "inserted")[rng.integers(3)]
            if kind == "alternating":
                x[min(2 * k + 1, size - 1)] = new()
            elif do == "deleted":
                del x[rng.integers(len(x))]
            elif do == "inserted":
                x.insert(int(rng.integers(len(x) + 1)), new())
            else:
                x[spread[k] if spread is not None else rng.integers(len(x))] = new()
        x = x[:size]
        return x + [new() for _ in range(size - len(x))]

    for kind in ("mixed", "alternating", "spread", "deleted", "inserted"):
        yield np.array([edited(row, kind) for row in words], np.uint64).reshape(-1, size)


def size_index(size: int, items: np.ndarray, words: np.ndarray, target: float = TARGET_RECALL) -> SizeIndex:
    """Adds walks until the probes of each kind are found at the target rate."""
    rng = np.random.default_rng(size)
    base = words[rng.integers(len(words), size=min(64, max(8, 100_000 // size)))]
    kinds = list(probes(base, edits_of(size), rng))
    missed = np.ones((len(kinds), len(base)), bool)
    index = SizeIndex(size, items, words)
    while index.recall < target and len(index.walks) < MAX_WALKS:
        seed = size * 1000 + len(index.walks)
        places = rng.integers(2 * size, size=(SAMPLINGS, PLACES))
        index.add(seed, places)
        own = index.keys(base, seed, places)
        for k, x in enumerate(kinds):
            missed[k] &= (index.keys(x, seed, places) != own).all(axis=0)
        index.recall = 1 - float(missed.mean(axis=1).max())
    index.exact = index.recall < target
    return index


class Benchmark:
    """The items of a block, indexed."""

    def __init__(self, ids: list, texts: list[str | None], target: float = TARGET_RECALL):
        self.ids = ids
        h, codes, bounds = normal_words(pa.array([t or "" for t in texts], pa.large_string()))
        items = [h[codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
        used = [i for i, x in enumerate(items) if len(x) >= MIN_WORDS]
        self.vocabulary = np.unique(np.concatenate([items[i] for i in used])) if used else np.empty(0, np.uint64)
        pairs = {i: self.pair(items[i][:-1], items[i][1:]) for i in used}
        self.pairs = np.unique(np.concatenate(list(pairs.values()))) if used else np.empty(0, np.uint64)
        doubled = {i: x[items[i][:-1] == items[i][1:]] for i, x in pairs.items()}
        #: Each item has a word twice in a row at most once: then a run of one word adds one pair.
        self.short_runs = all(len(np.unique(x)) == len(x) for x in doubled.values())
        self.sizes: list[SizeIndex] = []
        self.pairs_of: list[np.ndarray] = []  # by size: which of the pairs an item of the size has
        by_size: dict[int, list[int]] = {}
        for i in used:
            by_size.setdefault(len(items[i]), []).append(i)
        for size in sorted(by_size):
            own = np.array(by_size[size])
            self.sizes.append(size_index(size, own, np.array([items[i] for i in own]), target))
            self.pairs_of.append(np.isin(self.pairs, np.concatenate([pairs[i] for i in own])))

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)

    @staticmethod
    def _find(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where each x stands in sorted_values, -1 if it doesn't."""
        if not len(sorted_values):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
        return np.where(sorted_values[at] == x, at, -1)

    def search(self, parts: Iterable[pa.LargeStringArray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of the best stretch of each text and item; texts
        are numbered through all parts."""
        out = Search(self)
        for col in parts:
            out.add(col)
        return out.done()

    def hits(self, h: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a text has a pair of some item, and which of the pairs."""
        known = (self._find(self.vocabulary, h) >= 0)[codes]
        same_text = np.ones(len(codes), bool)
        same_text[bounds[1:][np.diff(bounds) > 0] - 1] = False
        hits = np.flatnonzero(known[:-1] & known[1:] & same_text[:-1])  # where pair (i, i + 1) may be an item's
        which = self._find(self.pairs, self.pair(h[codes[hits]], h[codes[hits + 1]]))
        hits, which = hits[which >= 0], which[which >= 0]
        if self.short_runs and len(hits):
            # Of a long run the ends are enough: a stretch within it holds one word only.
            on = (hits[1:] == hits[:-1] + 1) & (which[1:] == which[:-1])
            inner = np.append(False, on) & np.append(on, False)
            hits, which = hits[~inner], which[~inner]
        return hits, which


class Search:
    """Gathers the possible starts of some texts and looks them up together."""

    def __init__(self, items: Benchmark):
        self.items = items
        self.best: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.texts = 0
        self._clear()

    def _clear(self) -> None:
        self.waiting: list[list[tuple]] = [[] for _ in self.items.sizes]
        self.held = 0

    def add(self, col: pa.LargeStringArray) -> None:
        before, self.texts = self.texts, self.texts + len(col)
        h, codes, bounds = normal_words(col)
        if not self.items.sizes or len(codes) < 2:
            return
        hits, which = self.items.hits(h, codes, bounds)
        if not len(hits):
            return
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        x = h[codes]
        power = np.cumprod(np.full(len(x) + 1, _BASE, dtype=np.uint64))
        back = np.cumprod(np.full(len(x) + 1, _BACK, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])
        for k, (index, own) in enumerate(zip(self.items.sizes, self.items.pairs_of)):
            size, most = index.size, edits_of(index.size)
            width = size + most
            p = hits[own[which]]
            need = max(size - 1 - 2 * most, 1)
            first = p[np.searchsorted(p, p + width - 1) - np.arange(len(p)) >= need]
            if not len(first):
                continue
            at = np.unique(ragged(first - 2 * most, np.full(len(first), 2 * most + 1)))
            at = at[at >= 0]
            stop = np.minimum(at + width, bounds[doc[at] + 1])
            n = np.searchsorted(p, stop - 1) - np.searchsorted(p, at)
            enough = (n >= need) & (stop - at >= size - most)
            at, stop = at[enough], stop[enough]
            if not len(at):
                continue
            content = mix((total[stop] - total[at]) * back[at] + (stop - at).astype(np.uint64))
            _, one, row = np.unique(content, return_index=True, return_inverse=True)  # equal stretches are looked up once
            step = max(1, WAITING // width)
            for s in range(0, len(one), step):
                where = at[one[s : s + step], None] + np.arange(width)[None, :]
                inside = where < stop[one[s : s + step], None]
                words = np.where(inside, x[np.minimum(where, len(x) - 1)], _END)
                mine = np.flatnonzero((row >= s) & (row < s + step))
                self.waiting[k].append((words, row[mine] - s, doc[at[mine]] + before, at[mine] - bounds[doc[at[mine]]]))
                self.held += words.size
                if self.held >= WAITING:
                    self._look_up()

    def _look_up(self) -> None:
        for k, found in enumerate(self.waiting):
            if found:
                self._size(self.items.sizes[k], found)
        self._clear()

    def _size(self, index: SizeIndex, found: list[tuple]) -> None:
        most = edits_of(index.size)
        sizes = np.cumsum([0] + [len(f[0]) for f in found])
        x = np.concatenate([f[0] for f in found])
        row = np.concatenate([f[1] + s for f, s in zip(found, sizes)])
        doc, start = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        pairs = self._sharing(index, x, None if index.exact else index.candidates(x[:, : index.size]))
        if not len(pairs):
            return
        edits, length = distances(index.words[pairs[:, 1]], x[pairs[:, 0]])
        good = edits <= most
        pairs, edits, length = pairs[good], edits[good], length[good]
        order = np.argsort(row, kind="stable")
        low, high = np.searchsorted(row[order], pairs[:, 0]), np.searchsorted(row[order], pairs[:, 0], side="right")
        for (_, item), e, n, a, b in zip(pairs.tolist(), edits.tolist(), length.tolist(), low, high):
            for w in order[a:b]:
                key, mine = (int(doc[w]), int(index.items[item])), (e, int(start[w]), n)
                if key not in self.best or mine < self.best[key]:
                    self.best[key] = mine

    def _sharing(self, index: SizeIndex, x: np.ndarray, among: np.ndarray | None) -> np.ndarray:
        """Pairs (row of x, row of index.words), all or ``among`` these, with as many word pairs in
        common as a match has; the others can't be verified."""
        b, n_items = self.items, len(index.words)
        need = max(index.size - 1 - 2 * edits_of(index.size), 1)
        item_pair = b._find(b.pairs, b.pair(index.words[:, :-1].ravel(), index.words[:, 1:].ravel()))
        held = np.unique(item_pair * n_items + np.repeat(np.arange(n_items), index.size - 1))
        starts = np.searchsorted(held, np.arange(len(b.pairs) + 1) * n_items)
        p = b._find(b.pairs, b.pair(x[:, :-1].ravel(), x[:, 1:].ravel())).reshape(len(x), -1)
        out = [np.empty((0, 2), np.int64)]
        if among is not None:
            step = max(1, CELLS // p.shape[1])
            for s in range(0, len(among), step):
                part = among[s : s + step]
                shared = p[part[:, 0]]
                key = np.where(shared >= 0, shared * n_items + part[:, 1:], -1)
                at = np.minimum(np.searchsorted(held, key), len(held) - 1)
                out.append(part[(held[at] == key).sum(axis=1) >= need])
            return np.concatenate(out)
        step = max(1, CELLS // (p.shape[1] * max(1, int(np.diff(starts).max()))))
        for s in range(0, len(x), step):
            r, c = np.nonzero(p[s : s + step] >= 0)
            q = p[s + r, c]
            n = starts[q + 1] - starts[q]
            key, count = np.unique(np.repeat(r, n) * n_items + held[ragged(starts[q], n)] % n_items, return_counts=True)
            key = key[count >= need]
            out.append(np.column_stack([key // n_items + s, key % n_items]))
        return np.concatenate(out)

    def done(self) -> list[tuple[int, int, int, int, int]]:
        self._look_up()
        return sorted((d, i, s, n, e) for (d, i), (e, s, n) in self.best.items())


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[Benchmark]:
    """The benchmark's items, ordered by item_id, ``size`` of them at a time."""
    ids: list = []
    texts: list = []
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        if len(ids) == size:
            yield Benchmark(ids, texts)
            ids, texts = [], []
    if ids:
        yield Benchmark(ids, texts)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, word_start, n_words, edits."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, word_start long, n_words int, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, items in enumerate(blocks(benchmark, block)):
        found = map_arrow(rows, _finder(docs.sparkSession.sparkContext.broadcast(items)), schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            found = items.search(text_column(part) for part in slices(batch))
            if found:
                d, i, s, n, e = (np.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(pa.array(d)),
                        "item_id": pa.array([items.ids[k] for k in i]),
                        "word_start": s.astype(np.int64),
                        "n_words": n.astype(np.int32),
                        "edits": e.astype(np.int32),
                    }
                )

    return run


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without the rows that hold an item; all columns stay."""
    spark = docs.sparkSession
    for items in blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(items)

        def clean(parts: Iterator[pa.LargeStringArray], shared=shared) -> pa.Array:
            search = Search(shared.value)
            for col in parts:
                search.add(col)
            good = np.ones(search.texts, bool)
            good[[f[0] for f in search.done()]] = False
            return pa.array(good)

        docs = docs.filter(text_udf(spark, clean, "boolean", F.col(text_col)))
    return docs
