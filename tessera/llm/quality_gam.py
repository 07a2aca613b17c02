"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins by quantiles.  Cyclic boosting visits the features in
turn; each step fits a tree of three leaves to one feature's bins and adds it to that feature's
lookup table.  The pairs of features whose joint bins explain most of what is left get tables of
their own, boosted in the same way with trees that split one feature and then the other.  A score
is the sum of the tables' entries at the text's bins, looked up for many texts at once.

Features are counted over every whole text, once, without a shuffle.  Bins and tables are fitted
on ``per_label`` documents of each label value (a parameter).  Defined results: null and empty
texts have features of zero; a null doc_id is in no held-out part; of several labels of one doc_id
the smallest holds; repeated rows get equal results; with no label value to tell from another
every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._fit import fold, sample_ids, sigmoid
from tessera.llm._shared import map_arrow
from tessera.llm._words import Words, hash_strings, raw, segment_sum, slices, strings, text_column

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
BINS, PAIR_BINS, PAIRS = 32, 8, 6

_CLASS = np.zeros((256, 7), dtype=np.float32)  # upper, lower or other letter, digit, symbol, stop, mark, line end
_CLASS[[*range(65, 91)], 0] = 1
_CLASS[[*range(97, 123), *range(0xC3, 0xF5)], 1] = 1
_CLASS[[*range(48, 58)], 2] = 1
_CLASS[[ord(c) for c in "#*$%&|<>{}[]@^~\\/=+_"], 3] = 1
_CLASS[[ord(c) for c in ".,;:"], 4] = 1
_CLASS[[ord(c) for c in "!?"], 5] = 1
_CLASS[10, 6] = 1

FEATURES = (
    "log_words",
    "word_length",
    "upper",
    "digits",
    "symbols",
    "stops",
    "marks",
    "lines",
    "neighbours",
    "distinct",
    "repeated_pairs",
    "longest",
    "same_lines",
    "bare_words",
)


def features(col: pa.LargeStringArray) -> np.ndarray:
    """One row of FEATURES for each text."""
    words = Words(col)
    data, ends = raw(col)
    # A class at a time: all at once would take seven times the memory.
    counts = np.column_stack([segment_sum(c[data], ends) for c in _CLASS.T]) if len(data) else np.zeros((len(col), 7))
    n = np.diff(words.bounds).astype(np.float64)
    per_word = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(col)), np.diff(words.bounds))
    wdata, wends = raw(words.distinct)
    size = np.diff(wends).astype(np.float64)
    letters = segment_sum((_CLASS[wdata, 0] + _CLASS[wdata, 1] + _CLASS[wdata, 2]).astype(np.float64), wends) if len(size) else size
    size, bare = size[words.codes], (letters == 0)[words.codes].astype(np.float64)
    in_doc = doc[1:] == doc[:-1]
    same = np.zeros(len(doc))
    same[1:] = in_doc & (words.codes[1:] == words.codes[:-1])

    def distinct(doc, key, k):
        """Distinct keys of each document over its keys."""
        pair = np.unique(doc.astype(np.int64) * k + key) if len(doc) else doc
        return np.bincount(pair // k, minlength=len(col)) if len(pair) else np.zeros(len(col))

    k = len(words.distinct) + 1
    single = distinct(doc, words.codes, k)
    code = words.codes.astype(np.int64)
    follow = np.unique(code[:-1] * k + code[1:], return_inverse=True)[1] if len(code) > 1 else code[:0]
    double = distinct(doc[:-1][in_doc], follow[in_doc], max(len(follow), 1) + 1)
    # Lines, cut at line ends; a text's start cuts too.
    cut = np.union1d(ends[:-1][np.diff(ends) > 0], np.flatnonzero(data == 10)) if len(data) else np.empty(0, np.int64)
    line = hash_strings(strings(data, np.append(cut, len(data)))) if len(cut) else np.empty(0, np.uint64)
    line_doc = np.searchsorted(ends, cut, side="right") - 1
    line_code = np.unique(line, return_inverse=True)[1] if len(line) else np.empty(0, np.int64)
    n_lines = np.bincount(line_doc, minlength=len(col)) if len(cut) else np.zeros(len(col))
    own_lines = distinct(line_doc, line_code, len(line_code) + 1)
    longest = np.zeros(len(col))
    some = np.flatnonzero(n > 0)
    if len(some):
        longest[some] = np.maximum.reduceat(size, words.bounds[:-1][some])
    alpha = np.maximum(counts[:, 0] + counts[:, 1], 1)
    return np.column_stack(
        [
            np.log1p(n),
            segment_sum(size, words.bounds) / per_word,
            counts[:, 0] / alpha,
            counts[:, 2] / per_word,
            counts[:, 3] / per_word,
            counts[:, 4] / per_word,
            counts[:, 5] / per_word,
            counts[:, 6] / per_word,
            segment_sum(same, words.bounds) / per_word,
            single / per_word,
            1 - double / np.maximum(n - 1, 1),
            np.log1p(longest),
            1 - own_lines / np.maximum(n_lines, 1),
            segment_sum(bare, words.bounds) / per_word,
        ]
    )


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for i, j, table in self.pairs:
            a = np.searchsorted(self.pair_edges[i], x[:, i], side="right")
            b = np.searchsorted(self.pair_edges[j], x[:, j], side="right")
            total += table[a, b]
        return sigmoid(total)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g, h, l2=1.0):
    return g * g / (h + l2)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of the bins that gains most, and its gain over none."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _leaves(g, h, depth):
    """A step for each bin: a tree of ``depth + 1`` leaves at most, grown best first."""
    parts = [(0, len(g))]
    for _ in range(depth):
        found = [(*_best_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts)]
        gain, cut, i = max(found)
        if gain <= 1e-6:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each cell: one feature is cut, then each side by the other, in the better order."""
    best = None
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, cut = _best_cut(a.sum(axis=1), b.sum(axis=1))
        out = np.zeros_like(a)
        for part in (slice(0, cut), slice(cut, None)):
            if a[part].size:
                out[part] = _leaves(a[part].sum(axis=0), b[part].sum(axis=0), 1)[None, :]
        gain = float((out * a).sum())
        if best is None or gain > best[0]:
            best = (gain, out.T if flip else out)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    # Both labels count alike in the fit; the bias then brings back their shares.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m = Model(0.0)
    m.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    m.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.pair_edges)]
    total = np.zeros(len(y))

    def slopes():
        p = sigmoid(total)
        return (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight

    for _ in range(rounds):
        for j, bins in enumerate(at):
            g, h = slopes()
            size = len(m.tables[j])
            step = rate * _leaves(np.bincount(bins, g, size), np.bincount(bins, h, size), 2)
            m.tables[j] += step
            total += step[bins]
    g, h = slopes()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            shape = (len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1)
            cell = coarse[i] * shape[1] + coarse[j]
            a, b = np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)
            found.append((float((_pair_leaves(a, b) * a).sum()), i, j, cell, shape))
    found = sorted(found, key=lambda f: -f[0])[:PAIRS]
    m.pairs = [(i, j, np.zeros(shape)) for _, i, j, _, shape in found]
    for _ in range(pair_rounds):
        for (_, _, table), (_, _, _, cell, shape) in zip(m.pairs, found):
            g, h = slopes()
            size = shape[0] * shape[1]
            step = rate * _pair_leaves(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))
            table += step
            total += step.ravel()[cell]
    return m


def measure(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs' ``columns`` and the array ``x`` of FEATURES of every whole text."""
    rows = docs.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(text_column(part))
                out = {c: part.column(i) for i, c in enumerate(columns)}
                out["x"] = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict(out)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return map_arrow(rows, run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents of the learning folds only."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    ids = sample_ids(known, lambda label: per_label)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    found = measure(rows, ["doc_id", "label"]).toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.empty(0))
    # Of several rows of a doc_id the one with the smallest features.
    found["x"] = found["x"].map(tuple)
    found = found.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    return fit(np.array(found["x"].tolist()), np.minimum(found["label"].to_numpy(), 1).astype(np.float64))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(id_col, FOLDS).alias("fold"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.score(features(text_column(part)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "held_out": np.asarray(part.column(1)) == HELD_OUT,
                        "score": score,
                        "predicted": (score >= THRESHOLD).astype(np.int32),
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
