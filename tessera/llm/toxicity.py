"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams (3 to 5 characters,
word ends marked), a window's the mean of its words' vectors, and a linear softmax over it gives
the window's class; embeddings and softmax are trained together by Adagrad.  Unseen misspellings
share n-grams with what was seen.  A text is scored by its worst window of ``WINDOW`` words, so a
few toxic words count alike in short and long texts; in training, each toxic document contributes
the windows that the model so far finds worst, and each clean one also those that it mistakes.

As everything after the embeddings is linear, scoring needs one number for each n-gram bucket.
Every whole text is read once, without a shuffle; the model has a fixed size.

The fit uses ``per_toxic`` toxic and twice as many clean documents, none longer than ``max_bytes``
(two parameters), of equal texts one, and of several texts of a doc_id the smallest.  Defined
results: null and empty texts are scored like a window without words; a null doc_id is in no
held-out part;
of several labels of one doc_id the largest holds; repeated rows get equal results; with no label
value to tell from another every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._fit import SAMPLE_BYTES, fold, sample_ids, sample_rows, sigmoid, symbol_grams
from tessera.llm._shared import map_arrow
from tessera.llm._words import Words, ragged, segment_sum, slices, text_column

BUCKETS = 1 << 17
LENGTHS = range(3, 6)
DIM = 8
WINDOW, STRIDE = 24, 12
BATCH = 128
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each window, and the bounds of each document's windows."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    first = ragged(np.zeros(len(n), np.int64), count) * STRIDE
    first = np.minimum(first, np.repeat(np.maximum(n - WINDOW, 0), count)) + np.repeat(bounds[:-1], count)
    return first, np.repeat(np.minimum(n, WINDOW), count), np.concatenate([[0], np.cumsum(count)])


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float
    slope: float
    shift: float

    def logits(self, col: pa.LargeStringArray) -> np.ndarray:
        words = Words(col)
        grams, bounds = symbol_grams(words.distinct.to_pylist(), LENGTHS, BUCKETS)
        by_word = segment_sum(self.weight[grams], bounds) / np.maximum(np.diff(bounds), 1)
        first, n, of = windows(words.bounds)
        total = np.concatenate([[0.0], np.cumsum(by_word[words.codes])])
        mean = (total[first + n] - total[first]) / np.maximum(n, 1)
        return np.maximum.reduceat(mean, of[:-1]) + self.bias if len(of) > 1 else np.empty(0)

    def score(self, col: pa.LargeStringArray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(col) + self.shift)


class _Trainer:
    def __init__(self, words: Words, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.words = words
        self.grams, self.bounds = symbol_grams(words.distinct.to_pylist(), LENGTHS, BUCKETS)
        self.n_grams = np.diff(self.bounds)
        self.e = self.rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.w = self.rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.sums = [np.full(x.shape[:1] + (1,) * (x.ndim - 1), 1e-4, np.float32) for x in (self.e, self.w, self.b)]

    def window_scores(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = self.e @ (self.w[:, 1] - self.w[:, 0])
        by_word = segment_sum(weight[self.grams], self.bounds) / np.maximum(self.n_grams, 1)
        total = np.concatenate([[0.0], np.cumsum(by_word[self.words.codes])])
        return (total[first + n] - total[first]) / np.maximum(n, 1) + float(self.b[1] - self.b[0])

    def epoch(self, first, n, y, weight, rate):
        order = self.rng.permutation(len(first))
        for s in range(0, len(order), BATCH):
            i = order[s : s + BATCH]
            self._step(first[i], n[i], y[i], weight[i], rate)

    def _step(self, first, n, y, weight, rate):
        codes = self.words.codes[ragged(first, n)]
        win = np.repeat(np.arange(len(n)), n)
        distinct, word = np.unique(codes, return_inverse=True)
        m = self.n_grams[distinct]
        grams = self.grams[ragged(self.bounds[distinct], m)]
        vectors = (segment_sum(self.e[grams], np.concatenate([[0], np.cumsum(m)])) / np.maximum(m, 1)[:, None]).astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(n)])
        h = (segment_sum(vectors[word], ends) / np.maximum(n, 1)[:, None]).astype(np.float32)
        out = h @ self.w + self.b
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        scale = np.float32(1.0 / max(weight.sum(), 1e-6))
        gw, gb, gh = h.T @ p * scale, p.sum(axis=0) * scale, p @ self.w.T
        gh /= np.maximum(n, 1)[:, None]
        gv = np.zeros((len(distinct), DIM), np.float32)
        np.add.at(gv, word, gh[win])
        gv /= np.maximum(m, 1)[:, None]
        order = np.argsort(grams, kind="stable")
        ids, at = np.unique(grams[order], return_index=True)
        if len(ids):
            ge = np.add.reduceat(np.repeat(gv, m, axis=0)[order], at, axis=0)
            self.sums[0][ids, 0] += (ge * ge).mean(axis=1)
            self.e[ids] -= rate * ge / np.sqrt(self.sums[0][ids])
        for x, g, q in ((self.w, gw, self.sums[1]), (self.b, gb, self.sums[2])):
            q += (g * g).mean(axis=tuple(range(1, g.ndim)), keepdims=True) if g.ndim > 1 else g * g
            x -= rate * g / np.sqrt(q)


def fit(texts: pa.LargeStringArray, y: np.ndarray, rounds: int = 4, steps: int = 250, rate: float = 0.3) -> Model:
    """y: 0 or 1 for each text."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    words = Words(texts)
    first, n, of = windows(words.bounds)
    doc = np.repeat(np.arange(len(y)), np.diff(of))
    calibrate = np.arange(len(y)) % 5 == 4
    if len(set(y[calibrate].tolist())) < 2 or len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    trainer = _Trainer(words)
    for r in range(rounds):
        score = trainer.window_scores(first, n) if r else trainer.rng.random(len(first))
        rank = np.empty(len(first), np.int64)  # of each window in its document, the worst first
        order = np.lexsort((-score, doc))
        rank[order] = np.arange(len(order)) - of[doc[order]]
        luck = trainer.rng.random(len(first))
        take = np.where(y[doc] == 1, rank < (12 if r == 0 else 2), (rank < 3) | (luck < 0.2)) & ~calibrate[doc]
        at = np.flatnonzero(take)
        positive = y[doc[at]] == 1
        weight = np.where(positive, len(at) / 2 / max(positive.sum(), 1), len(at) / 2 / max((~positive).sum(), 1))
        for _ in range(max(1, round(steps * BATCH / len(at)))):
            trainer.epoch(first[at], n[at], y[doc[at]], weight.astype(np.float32), rate)
    model = Model((trainer.e @ (trainer.w[:, 1] - trainer.w[:, 0])).astype(np.float32), float(trainer.b[1] - trainer.b[0]), 1.0, 0.0)
    use = calibrate if calibrate.any() else np.ones(len(y), bool)
    worst = np.maximum.reduceat(trainer.window_scores(first, n), of[:-1])[use]
    model.slope, model.shift = _platt(worst, y[use])
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps, with a light penalty on the slope."""
    spread = max(float(x.std()), 1e-6)
    a = np.column_stack([x / spread, np.ones(len(x))])
    t = np.zeros(2)
    for _ in range(30):
        p = sigmoid(a @ t)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.05, 1e-3])
        t -= np.linalg.solve(h, a.T @ (p - y) + np.array([0.05, 1e-3]) * t)
    return max(float(t[0] / spread), 1e-3), float(t[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_toxic: int = 1200,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on labelled documents of the learning folds only."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = sample_ids(known, lambda label: per_toxic if label >= 1 else 2 * per_toxic)
    sample = sample_rows(rows, ids, ["doc_id", "text"], max_bytes)
    if not len(sample):
        return fit(pa.array([], pa.large_string()), np.empty(0, np.int64))
    _, first = np.unique(np.asarray(sample.column("text").combine_chunks().dictionary_encode().indices), return_index=True)
    sample = sample.take(pa.array(np.sort(first)))
    batch = sample.select(["text"]).combine_chunks().to_batches()[0]
    return fit(text_column(batch), np.minimum(sample.column("label").to_numpy(), 1).astype(np.int64))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(id_col, FOLDS).alias("fold"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.score(text_column(part))
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
