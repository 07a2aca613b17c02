"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the frequencies of hashed character n-grams (1 to 3 letters, word ends marked), times
their inverse document frequency.  Weights are trained by follow-the-regularised-leader with L1
and L2 penalties, so most are exactly zero, and a temperature fitted on held-out sample rows
makes the scores probabilities.  The fit uses a sample of ``per_lang`` documents of each language
value, none longer than ``max_bytes`` (two parameters); the model is small and scoring reads every
whole text once, without a shuffle.

Scoring adds up each distinct word's weights once for a slice of documents, a language at a time, so
its memory doesn't grow with the languages.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text
where nothing was learned (``keep_identified`` then keeps all rows, as it can't tell any); a null
doc_id is in no held-out part; repeated rows get equal results; no rows give no rows; other columns,
whatever their names, are passed through by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._fit import SAMPLE_BYTES, fold, letter_grams, sample_ids, sample_rows
from tessera.llm._shared import map_arrow, text_udf, tidy
from tessera.llm._words import Words, segment_sum, slices, text_column

BUCKETS = 1 << 15
LENGTHS = range(1, 4)
#: Frequencies are multiplied by this; it sets the scale that the penalties are measured on.
SCALE = 20.0
FOLDS, HELD_OUT = 3, 1
#: Text bytes that are scored at once.
SLICE = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages, times idf and SCALE
    bias: np.ndarray
    temperature: float

    def logits(self, col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of each text, and its number of n-grams (0: no letter)."""
        words = Words(col)
        grams, bounds = letter_grams(words.distinct.to_pylist(), LENGTHS, BUCKETS)
        total = np.empty((len(col), len(self.langs)))
        for k in range(len(self.langs)):
            by_word = segment_sum(self.weights[:, k][grams], bounds)
            total[:, k] = segment_sum(by_word[words.codes], words.bounds)
        n = segment_sum(np.diff(bounds).astype(np.float64)[words.codes], words.bounds)
        return (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature, n


def _features(col: pa.LargeStringArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and frequencies of each text."""
    words = Words(col)
    grams, bounds = letter_grams(words.distinct.to_pylist(), LENGTHS, BUCKETS)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        codes, times = np.unique(words.codes[a:b], return_counts=True)
        n = np.diff(bounds)[codes]
        ids = np.concatenate([grams[bounds[c] : bounds[c + 1]] for c in codes]) if len(codes) else grams[:0]
        count = np.bincount(ids, weights=np.repeat(times, n), minlength=1)
        at = np.flatnonzero(count)
        out.append((at, count[at] / max(count.sum(), 1)))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows, y, k, epochs=4, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, seed=7):
    """Multinomial FTRL-proximal over sparse rows (indices, values); the last index is the bias."""
    z = np.zeros((BUCKETS + 1, k))
    n = np.zeros((BUCKETS + 1, k))

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2)
        w[np.abs(za) <= l1] = 0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    return weights(np.arange(BUCKETS + 1))


def fit(texts: pa.LargeStringArray, labels: list[str]) -> Model | None:
    langs = sorted(set(labels))
    if not langs:
        return None
    y = np.searchsorted(np.array(langs), np.array(labels))
    counts = _features(texts)
    df = np.bincount(np.concatenate([at for at, _ in counts]), minlength=BUCKETS)
    idf = np.log((1 + len(counts)) / (1 + df)) + 1
    rows = [(np.append(at, BUCKETS), np.append(x * idf[at] * SCALE, 1.0)) for at, x in counts]
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held) if len(rows) >= 20 else np.arange(len(rows))
    w = ftrl([rows[i] for i in train], y[train], len(langs))
    model = Model(langs, w[:-1] * (idf * SCALE)[:, None], w[-1], 1.0)
    test = np.flatnonzero(held) if len(rows) >= 20 else train
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in test])

    def loss(t):
        p = _softmax(logits / t)[np.arange(len(test)), y[test]]
        return -np.log(np.maximum(p, 1e-12)).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    model.temperature = float(min(grid, key=loss))
    return model


def train(
    docs: DataFrame,
    per_lang: int = 800,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_bytes: int = SAMPLE_BYTES,
) -> Model | None:
    """Fit on documents of the learning folds only; None if there is nothing to learn from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"))
    known = rows.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    ids = sample_ids(known.select("doc_id", "label"), lambda lang: per_lang)
    sample = sample_rows(rows.select("doc_id", "text"), ids, ["doc_id", "text"], max_bytes)
    if not len(sample):
        return None
    batch = sample.select(["text"]).combine_chunks().to_batches()[0]
    model = fit(text_column(batch), sample.column("label").to_pylist())
    tidy()
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(id_col, FOLDS).alias("fold"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(
            "doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, SLICE):
                logits, n = m.logits(text_column(part))
                p = _softmax(logits)
                best = np.where(n > 0, p.argmax(axis=1), len(m.langs))
                score = np.where(n > 0, p.max(axis=1), 0.0)
                held = np.asarray(part.column(1)) == HELD_OUT
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "held_out": held,
                        "lang_pred": pa.array(names[best], pa.string()),
                        "score": score,
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", **train_args) -> DataFrame:
    """Rows of docs whose language is identified with at least ``min_score``; all columns stay.

    The default rejects texts without a letter and near-ties of all languages, but no text that is
    mostly of one language and holds a passage of another.
    """
    model = train(docs, text_col=text_col, **train_args)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(parts: Iterator[pa.LargeStringArray]) -> pa.Array:
        good = [np.empty(0, bool)]
        for col in parts:
            logits, n = shared.value.logits(col)
            good.append((n > 0) & (_softmax(logits).max(axis=1) >= min_score))
        return pa.array(np.concatenate(good))

    return docs.filter(text_udf(docs.sparkSession, known, "boolean", F.col(text_col), SLICE))
