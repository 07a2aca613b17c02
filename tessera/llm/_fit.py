"""Bounded samples of labelled documents, and n-grams of words, for the fitted operators."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._words import mix

#: Default of the operators' ``max_bytes``: longer documents are not in a sample (they are scored like any other).
SAMPLE_BYTES = 1 << 16


def fold(id_col: str, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; 0 if the doc_id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0)).cast("int")


def sample_ids(labelled: DataFrame, per_label: Callable[[object], int]) -> DataFrame:
    """Of (doc_id, label), the ``per_label(label)`` ids of each label with the smallest hash, each id once.

    Labels are classes, so few.  Their ids are counted by sketches; the count gives a hash below
    which there are a few more ids than needed, and only those, a number that doesn't grow with the
    table, are gathered and ranked.  An id with several labels keeps the smallest of those gathered.
    """
    spark = labelled.sparkSession
    sizes = labelled.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()
    wanted = {r["label"]: per_label(r["label"]) for r in sizes}
    limits = []
    for label, n in sizes:
        share = (1.15 * wanted[label] + 8 * wanted[label] ** 0.5 + 40) / max(n, 1)
        limits.append((label, min(int((2 * share - 1) * 2.0**63), 2**63 - 1)))
    kinds = labelled.select("label", F.lit(0).cast("long").alias("_limit")).schema
    found = labelled.withColumn("_hash", F.xxhash64(F.lit(29), F.col("doc_id")))
    found = found.join(F.broadcast(spark.createDataFrame(limits, kinds)), "label").filter(F.col("_hash") <= F.col("_limit"))
    found = found.select("doc_id", "label", "_hash").distinct()
    rows = found.toPandas().sort_values(["label", "_hash", "doc_id"], ignore_index=True)
    rows = rows[rows.groupby("label").cumcount() < rows["label"].map(wanted)]
    rows = rows.drop_duplicates("doc_id")[["doc_id", "label"]]
    return spark.createDataFrame(pa.Table.from_pandas(rows, preserve_index=False), found.select("doc_id", "label").schema)


def sample_rows(docs: DataFrame, ids: DataFrame, columns: list[str], max_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """The sampled rows of docs with their label, one for each doc_id (its smallest text), ordered by doc_id."""
    found = docs.filter(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id").select("label", *columns)
    rows = found.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    _, first = np.unique(rows.column("doc_id").to_numpy(), return_index=True)
    return rows.take(pa.array(first))


_NO_LETTER = re.compile(r"[^a-z]")


def letters(word: str) -> str:
    """The word in lower case with a blank for what is no letter (numerals and marks are none)."""
    word = word.lower()
    if word.isascii():
        return _NO_LETTER.sub(" ", word)
    return "".join([c if c.isalpha() else " " for c in word])


def letter_grams(words: list[str], lengths: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word, and the bounds of each word's n-grams.

    Words are in lower case; what is no letter counts as a blank, and an n-gram may have one blank
    at either end, none inside.
    """
    return _in_parts(words, lengths, buckets, letters)


def symbol_grams(words: list[str], lengths: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over all characters of the lower-case word."""
    return _in_parts(words, lengths, buckets, lambda w: w.lower().replace("\n", " "))


def _in_parts(words: list[str], lengths: range, buckets: int, clean) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(words), 1 << 15):
        part = words[k : k + (1 << 15)]
        x, bounds = _grams("\n" + "\n".join(map(clean, part)) + "\n", len(part), lengths, buckets)
        ids.append(x.astype(np.int32))
        sizes.append(np.diff(bounds))
    return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def _grams(text: str, n_words: int, lengths: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    line = np.cumsum(cp == 10) - 1  # the word that starts after this line end
    blank = (cp == 10) | (cp == 32)
    solid = np.cumsum(~blank)
    ids, owner = [], []
    for n in lengths:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, np.uint64(n), dtype=np.uint64)
        for k in range(n):
            x = cp[k : len(cp) - n + 1 + k]
            h = h * np.uint64(0x100000001B3) + np.where(x == 10, np.uint64(32), x)
        inner = solid[n - 2 : len(cp) - 1] - solid[: len(cp) - n + 1] if n > 2 else np.zeros(len(h), np.int64)
        good = inner == n - 2 if n > 2 else np.ones(len(h), bool)
        edge = solid[n - 1 :] - solid[: len(cp) - n + 1] + ~blank[: len(cp) - n + 1]
        good = good & (edge > 0)  # some character is no blank
        at = np.flatnonzero(good)
        ids.append((mix(h[at]) & np.uint64(buckets - 1)).astype(np.int64))
        owner.append(line[at])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    keep = owner < n_words
    ids, owner = ids[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(n_words + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
