"""The classifiers against plain scoring of one text at a time, and what they may learn from."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, quality_gam, toxicity
from tessera.llm._fit import letters
from tessera.llm._shared import documents, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def grams(word, lengths, buckets):
    """Buckets of the n-grams of a word between blanks: none inside, and not only blanks."""
    s = [32, *(32 if c == " " else ord(c) for c in word), 32]
    out = []
    for n in lengths:
        for k in range(len(s) - n + 1):
            x = s[k : k + n]
            if 32 in x[1:-1] or all(c == 32 for c in x):
                continue
            h = n
            for c in x:
                h = (h * 0x100000001B3 + c) & M64
            out.append(mix(h) & buckets - 1)
    return out


def texts(n, seed):
    r = random.Random(seed)
    alphabets = ["abcdefg", "éñüabc", "жзийкл", "#$%a9½"]
    out = ["", " \n ", "½ ² Ⅷ", "one", "X" * 300]
    for _ in range(n):
        a = r.choice(alphabets)
        out.append(" ".join("".join(r.choice(a) for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 90))))
    return out


def column(x):
    return pa.array(x, pa.large_string())


def test_language_scores_one_text_at_a_time():
    r = random.Random(1)
    rows = [(" ".join("".join(r.choice(a) for _ in range(5)) for _ in range(30)), lang) for lang, a in (("x", "abcde"), ("y", "abfgé"), ("z", "жзик")) for _ in range(40)]
    model = language_id.fit(column([t for t, _ in rows]), [y for _, y in rows])
    some = texts(60, 2)
    logits, n = model.logits(column(some))
    for k, t in enumerate(some):
        ids = [g for w in WORD.findall(t) for g in grams(letters(w), language_id.LENGTHS, language_id.BUCKETS)]
        assert n[k] == len(ids)
        for j in range(3):
            mean = sum(model.weights[g, j] for g in ids) / max(len(ids), 1)
            assert logits[k, j] == pytest.approx((mean + model.bias[j]) / model.temperature, abs=1e-6)


def test_toxicity_scores_one_text_at_a_time():
    r = random.Random(3)
    rows = [("fine words " * r.randint(1, 30) + ("horrid" if k % 3 == 0 else "good"), int(k % 3 == 0)) for k in range(90)]
    model = toxicity.fit(column([t for t, _ in rows]), np.array([y for _, y in rows]), rounds=1, steps=10)
    some = texts(60, 4)
    got = model.score(column(some))
    for k, t in enumerate(some):
        value = []
        for w in WORD.findall(t):
            ids = grams(w.lower(), toxicity.LENGTHS, toxicity.BUCKETS)
            value.append(sum(float(model.weight[g]) for g in ids) / max(len(ids), 1))
        n, size, stride = len(value), toxicity.WINDOW, toxicity.STRIDE
        starts = {min(s, max(n - size, 0)) for s in range(0, max(n - size, 0) + stride, stride)}
        best = max(sum(value[s : s + size]) / max(min(n, size), 1) for s in starts) + model.bias
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(model.slope * best + model.shift))), abs=1e-5)


def test_quality_scores_one_text_at_a_time():
    r = random.Random(5)
    rows = [(" ".join(r.choice(["a", "tree", "Falls", "##", "9"]) if k % 2 else "x" for _ in range(r.randint(1, 80))), k % 2) for k in range(200)]
    x = quality_gam.features(column([t for t, _ in rows]))
    model = quality_gam.fit(x, np.array([y for _, y in rows], float), rounds=10, pair_rounds=5)
    some = texts(60, 6)
    batch = quality_gam.features(column(some))
    got = model.score(batch)
    for k, t in enumerate(some):
        alone = quality_gam.features(column([t]))[0]
        assert alone == pytest.approx(batch[k], abs=1e-9)
        total = model.bias
        for j, edges in enumerate(model.edges):
            total += model.tables[j][sum(alone[j] >= e for e in edges)]
        for i, j, cells in model.pairs:
            total += cells[sum(alone[i] >= e for e in model.pair_edges[i]), sum(alone[j] >= e for e in model.pair_edges[j])]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def held(i, of, k):
    return zlib.crc32(str(i).encode()) % of == k


def test_labels_of_held_out_rows_are_never_learned(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = documents(spark, folder), table(spark, folder, "labels")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    for module, name, of, k in ((toxicity, "toxic", 4, 2), (quality_gam, "quality", 3, 1)):
        changed = labels.withColumn(name, F.when(crc % of == k, 1 - F.col(name)).otherwise(F.col(name)))
        a = module.predict(docs, module.train(docs, labels)).toPandas().sort_values("doc_id", ignore_index=True)
        b = module.predict(docs, module.train(docs, changed)).toPandas().sort_values("doc_id", ignore_index=True)
        assert a.equals(b) and set(a[a.held_out].doc_id) == {i for i in a.doc_id if held(i, of, k)}
        assert (a.predicted == (a.score >= module.THRESHOLD)).all()
    changed = docs.withColumn("lang", F.when(crc % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language_id.predict(d, language_id.train(d)).toPandas().sort_values("doc_id", ignore_index=True) for d in (docs, changed))
    assert a.equals(b)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = documents(spark, folder), table(spark, folder, "labels").filter("toxic is not null")
    got = toxicity.predict(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.toxic == 0].score.to_numpy(), got[got.toxic == 1].score.to_numpy()
    auc = (np.searchsorted(np.sort(good), bad, "left") + np.searchsorted(np.sort(good), bad, "right")).mean() / 2 / len(good)
    # Few toxic labels to learn from: 329 here.
    assert auc > 0.92 and (bad >= toxicity.THRESHOLD).mean() > 0.65 and (good >= toxicity.THRESHOLD).mean() < 0.06


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, size int, _id int, label string, item_id long"
    r = random.Random(8)
    words = ["the", "house", "stands", "near", "rivers", "and", "old", "trees", "grow", "there"]
    prose = [" ".join(r.choice(words) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(60)) for _ in range(30)]
    rows = [(k, t, "en" if k % 4 else None, None, None, 1, 2, "l", 3) for k, t in enumerate(prose)]
    rows += [rows[3], (None, prose[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (99, "", "en", "s", 0, 0, 0, "", 0)]
    docs, folder = spark.createDataFrame(rows, kinds), "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {x.text for x in docs.collect()} == set(prose) and docs.count() == len(prose)
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs, folder).count() >= 1 and packed(spark, docs.limit(0), folder).count() == 0
