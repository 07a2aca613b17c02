"""Decontamination against a search of every stretch of every document."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]


def best_stretch(item, words):
    """The fewest edits between the item and any stretch of words: an edit table with a free start and a free end."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(item, kind, n, r):
    w = list(item)
    places = sorted(r.sample(range(len(item)), n), reverse=True)
    for k, at in enumerate(places):
        do = r.choice(["spread", "deleted", "inserted"]) if kind == "mixed" else kind
        if kind == "alternating":
            w[2 * k + 1] = f"new{r.randrange(10**6)}"
        elif do == "deleted":
            del w[at]
        elif do == "inserted":
            w.insert(at, f"new{r.randrange(10**6)}")
        else:
            w[at] = f"new{r.randrange(10**6)}"
    return w


def column(texts):
    return pa.array(texts, pa.large_string())


KINDS = ["mixed", "alternating", "spread", "deleted", "inserted"]


@pytest.mark.parametrize("size,n", [(5, 60), (6, 60), (9, 60), (15, 60), (20, 60), (45, 40), (80, 30), (1000, 3)])
@pytest.mark.parametrize("kind", KINDS)
def test_recall_with_all_edits_that_are_allowed(size, n, kind):
    r = random.Random(f"{size}-{kind}")
    items = [[r.choice(VOCAB) + r.choice(VOCAB) for _ in range(size)] for _ in range(n)]
    index = decontamination.Benchmark(list(range(n)), [" ".join(x) for x in items])
    assert index.sizes[0].recall >= decontamination.TARGET_RECALL or index.sizes[0].exact
    texts = []
    for item in items:
        around = [[r.choice(VOCAB) for _ in range(r.randint(0, 60))] for _ in range(2)]
        texts.append(" ".join(around[0] + edited(item, kind, decontamination.edits_of(size), r) + around[1]))
    got = {(d, i) for d, i, *_ in index.search([column(texts)])}
    assert len(got & {(k, k) for k in range(n)}) >= 0.95 * n


def test_equals_a_search_of_every_stretch():
    r = random.Random(9)
    items = [[r.choice(VOCAB[:120]) for _ in range(n)] for n in (5, 5, 6, 8, 10, 12, 15, 15, 20, 30, 45)]
    texts = []
    for d in range(250):
        words = [r.choice(VOCAB[:120]) for _ in range(r.randint(0, 90))]
        if d % 4:
            item = r.choice(items)
            n = decontamination.edits_of(len(item)) + r.randint(-2, 1)
            at = r.randint(0, len(words))
            words[at:at] = edited(item, r.choice(KINDS), max(0, min(n, len(item) // 2 - 1)), r)
        texts.append(words)
    want = {}
    for d, words in enumerate(texts):
        for k, item in enumerate(items):
            e = best_stretch(item, words)
            if e <= decontamination.edits_of(len(item)):
                want[d, k] = e
    index = decontamination.Benchmark(list(range(len(items))), [" ".join(x) for x in items])
    for exact in (False, True):
        for x in index.sizes:
            x.exact = x.exact or exact
        found = index.search([column([" ".join(x) for x in texts[:100]]), column([" ".join(x) for x in texts[100:]])])
        got = {(d, k): e for d, k, _, _, e in found}
        assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
        assert not exact or got == want
        assert all(e >= want[x] for x, e in got.items()) and sum(got[x] == want[x] for x in got) >= 0.97 * len(got)
        for d, k, start, n, e in found:
            words = texts[d][start : start + n]
            row = best_stretch(items[k], words)
            assert row <= e


@pytest.mark.parametrize("size", [5, 9, 10, 15, 19, 30])
def test_proposes_starts_with_edits_at_an_items_first_words(size, monkeypatch):
    # Every item is a candidate, so what is missed the count before the LSH has left out.
    everything = lambda self, x: np.column_stack([a.ravel() for a in np.mgrid[: len(x), : len(self.words)]])
    monkeypatch.setattr(decontamination.SizeIndex, "candidates", everything)
    r = random.Random(size)
    items = [[f"w{r.randrange(10**6)}" for _ in range(size)] for _ in range(30)]
    index = decontamination.Benchmark(list(range(30)), [" ".join(x) for x in items])
    for k, item in enumerate(items):
        words = list(item)
        for e in range(decontamination.edits_of(size)):
            words[2 * e + 1] = f"edited{e}"
        text = " ".join([f"before{j}" for j in range(20)] + words + [f"after{j}" for j in range(20)])
        assert (0, k, 20, size, decontamination.edits_of(size)) in index.search([column([text])])


def test_distances():
    r = np.random.default_rng(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row), row.index(min(row))

    a, b = r.integers(1, 5, (300, 7)).astype(np.uint64), r.integers(1, 5, (300, 10)).astype(np.uint64)
    got = decontamination.distances(a, b)
    assert list(zip(*(x.tolist() for x in got))) == [plain(list(x), list(y)) for x, y in zip(a, b)]


def test_on_tables(spark):
    r = random.Random(3)
    items = [" ".join(r.choice(VOCAB) for _ in range(n)) for n in (6, 12, 20, 30, 45)] + [None, "", "too short"]
    bench = spark.createDataFrame([*enumerate(items), (None, items[2])], "item_id long, text string")
    rows, want = [], set()
    for d in range(60):
        words = [r.choice(VOCAB) + "zz" for _ in range(r.randint(0, 200))]
        if d % 2:
            k = r.randrange(5)
            at = r.randint(0, len(words))
            words[at:at] = [f"{w.upper()}," for w in edited(items[k].split(" "), "spread", 1, r)]
            want |= {(d, k)} | ({(d, None)} if k == 2 else set())
        rows.append((d, " ".join(words), "x"))
    found = sorted(d for d, k in want if k is not None)
    rows += [(None, None, "x"), (77, "", "x"), (None, items[0], None), (1, rows[1][1], "again")]
    want.add((None, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for block in (2, 100):
        got = [(r.doc_id, r.item_id) for r in decontamination.find(df, bench, block=block).collect()]
        assert set(got) == want and len(got) == len(want) + len([w for w in want if w[0] == 1])
        left = decontamination.remove(df, bench, block=block)
        assert left.columns == df.columns
        assert sorted(x.doc_id for x in left.collect() if x.doc_id is not None) == sorted({*range(60), 77} - set(found))
    assert decontamination.find(df, bench.limit(0)).count() == 0 and decontamination.find(df.limit(0), bench).count() == 0
    assert decontamination.remove(df, bench.limit(0)).count() == len(rows)
