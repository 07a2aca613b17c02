"""Each operator on small documents with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    _fit,
    language_id,
    line_dedup,
    near_duplicates,
    oracles,
    packing,
    quality_gam,
    quality_rules,
    sharding,
    token_files,
    toxicity,
)
from tessera.llm._shared import Workspace
from tessera.llm._tokens import default_vocabulary, encoder
from tessera.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, shard int, _id int, label string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(1, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + (".\n" if r.random() < 0.06 else "") for _ in range(n))


def texts():
    base = [prose(80 + 7 * i, i) for i in range(14)]
    line = "this line of boilerplate is found in very many documents"
    long = prose(30_000, 99)
    near = base[3].split(" ")
    near[40] = "CHANGED"
    out = [*base, *[f"{line}\n{t}\n  {line.upper()} " for t in base[:8]], " ".join(near), base[5], base[5], base[5]]
    out += [None, "", " \n\t ", "\n\n", "one", "a b c", "¿ é　ü 🙂 \x0b x", "X X X X X X X", "| | |", long, "<|endoftext|> a  b", "q" * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, [None, "en", "fr"][i % 3], [None, "s1", "s1", "s2"][i % 4], 1, i, "x", i, i, "l") for i, t in enumerate(texts())]
    rows += [rows[2], rows[2], (6, "another text of doc 6", "en", "s1", 1, 0, "x", 0, 0, "l"), (None, "no id", "en", None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def oracle(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    return sorted(map(str, con.sql(sql).fetchall())), con.sql(sql).columns


def check_oracle(docs, got, sql):
    want, names = oracle(docs, sql)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want


def test_quality_rules(docs, empty):
    check_oracle(docs, quality_rules.judge(docs), oracles.QUALITY_RULES)
    assert quality_rules.judge(empty).count() == 0


def test_boilerplate_depletes(spark):
    shared = "\n".join(prose(8, 1000 + k).replace("\n", " ") for k in range(10))
    rows = [(i, f"{shared}\n{prose(20, i)}", "en", "h", 0, 0, "", 0, 0, "") for i in range(30)]
    rows += [(100 + i, prose(120, 500 + i), "en", "h", 0, 0, "", 0, 0, "") for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i] for i in range(30)) and all(got[100 + i] for i in range(30))


def test_lines_are_counted_by_documents_of_the_host(spark):
    line, mine = "this line stands in every document of the host", "this line stands in copies of a document only"
    rows = [(i, f"{line}\n{prose(5, i)}", "en", "h", 0, 0, "", 0, 0, "") for i in range(200)]
    rows += [(1000 + i, f"{line}\n{mine}\n{prose(60, 77)}", "en", "h", 0, 0, "", 0, 0, "") for i in range(100)]
    rows += [(i, f"{mine}\n{prose(60, i)}", "en", "other", 0, 0, "", 0, 0, "") for i in range(2000, 2010)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    n = len(line.split(" "))
    assert all(got[i].boilerplate_words >= n for i in range(200)) and got[2000].boilerplate_words == 0
    assert got[1000].boilerplate_words == got[1000].n_words
    check_oracle(docs, quality_rules.judge(docs), oracles.QUALITY_RULES)


def test_sharding(docs, empty):
    got = sharding.digest(sharding.shard(docs)).toPandas()
    n = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert n.max() - n.min() <= 1 and len(got) == docs.count()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    sizes = {(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.dropna(subset=["doc_id"]).collect()}
    assert {(int(r.doc_id), r.size, r.text_crc32) for r in got[["doc_id", "size", "text_crc32"]].dropna().itertuples(index=False)} == {tuple(s) for s in sizes}
    assert sharding.shard(empty).count() == 0


def test_sharding_oracle_and_mixture(spark, monkeypatch):
    rows = [(i, prose(3, i), "", "a" if i % 3 else "b", 0, 0, "", 0, 0, "") for i in range(600)]
    rows += [rows[7]] * 50 + [(None, f"text {i % 40}", "", "a", 0, 0, "", 0, 0, "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_oracle(docs, sharding.digest(sharding.shard(docs)), oracles.SHARDING)
    monkeypatch.setattr(sharding, "PART", 8)
    check_oracle(docs, sharding.digest(sharding.shard(docs)), oracles.SHARDING)
    share = sharding.shard(docs).filter("source = 'b'").groupBy("shard").count().toPandas()["count"]
    assert len(share) == 40 and share.max() - share.min() <= 1


def test_line_dedup(docs, empty):
    check_oracle(docs, line_dedup.digest(line_dedup.dedup(docs)), oracles.LINE_DEDUP)
    got = line_dedup.dedup(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == docs.count()
    assert got.agg({"n_dropped": "sum"}).first()[0] > 0
    assert line_dedup.dedup(empty).count() == 0


def test_line_runs_are_compacted_and_one_way(spark):
    ws = Workspace(spark, "test")
    runs = line_dedup.LineRuns(spark, ws, fan=2)
    line = "x" * 50
    for b in range(5):
        batch = spark.createDataFrame([(b, line + "\n" + str(b) * 60, "", "", 0, 0, "", 0, 0, "")], SCHEMA)
        assert line_dedup.keep_new(runs, batch).count() == (1 if b else 2)
    assert sum(len(x) for x in runs.levels) <= 3
    assert runs.keepers().count() == 6
    plan = spark._jvm.PythonSQLUtils.explainString(runs.without(line_dedup.line_keys(batch, 40))._jdf.queryExecution(), "simple")
    assert plan.count("SortMergeJoin") == sum(len(x) for x in runs.levels) and "Bucketed: true" in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_run")]


def test_lines_of_a_key_are_summed_before_they_move(spark, monkeypatch):
    seen, without = [], line_dedup.LineRuns.without

    def spy(self, rows, kept=False):
        out = without(self, rows, kept)
        if not kept:
            seen.append(spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple"))
        return out

    monkeypatch.setattr(line_dedup.LineRuns, "without", spy)
    line = "a line of more than forty characters that is in all rows"
    docs = spark.createDataFrame([(i, line, "", "", 0, 0, "", 0, 0, "") for i in range(200)], SCHEMA)
    assert line_dedup.dedup(docs).filter("n_dropped = 0").count() == 1
    assert len(seen) == 4 and all(plan.count("SortMergeJoin") == k for k, plan in enumerate(seen))
    assert not any("Aggregate" in plan for plan in seen)


def test_line_dedup_with_a_hot_line_hot_ids_and_any_number_of_batches(spark):
    hot, rare = "a line that stands in a third of all rows of the table", "a line that five documents hold, no more and no fewer"
    rows = [(i if i % 3 else None, f"{hot}\n{hot} \n{prose(9, i)}", "", "", 0, 0, "", 0, 0, "") for i in range(300)]
    rows += [(1000 + i, f"{prose(20, i)}\n{rare if i < 5 else ''}\n{hot.upper()}", "", "", 0, 0, "", 0, 0, "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 2, 7):
        check_oracle(docs, line_dedup.digest(line_dedup.dedup(docs, batches=n)), oracles.LINE_DEDUP)


def ids_of(text):
    return [*encoder(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_token_files(spark, docs, empty, tmp_path):
    store = token_files.write(docs, root=str(tmp_path / "store"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in store.documents().collect())
    at = 0
    rows = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    for r, g in zip(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)), got, strict=True):
        ids = ids_of(r.text)
        assert g == (at, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    content = token_files._load_files(spark, f"{tmp_path}/store/files").collect()
    f = token_files.TokenFile.of_bytes(bytes(max(content, key=lambda c: len(c[0]))[0]), store.dictionary())
    assert len(f.ids(len(f) - 1)) == f.index["n"][-1]
    with pytest.raises(ValueError):
        token_files.TokenFile.of_bytes(bytes(content[0][0]), b"another dictionary")
    assert token_files.write(empty, root=str(tmp_path / "none")).documents().count() == 0


def test_a_short_document_is_read_without_the_others(tmp_path):
    out = token_files.FileBuilder(b"", (0, 0))
    rows = [np.random.default_rng(k).integers(0, 50_000, 20 if k % 2 else 90_000).astype(np.uint32) for k in range(40)]
    for k, ids in enumerate(rows):
        out.add(k, ids)
    path = tmp_path / "file"
    path.write_bytes(out.done())
    f, read = token_files.TokenFile.open(str(path), b""), []
    source = f.read
    f.read = lambda at, n: read.append(n) or source(at, n)
    assert all((f.ids(k) == rows[k]).all() for k in (39, 1, 20))
    assert read[0] == int(f.index["size"][39]) < 200 and sum(read) < path.stat().st_size / 10


def test_token_files_split_a_hot_id(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"text {k % 700}") for k in range(2000)], "doc_id long, text string").repartition(8)
    store = token_files.write(docs, root=str(tmp_path / "store"))
    got = sorted((r.start, r.n_tokens) for r in store.documents().collect())
    assert got[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and len(got) == 2000
    assert token_files._load_files(spark, f"{tmp_path}/store/files").count() > 1


def test_packing(docs, empty):
    got = packing.pack(docs.coalesce(1), with_ids=True).toPandas()
    by_window = got.sort_values(["sequence_id", "offset"])
    assert (by_window.offset == by_window.groupby("sequence_id").length.cumsum() - by_window.length).all()
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 1024 and (filled < 1024).sum() <= 1
    assert got.length.sum() == sum(len(ids_of(r.text)) for r in docs.collect())
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    pieces = got[got.doc_id == 0].sort_values("start")
    assert [x for ids in pieces.ids for x in ids] == ids_of(texts()[0])
    assert packing.pack(empty).count() == 0


def test_open_windows_are_bounded():
    packer, r = packing.Packer(64, most_open=10), random.Random(1)
    sizes = [r.randint(33, 50) for _ in range(500)] + [700, 1]
    for k, n in enumerate(sizes):
        packer.add((k, n), np.arange(n) + 1000 * k)
        assert sum(map(len, packer.open.values())) == packer.n_open < 10
        assert all(packer.levels.count[level] == len(w) for level, w in packer.open.items())
    packer.finish()
    pieces, filled = collections.defaultdict(list), collections.Counter()
    for (k, _), start, ids, window, offset in packer.rows:
        assert offset == filled[window]
        filled[window] += len(ids)
        pieces[k].append((start, list(ids)))
    assert max(filled.values()) <= 64 and sum(n < 64 for n in filled.values()) <= 1
    for k, n in enumerate(sizes):
        assert [x for _, ids in sorted(pieces[k]) for x in ids] == list(range(1000 * k, 1000 * k + n))


def test_sum_of_squares_takes_the_best_level():
    r = random.Random(1)
    levels = packing.SumOfSquares(16)
    for _ in range(400):
        n, count = r.randint(1, 15), levels.count.copy()

        def cost(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            return int((c[1:16] ** 2).sum())

        options = [h for h in range(17 - n) if h == 0 or count[h]]
        best = min(options, key=lambda h: (cost(h), -h))
        assert levels.place(n) == best


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = collections.Counter(), list(range(len(rows)))

    def find(a):
        return a if root[a] == a else find(root[a])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, least[find(a)], links[a]) for a, (i, _) in enumerate(rows))


def near_copies(n, words, edits, seed):
    r = random.Random(seed)
    base = [r.choice(VOCAB) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = r.choice(VOCAB)
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, docs, empty, monkeypatch):
    found = near_copies(60, 120, 4, 1) + near_copies(10, 300, 2, 2) + near_copies(3, 4, 0, 3) + [prose(60, k) for k in range(20)] + ["", None]
    rows = list(enumerate(found))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates.join(df).collect()) == brute_links(rows)
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", 8)
    assert sorted(tuple(r) for r in near_duplicates.join(df).collect()) == brute_links(rows)
    kept = near_duplicates.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_links(rows)})


def test_near_duplicates_edges(docs, empty):
    got = near_duplicates.join(docs)
    assert got.count() == docs.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[None].n_links == 0 and by_id[30 * 3 - 12].n_links >= 0
    assert near_duplicates.join(empty).count() == 0
    assert near_duplicates.keep_one(docs).columns == docs.columns


def test_near_duplicates_without_ids_or_with_repeated_ids(spark):
    texts = [prose(60, 3000 + k) for k in range(12)]
    near = texts[0].split(" ")
    near[-1] = "changed"
    rows = [(None, t) for t in texts[:6]] + [(7, texts[1]), (8, " ".join(near)), (9, texts[6]), (9, texts[7]), (10, texts[7]), (9, texts[6])]
    rows += [(None, ""), (None, None), (11, ""), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in near_duplicates.join(df).collect())
    want = [(None, 8, 1), (None, 7, 1), *[(None, None, 0)] * 4, (7, 7, 1), (8, 8, 1), (9, 9, 1), (9, 9, 1), (9, 9, 1), (10, 9, 1)]
    assert got == collections.Counter([*want, (None, None, 0), (None, None, 0), (11, 11, 0), (11, 11, 0)])
    kept = collections.Counter(tuple(r) for r in near_duplicates.keep_one(df).collect())
    want = [*[(None, t) for t in texts[2:6]], (7, texts[1]), (8, " ".join(near)), (9, texts[6]), (9, texts[7])]
    assert kept == collections.Counter([*want, (None, ""), (None, None), (11, ""), (11, "")])


def test_keep_one_of_rows_that_differ_in_white_space_only(spark):
    text = prose(60, 77)
    rows = [(5, text + " "), (5, text), (5, text), (6, text), (None, "  " + text), (7, " \t\n"), (7, "\x0b"), (8, "\u00a0")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _t long")
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns
    want = [(5, text), (7, " \t\n"), (7, "\x0b"), (8, "\u00a0")]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(want)


def test_near_duplicates_on_all_documents(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = [shingles(r["text"]) for r in rows]
    holders = collections.defaultdict(list)
    for k, x in enumerate(sets):
        for g in x:
            holders[g].append(k)
    links, root = collections.Counter(), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in enumerate(sets):
        common = collections.Counter(b for g in x for b in holders[g] if b < a)
        for b, n in common.items():
            if n >= 0.8 * (len(x) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"], least[find(k)], links[k]) for k, r in enumerate(rows))
    got = near_duplicates.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_chained_texts_are_compared_with_their_neighbours_only(spark, tmp_path, monkeypatch):
    # Each text shares most words with the next ones and nothing with those further on.
    r = random.Random(2)
    stream = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(3000 * 4 + 120)]
    rows = [(k, " ".join(stream[4 * k : 4 * k + 120])) for k in range(3000)]
    compared = []
    exact = near_duplicates.exact
    monkeypatch.setattr(near_duplicates, "exact", lambda h, bounds, a, b: compared.append(len(a)) or exact(h, bounds, a, b))
    local = lambda df, function, schema: spark.createDataFrame(
        pa.Table.from_batches(function(iter(df.toArrow().to_batches()))).to_pandas(), schema
    )
    monkeypatch.setattr(near_duplicates, "map_arrow", local)
    got = near_duplicates.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x.class_id for x in got}) == 1 and sum(x.n_links for x in got) == 2 * sum(3000 - d for d in (1, 2, 3))
    assert sum(compared) < 12 * len(rows)
    # In small blocks it takes fewer rows to leave the pairs in their buckets.
    compared.clear()
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", 64)
    assert sorted(near_duplicates.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(got)
    assert sum(compared) < 12 * len(rows)


def test_posterior_bound():
    for n, least in near_duplicates._KEEP:
        below = sum(near_duplicates.math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(least))
        assert below < near_duplicates.TOLERANCE


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for p in pairs for x in p}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in pairs for x in (a, b) if a != b}
    got = {tuple(r) for r in components(Workspace(spark, "cc"), spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == want


def test_what_is_no_letter():
    assert [_fit.letters(w) for w in ("½²Ⅷ٣", "Añ9_B", "x\u0301y")] == ["    ", "añ  b", "x y"]


def test_nothing_learned_keeps_all_documents(docs):
    known = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(known).count() == docs.count()


def test_classifiers_on_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i * 3, i % 2, (i + 1) % 2) for i in range(20)] + [(3, None, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_gam):
        for some, known in ((docs, labels), (docs, labels.limit(0)), (empty, labels)):
            got = module.predict(some, module.train(some, known)).toPandas()
            assert len(got) == some.count() and got.score.between(0, 1).all()
    got = language_id.predict(docs, language_id.train(docs)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert set(got[got.doc_id.isin([26 * 3, 27 * 3, 28 * 3])].lang_pred) == {"und"}
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert set(language_id.predict(docs, None).toPandas().lang_pred) == {"und"}
    assert language_id.keep_identified(docs).columns == docs.columns


def test_held_out_accuracy(spark):
    from tessera.llm._shared import documents, table

    folder = "/root/testdata/sf0.01"
    docs = documents(spark, folder)
    got = language_id.predict(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 3 == 1}
    assert (held.lang == held.lang_pred).mean() > 0.98
    labels = table(spark, folder, "labels")
    got = quality_gam.predict(docs, quality_gam.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_toxic_misspellings_share_n_grams():
    r = random.Random(4)
    bad = ["horribleword", "vilething", "nastystuff"]
    rows = [(" ".join(r.choice(VOCAB) for _ in range(r.randint(5, 300))), 0) for _ in range(300)]
    rows += [(f"{t} {r.choice(bad)} {u}", 1) for (t, _), (u, _) in zip(rows[:100], rows[100:])]
    model = toxicity.fit(pa.array([t for t, _ in rows], pa.large_string()), np.array([y for _, y in rows]))
    test = [prose(60, 700 + k).replace("\n", " ") for k in range(20)]
    clean = model.score(pa.array(test, pa.large_string()))
    toxic = model.score(pa.array([f"{t} horrriblewords {t}" for t in test], pa.large_string()))
    assert (toxic > clean).mean() > 0.9


def test_pipeline(spark):
    import corpus_pipeline
    from tessera.llm._shared import documents

    folder = "/root/testdata/sf0.001"
    docs, ws = documents(spark, folder), Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = ws.save(stage(spark, docs, folder), name)
        assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, folder).agg({"length": "sum"}).first()[0] == sum(len(ids_of(r.text)) for r in docs.collect())


def test_sample_ids_are_the_smallest_hashes_of_each_label(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("label"))
    by_hash = {}
    for r in rows.withColumn("h", F.xxhash64(F.lit(29), F.col("doc_id"))).collect():
        by_hash.setdefault(r["label"], []).append((r["h"], r["doc_id"]))
    want = {(i, label) for label, x in by_hash.items() for _, i in sorted(x)[: 20 if label == "a" else 50]}
    got = _fit.sample_ids(rows.union(rows), lambda label: 20 if label == "a" else 50).collect()
    assert len(got) == 70 and {tuple(r) for r in got} == want
    both = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "b")], "doc_id long, label string")
    assert {tuple(r) for r in _fit.sample_ids(both, lambda label: 5).collect()} == {(1, "a"), (2, "b")}
    assert _fit.sample_ids(both.limit(0), lambda label: 5).collect() == []
