"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams (a shorter text is one n-gram of all its words); two are linked
if the Jaccard similarity is 0.8 or more.

1. Equal word sequences are one text, a node with a number of its own; doc_ids only name classes.
2. MinHash signatures of 80 values, cut into 20 bands: texts that agree in a band are candidates
   (a pair at the threshold is missed with probability 3e-5).
3. Candidates are compared 16 values at a time.  With a uniform prior, the posterior probability
   that the similarity reaches the threshold, after m of n equal values, is P(Bin(n + 1, t) <= m);
   pairs for which it falls below ``tolerance`` are dropped.
4. A pair belongs to the first band that both agree in.  A bucket passes on its texts that have a
   pair of their own left, and the task that takes them verifies these pairs exactly on whole sets.

No pair is ever a row.  Buckets of any size are cut into blocks, every pair of blocks is a task's
work, and a task returns one row for each of its texts: a link of a spanning forest, and its number
of links.  So a hot group is spread over many tasks, rows grow with documents, not with pairs, and
only candidates are compared: texts that are chained, but share no band, never meet.

Result: one row for each document with class_id, the smallest doc_id of its component of links,
and n_links, the number of other documents that it is linked to (copies count).  Defined results:
a text without a word is linked to nothing; rows of equal texts are copies, and different texts of
one doc_id, or of none, are different nodes; a null doc_id is given back as null, and class_id is
null if all of a class are null; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Workspace, even_join, map_arrow
from tessera.llm._words import Words, mix, segment_sum, slices, text_column
from tessera.llm.components import components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Texts, and n-grams, of a block; and pairs that a task holds at once.
BUCKET_BLOCK, BLOCK_GRAMS = 1024, 1 << 19
PAIRS = 1 << 19
NO_ID = -(2**63)

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_PLACES = mix(np.arange(101, 101 + N, dtype=np.uint64)) | np.uint64(1)
_EMPTY = np.uint32(0xFFFFFFFF)


def fewest_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The smallest m of n equal values at which a pair is kept."""
    total = 0.0
    for m in range(n + 2):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


_KEEP = [(n, fewest_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def grams(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-grams (not made distinct), and their bounds."""
    h = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    size = np.diff(words.bounds)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    full = np.repeat(size >= n, count)
    first = np.repeat(words.bounds[:-1] - bounds[:-1], count) + np.arange(len(out))
    at = first[full]
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        value += h[at + k] * _PLACES[k]
    out[full] = mix(value)
    for i in np.flatnonzero((size > 0) & (size < n)):
        a, b = words.bounds[i], words.bounds[i + 1]
        out[bounds[i]] = mix(np.array([(h[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64))[0]
    return out, bounds


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, HASHES for each text."""
    out = np.full((len(bounds) - 1, HASHES), _EMPTY, dtype=np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        start = bounds[:-1][some]
        for k, a in enumerate(_MULTIPLIERS):
            out[some, k] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), start)
    return out


def sequence_hash(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell word sequences apart."""
    h = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    place = (np.arange(len(h)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))).astype(np.uint64)
    out = []
    for salt in (0x51ED27, 0x7F4A7C):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + mix(place + np.uint64(salt))), dtype=np.uint64)])
        out.append(mix(total[words.bounds[1:]] - total[words.bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(17), text)


def _signed(docs: DataFrame) -> DataFrame:
    """_id, _t and _t2 (of the text), _s1, _s2, _n (n-grams) and _sig of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(text_column(part))
                h, bounds = grams(words)
                s1, s2 = sequence_hash(words)
                sig = signatures(h, bounds)
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": part.column(0),
                        "_t": part.column(2),
                        "_t2": part.column(3),
                        "_s1": s1,
                        "_s2": s2,
                        "_n": np.diff(bounds),
                        "_sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                    }
                )

    return map_arrow(docs, run, "_id long, _t long, _t2 long, _s1 long, _s2 long, _n long, _sig binary")


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of rows of sig survive, compared STEP values at a time."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for n, least in _KEEP:
        part = slice(n - STEP, n)
        matches = matches + (sig[a[alive], part] == sig[b[alive], part]).sum(axis=1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive


def block_pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within consecutive groups of the given sizes, PAIRS or a row's at a time."""
    ends = np.cumsum(sizes)
    # Row i of a group is paired with the rows after it.
    after = np.repeat(ends, sizes) - np.arange(int(ends[-1]) if len(ends) else 0) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    start = 0
    while start < len(after):
        stop = max(int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 1, start + 1)
        n = after[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        yield a, b
        start = stop


def forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, the smallest node of its component under the row pairs (a, b)."""
    root = nodes.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # One node may stand in several rows.
        order = np.argsort(nodes, kind="stable")
        first = np.flatnonzero(np.append(True, nodes[order][1:] != nodes[order][:-1])) if len(nodes) else order
        if len(first):
            least = np.minimum.reduceat(new[order], first)
            new[order] = np.repeat(least, np.diff(np.append(first, len(order))))
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole groups (equal _g, _i, _j) of a sorted stream, about ``rows`` rows, or a group, at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        ends, start = np.cumsum(_group_sizes(t))[:-1], 0  # the last group may go on
        while len(ends) and ends[-1] >= start + rows:
            stop = int(ends[np.searchsorted(ends, start + rows)])
            yield t.slice(start, stop - start)
            start = stop
        held, n = t.slice(start).to_batches(), t.num_rows - start
    if n:
        yield pa.Table.from_batches(held)


def _split(members: DataFrame, blocks: str, group: str, node: str) -> DataFrame:
    """Give each member the pairs of blocks (_i, _j) that it takes part in, and its block _b."""
    own = F.pmod(F.xxhash64(F.lit(41), F.col(node)), F.col(blocks)).cast("int")
    members = members.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return members.withColumns({"_g": F.col(group), "_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o")


def _pairs_of(t: pa.Table, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each group; of a pair of two blocks those across only."""
    own, i, j = (t.column(c).to_numpy() for c in ("_b", "_i", "_j"))
    across = i != j
    for a, b in block_pairs(sizes):
        good = ~across[a] | (own[a] != own[b])
        yield a[good], b[good]


def _signature_array(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("_sig").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _group_sizes(t: pa.Table) -> np.ndarray:
    k = [t.column(c).to_numpy() for c in ("_g", "_i", "_j")]
    new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in k]))
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _own_pairs(t: pa.Table, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows of each bucket (or pair of its blocks) that survive pruning and agree in no
    earlier band."""
    band = t.column("_band").to_numpy()
    for a, b in _pairs_of(t, _group_sizes(t)):
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            alive = prune(sig, x, y)
            x, y = x[alive], y[alive]
            equal = (sig[x] == sig[y]).reshape(len(x), BANDS, ROWS).all(axis=2)
            own = equal.argmax(axis=1) == band[x]
            yield x[own], y[own]


def _joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(np.empty(0, np.int64),) * 2, *pairs]
    return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket that have a pair of their own."""
    for t in _groups(batches, 4096):
        used = np.zeros(t.num_rows, bool)
        for x, y in _own_pairs(t, _signature_array(t)):
            used[x] = used[y] = True
        yield from t.drop_columns("_sig").filter(pa.array(used)).to_batches()


def exact(h: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of sets (distinct local ids h in bounds) reach the threshold."""
    size = np.diff(bounds)
    good = np.zeros(len(a), bool)
    mark = np.zeros(int(h.max()) + 1 if len(h) else 1, bool)
    order = np.argsort(a, kind="stable")
    cut = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else []
    for s, e in zip(cut, np.append(cut[1:], len(order)) if len(a) else []):
        i, rows = a[order[s]], order[s:e]
        own = h[bounds[i] : bounds[i + 1]]
        mark[own] = True
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            n = size[b[part]]
            ids = h[np.repeat(bounds[b[part]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            common = segment_sum(mark[ids].astype(np.int64), np.concatenate([[0], np.cumsum(n)]))
            good[part] = common >= THRESHOLD * (size[i] + n - common) - 1e-9
        mark[own] = False
    return good


def _verified_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of a group (or pair of its blocks): node, root there, copies linked."""
    for t in _groups(batches, 256):
        sig, node, copies = _signature_array(t), t.column("_node").to_numpy(), t.column("_copies").to_numpy()
        part = pa.RecordBatch.from_pydict({"text": t.column("text").combine_chunks()})
        h, bounds = grams(Words(text_column(part)))
        local = np.unique(h, return_inverse=True)[1].astype(np.int64)
        row = np.repeat(np.arange(t.num_rows), np.diff(bounds))
        pairs = np.unique(row * (len(h) + 1) + local)
        row, local = pairs // (len(h) + 1), pairs % (len(h) + 1)
        bounds = np.searchsorted(row, np.arange(t.num_rows + 1))
        links = np.zeros(t.num_rows, np.int64)
        found = []
        for x, y in _own_pairs(t, sig):
            good = exact(local, bounds, x, y)
            x, y = x[good], y[good]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            found.append((x, y))
        a, b = _joined(found)
        yield pa.RecordBatch.from_pydict({"u": node, "v": forest(node, a, b), "links": links})


def _known(c: str):
    """An _id, null for NO_ID."""
    return F.when(F.col(c) != NO_ID, F.col(c))


def _classes(ws: Workspace, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """_signed() of docs; and of each text with words _s1, _s2, _rep (its smallest id), _copies, _root, _class and _links."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    t, t2 = _text_hashes(F.col("text"))
    rows = rows.withColumn("_t", t)
    signed = ws.save(_signed(rows.withColumn("_t2", t2)), "signed")
    texts = signed.filter("_n > 0").groupBy("_s1", "_s2")
    texts = texts.agg(F.coalesce(F.min(_known("_id")), F.lit(NO_ID)).alias("_rep"), F.count("*").alias("_copies"))
    texts = ws.save(texts.withColumn("_node", F.monotonically_increasing_id()), "texts")
    of_text = texts.withColumnRenamed("_rep", "_id")
    reps = even_join(signed, of_text, ["_id", "_s1", "_s2"], "_copies", signed.count())
    reps = reps.groupBy("_node").agg(*[F.min(c).alias(c) for c in ("_id", "_t", "_n", "_copies", "_sig")], F.count("*").alias("_same"))
    reps = ws.save(reps, "reps")

    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("_sig", 1 + b * ROWS * 4, ROWS * 4)) for b in range(BANDS)])
    bands = reps.select("_node", "_n", F.posexplode(keys).alias("_band", "_key"))
    buckets = bands.groupBy("_key").agg(F.count("*").alias("_size"), F.sum("_n").alias("_grams")).filter("_size > 1")
    blocks = F.greatest(F.ceil(F.col("_size") / BUCKET_BLOCK), F.ceil(F.col("_grams") / BLOCK_GRAMS))
    buckets = ws.save(buckets.select("_key", "_size", blocks.alias("_blocks")), "buckets")
    total = reps.count() * BANDS
    members = even_join(bands.drop("_n"), buckets, ["_key"], "_size", total).join(reps.select("_node", "_sig"), "_node")
    members = _split(members, "_blocks", "_key", "_node").select("_g", "_i", "_j", "_b", "_band", "_node", "_sig")
    kinds = "_g long, _i int, _j int, _b int, _band int, _node long"
    found = ws.save(map_arrow(_by_group(members), _candidates, kinds), "candidates")

    # The text of each node that is left, once.
    needed = found.select("_node").distinct().join(reps.select("_node", "_id", "_t", "_copies", "_sig", "_same"), "_node")
    needed = ws.save(needed, "needed")
    texts_of = even_join(rows, needed, ["_id", "_t"], "_same", signed.count())
    if needed.filter("_same > 1").limit(1).count():
        texts_of = texts_of.groupBy("_node").agg(*[F.first(c).alias(c) for c in ("_copies", "_sig", "text")])
    split = found.join(texts_of.select("_node", "_copies", "_sig", "text"), "_node")
    links = ws.save(map_arrow(_by_group(split), _verified_links, "u long, v long, links long"), "links")
    linked = components(ws, links.select("u", "v"))
    by_node = links.groupBy(F.col("u").alias("_node")).agg(F.sum("links").alias("_links"))
    by_node = by_node.join(linked.select(F.col("node").alias("_node"), F.col("root").alias("_root")), "_node", "left")

    texts = texts.join(by_node, "_node", "left").withColumns(
        {
            "_root": F.coalesce("_root", "_node"),
            "_links": F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1,
        }
    )
    texts = ws.save(texts, "rooted")
    # Only classes of two texts or more need a name from elsewhere.
    names = texts.groupBy("_root").agg(F.min(_known("_rep")).alias("_class"), F.count("*").alias("_texts")).filter("_texts > 1")
    names = ws.save(names, "names")
    named = even_join(texts, names, ["_root"], "_texts", texts.count()).drop("_texts")
    alone = texts.join(names, "_root", "left_anti").withColumn("_class", _known("_rep"))
    return signed, ws.save(named.unionByName(alone), "classes")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of every row of docs."""
    signed, texts = _classes(Workspace(docs.sparkSession, "near"), docs, id_col, text_col)
    full = even_join(
        signed.filter("_n > 0").select("_id", "_s1", "_s2"), texts, ["_s1", "_s2"], "_copies", signed.count()
    ).select("_id", "_class", "_links")
    bare = signed.filter("_n = 0").select("_id", _known("_id").alias("_class"), F.lit(0).cast("long").alias("_links"))
    return full.unionByName(bare).select(
        _known("_id").alias("doc_id"), F.col("_class").alias("class_id"), F.col("_links").cast("long").alias("n_links")
    )


def _by_group(members: DataFrame) -> DataFrame:
    """Whole groups in a partition, next to each other."""
    return members.repartition("_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j", "_node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: of its smallest doc_id, and of several such rows that with the smallest
    text.  Rows without a word are linked to nothing and all stay.

    Rows are told apart by doc_id and the 128 bits of two hashes of the text, so that no text goes to
    Python again.
    """
    ws = Workspace(docs.sparkSession, "keep")
    signed, texts = _classes(ws, docs, id_col, text_col)
    # Nulls come last, as a class with a doc_id is named by it.
    best = F.min(F.struct((F.col("_rep") == NO_ID).alias("null"), "_rep", "_s1", "_s2")).alias("b")
    best = texts.groupBy("_root").agg(best).select("b._rep", "b._s1", "b._s2").withColumnRenamed("_rep", "_id")
    # An inner join (best has each key once): a semi join would be moved below the count of equal rows.
    sizes = signed.filter("_n > 0").groupBy("_id", "_s1", "_s2", "_t", "_t2").agg(F.count("*").alias("_tsr_n"))
    own = {c: f"_tsr{c}" for c in ("_id", "_s1", "_s2", "_t", "_t2")}
    best = ws.save(sizes.join(best, ["_id", "_s1", "_s2"]).withColumnsRenamed(own), "best")
    text = F.coalesce(F.col(text_col), F.lit(""))
    t, t2 = _text_hashes(text)
    rows = docs.withColumns({"_tsr_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_tsr_t": t, "_tsr_t2": t2})
    has_word = text.rlike(r"[^\x20\x09-\x0D]")
    kept = even_join(rows.filter(has_word), best, ["_tsr_id", "_tsr_t", "_tsr_t2"], "_tsr_n", signed.count())
    key = ["_tsr_id", "_tsr_s1", "_tsr_s2"]
    if best.groupBy(*key).agg(F.sum("_tsr_n").alias("n")).filter("n > 1").limit(1).count():
        whole = F.struct(*docs.columns)
        first = F.min_by(whole, F.struct(F.col(text_col), F.to_json(whole))).alias("_tsr_row")
        kept = kept.groupBy(*key).agg(first).select("_tsr_row.*")
    return kept.select(*docs.columns).unionByName(rows.filter(~has_word).select(*docs.columns))
