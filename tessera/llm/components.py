"""Connected components of a graph given by edges, in the shared folder and never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Workspace, even_join


def _to_minimum(edges: DataFrame, both: bool, total: int) -> DataFrame:
    """Join each edge (u, v) with m, the smallest of u and its neighbours v."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n"))
    return even_join(edges, mins, ["u"], "n", total)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Alternates large-star and small-star steps, which end with a star around each smallest node
    after a number of rounds that grows with the logarithm of the nodes.  Every round is written,
    so a lost executor costs at most a round's tasks.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = ws.save(edges.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        joined = _to_minimum(edges, True, 2 * before[0]).filter("v > u and v <> m")
        large = ws.save(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        joined = _to_minimum(large, False, before[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(joined.select("u", F.col("m").alias("v")))
        small = ws.save(small.distinct(), "small")
        ws.drop(edges)
        ws.drop(large)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
