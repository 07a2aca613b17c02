"""The nested-loop join by blocks, against pairs compared one by one."""

import math
import re

import pytest

from tessera.operators import joins
from tessera.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def found(df):
    return sorted(map(repr, df.collect()))


def values(df):
    return [tuple(r) for r in df.collect()]


def test_join_nl_compares_no_product_of_the_tables(spark):
    text = plan(registry.QUERIES["join_nl"](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pairs_are_compared_within_blocks_that_grow_in_number_with_the_inner_side(spark):
    outer, inner = spark.range(100).toDF("x"), spark.range(10_000).toDF("y")
    join = joins.nested_loop(outer, inner, {"x": "y"})
    merged = re.search(r"SortMergeJoin \[(\w+)#\w+\], \[(\w+)#\w+\], Inner, (.*)", plan(join))
    assert merged[1] == "_outer_block" and merged[2] == "_inner_block" and ">=" in merged[3] and "<=" in merged[3]
    assert f", {10_000 // joins.BLOCK + 1})" in plan(join)
    assert sorted(values(join)) == [(k, k) for k in range(100)]


@pytest.mark.parametrize("block", [1, 3, 10**6])
def test_nulls_repeated_keys_and_odd_numbers(spark, block):
    keys = [None, 0.0, -0.0, math.nan, math.inf, -1.5, 7.0, 7.0, 7.0, 8.0]
    outer = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "a double, i int")
    inner = spark.createDataFrame([(k, -i) for i, k in enumerate(keys * 2)], "b double, j int")
    got = values(joins.nested_loop(outer, inner, {"a": "b"}, block))
    want = [(*x, *y) for x in values(outer) for y in values(inner) if None not in (x[0], y[0]) and (x[0] == y[0] or math.isnan(x[0]) and math.isnan(y[0]))]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 2 * (4 + 1 + 1 + 1 + 9 + 1)


def test_types_that_compare_and_more_keys_than_one(spark):
    outer = spark.createDataFrame([(k % 50, str(k % 3), k) for k in range(300)] + [(1, None, -1), (None, "1", -2)], "a int, s string, i long")
    inner = spark.createDataFrame([(float(k % 60), str(k % 2), k) for k in range(300)] + [(1.0, None, -1)], "b double, t string, j long")
    got = values(joins.nested_loop(outer, inner, {"a": "b", "s": "t"}))
    want = [(*x, *y) for x in values(outer) for y in values(inner) if None not in (x[0], x[1], y[0], y[1]) and x[0] == y[0] and x[1] == y[1]]
    assert sorted(got) == sorted(want) and want


def test_empty_sides(spark):
    some, none = spark.range(5).toDF("x"), spark.range(0).toDF("y")
    assert joins.nested_loop(some, none, {"x": "y"}).count() == 0
    assert joins.nested_loop(none, some, {"y": "x"}).count() == 0


def test_a_key_with_most_rows_of_both_sides(spark):
    outer = spark.range(4000).selectExpr("if(id % 4 = 0, id, 7) AS x", "id AS i")
    inner = spark.range(500).selectExpr("if(id % 5 = 0, 7, id) AS y", "id AS j")
    got = joins.nested_loop(outer, inner, {"x": "y"})
    assert found(got.select("x", "i", "y", "j")) == found(outer.join(inner.hint("shuffle_replicate_nl"), outer.x == inner.y))
