"""Named queries over the test tables and the SQL that each is compared with.

A query is written once in the engine's dialect and runs through its rewriter; where DuckDB needs
other words for the same meaning, a second text is given.  Queries that Spark's DataFrame API or
the engine expresses better are functions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changelog, joins, locks, stats, versions
from tessera.plans.dialect import rewrite
from tessera.sources.tables import NAMES, read, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    used = [t for t in NAMES if re.search(rf"\b{t}\b", text)]
    QUERIES[name] = lambda spark, folder: views(spark, folder, used).sql(rewrite(text))
    ORACLE_SQL[name] = oracle or text


def _query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Scan and projection
_sql("scan_all_nation", "SELECT * FROM nation")
_sql("project_exprs_lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_sql("alias_columns", "SELECT n.n_name AS nation_name, n.n_regionkey AS region FROM nation AS n")
_sql("table_star", "SELECT n.*, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey")
_sql("select_no_from", "SELECT 1 + 2 * 3 AS a, 'x' AS b, 7 / 2 AS c")
_sql("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 100")

# Filters
_L = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
_sql("filter_eq", _L + "l_returnflag = 'R'")
_sql("filter_ne", _L + "l_returnflag <> 'N'")
_sql("filter_range", _L + "l_quantity >= 10 AND l_quantity < 20")
_sql("filter_and_or_not", _L + "(l_returnflag = 'A' OR l_linestatus = 'O') AND NOT l_quantity > 25")
_sql("filter_between", _L + "l_quantity BETWEEN 5 AND 7")
_sql("filter_not_between", _L + "l_quantity NOT BETWEEN 5 AND 45")
_sql("filter_in_list", _L + "l_linenumber IN (1, 3, 5)")
_sql("filter_not_in_list", _L + "l_linenumber NOT IN (1, 2, 3)")
_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'")
_sql("filter_not_like", "SELECT p_partkey, p_name FROM part WHERE NOT p_name LIKE 'a%'")
_D = "SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE "
_sql("filter_is_null", _D + "l.quality IS NULL")
_sql("filter_is_not_null", _D + "l.quality IS NOT NULL")
_sql("filter_two_valued", _D + "COALESCE(l.quality = 1, FALSE)")

# Scalars
_sql("arith_ops", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, p_size / 4 AS d FROM part")
_sql("div_by_zero_null", "SELECT p_partkey, p_size / (p_size - 10) AS q FROM part", "SELECT p_partkey, p_size / nullif(p_size - 10, 0) AS q FROM part")
_sql(
    "modulo_floor",
    "SELECT p_partkey, (p_size - 25) % 7 AS a, (p_size - 25) % -7 AS b, p_size % (p_size - 10) AS c FROM part",
    "SELECT p_partkey, CAST((p_size - 25) - 7 * floor((p_size - 25) / 7) AS INT) AS a, CAST((p_size - 25) + 7 * floor((p_size - 25) / -7) AS INT) AS b, "
    "CAST(p_size - (p_size - 10) * floor(p_size / nullif(p_size - 10, 0)) AS INT) AS c FROM part",
)
_sql("unary_neg", "SELECT s_suppkey, -s_acctbal AS a, -(s_nationkey + 1) AS b FROM supplier")
_sql("concat_text", "SELECT n_nationkey, n_name || '/' || n_name AS a FROM nation")
_sql("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part")
_sql("case_no_else", "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size END AS size FROM part")
_sql("cast_int_trunc", "SELECT c_custkey, CAST(c_acctbal AS INT) AS a FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS a FROM customer")
_sql("cast_text", "SELECT c_custkey, CAST(c_custkey AS TEXT) AS a, CAST(CAST(c_custkey AS TEXT) AS REAL) AS b FROM customer", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, CAST(c_custkey AS DOUBLE) AS b FROM customer")
_sql("coalesce", "SELECT d.doc_id, COALESCE(l.quality, -1) AS q FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
_sql("nullif", "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation")
_sql("ifnull", "SELECT n_nationkey, IFNULL(NULLIF(n_regionkey, 1), 99) AS r FROM nation")
_sql(
    "null_logic_3vl",
    "SELECT n_nationkey, NULLIF(n_regionkey, 1) = 2 AS a, NULLIF(n_regionkey, 1) = 2 OR n_nationkey > 10 AS b, "
    "NULLIF(n_regionkey, 1) = 2 AND n_nationkey > 10 AS c, NOT (NULLIF(n_regionkey, 1) = 2) AS d FROM nation",
)


_sql(
    "cast_bool",
    "SELECT p_partkey, CAST(p_brand AS BOOL) AS a, CAST(p_size - 1 AS BOOL) AS b, CAST('yes' AS BOOL) AS c, CAST('abc' AS BOOL) AS d, CAST(NULL AS BOOL) AS e FROM part",
    "SELECT p_partkey, upper(p_brand) IN ('TRUE', '1', 'YES') AS a, p_size <> 1 AS b, TRUE AS c, FALSE AS d, CAST(NULL AS BOOLEAN) AS e FROM part",
)
_sql(
    "div_after_case",
    "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size ELSE 1 END / (p_size - 10) AS q, (p_size + 1) % CASE WHEN p_size > 20 THEN 0 ELSE 3 END AS r FROM part",
    "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size ELSE 1 END / nullif(p_size - 10, 0) AS q, CASE WHEN p_size <= 20 THEN (p_size + 1) % 3 END AS r FROM part",
)


# Joins
_CO = "SELECT c.c_custkey, o.o_orderkey FROM customer AS c {} JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) AS o ON "
for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    _sql(f"join_{_kind.lower()}", _CO.format(_kind) + "c.c_custkey = o.o_custkey AND c.c_nationkey < 20")
    _sql(
        f"join_theta_{_kind.lower()}",
        f"SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation AS a {_kind} JOIN region AS b ON a.n_regionkey < b.r_regionkey AND a.n_nationkey > 3",
    )
_sql("join_cross", "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n CROSS JOIN region AS r")
_sql("join_comma", "SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey")
_sql(
    "join_multi_key",
    "SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
)
_sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
_sql(
    "join_3way",
    "SELECT c.c_custkey, n.n_name, r.r_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey",
)
_sql(
    "join_4way",
    "SELECT l.l_orderkey, l.l_linenumber, c.c_name, s.s_name FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN supplier AS s ON l.l_suppkey = s.s_suppkey",
)
_sql(
    "join_null_keys",
    "SELECT a.n_nationkey, b.r_name FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) AS a "
    "FULL JOIN (SELECT r_name, NULLIF(r_regionkey, 2) AS k FROM region) AS b ON a.k = b.k",
)
_HINTED = "SELECT {} c.c_custkey, o.o_orderkey FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000"
for _name, _hint in (("broadcast", "BROADCAST(o)"), ("merge", "MERGE(o)"), ("shuffle_hash", "SHUFFLE_HASH(o)")):
    _sql(f"join_{_name}", _HINTED.format(f"/*+ {_hint} */"), _HINTED.format(""))


@_query(_HINTED.format(""))
def join_nl(spark: SparkSession, folder: str) -> DataFrame:
    """By blocks, as the hint SHUFFLE_REPLICATE_NL compares each customer with each order."""
    orders = read(spark, folder, "orders").filter("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    pairs = joins.nested_loop(orders, read(spark, folder, "customer").select("c_custkey"), {"o_custkey": "c_custkey"})
    return pairs.select("c_custkey", "o_orderkey")


# Aggregates
_sql("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
_sql("agg_count_col", "SELECT COUNT(l.quality) AS n, COUNT(*) AS m FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
_sql("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
_sql("agg_sum_distinct", "SELECT SUM(DISTINCT p_size) AS s FROM part", "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s FROM part")
_sql("agg_sum", "SELECT ROUND(SUM(l_extendedprice), 2) AS s, SUM(l_linenumber) AS n FROM lineitem", "SELECT ROUND(SUM(l_extendedprice), 2) AS s, CAST(SUM(l_linenumber) AS BIGINT) AS n FROM lineitem")
_sql("agg_avg", "SELECT ROUND(AVG(l_quantity), 4) AS a FROM lineitem")
_sql("agg_min_max", "SELECT MIN(p_name) AS a, MAX(p_name) AS b, MIN(p_size) AS c, MAX(p_retailprice) AS d FROM part")
_sql("agg_group_1", "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority")
_sql(
    "agg_group_2",
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price, "
    "ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_net, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n "
    "FROM lineitem WHERE l_quantity < 50 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
)
_sql("agg_null_group", "SELECT l.quality AS q, COUNT(*) AS n FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id GROUP BY l.quality")
_sql("agg_expr", "SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag")
_sql("agg_of_aggs", "SELECT l_returnflag, COUNT(*) + 1 AS n, ROUND(SUM(l_tax) / COUNT(*), 6) AS t FROM lineitem GROUP BY l_returnflag")
_sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_sql("agg_having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000")
_sql("agg_having_and_or", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING (COUNT(*) > 12 AND MIN(o_totalprice) > 5000) OR MAX(o_totalprice) > 400000")
_sql("agg_empty_input", "SELECT COUNT(*) AS n, SUM(p_size) AS s, MIN(p_name) AS m FROM part WHERE p_size < 0", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_name) AS m FROM part WHERE p_size < 0")
_sql("agg_over_join", "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(c.c_acctbal), 2) AS s FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")

# Order, limit, distinct
# The order is shown by a number, as results are compared without it.
def _ordered(name: str, columns: str, order: str, table: str, oracle_order: str | None = None) -> None:
    text = "SELECT {0}, ROW_NUMBER() OVER (ORDER BY {1}) AS pos FROM {2} ORDER BY {1}"
    _sql(name, text.format(columns, order, table), text.format(columns, oracle_order or order, table))


_ordered("order_asc", "c_custkey, c_acctbal", "c_acctbal, c_custkey", "customer")
_ordered("order_desc_text", "p_partkey, p_name", "p_name DESC, p_partkey", "part")
_N = "(SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation) AS n"
_ordered("order_nulls_last", "n_nationkey, r", "r, n_nationkey", _N, "r NULLS LAST, n_nationkey")
_ordered("order_desc_nulls_last", "n_nationkey, r", "r DESC, n_nationkey DESC", _N, "r DESC NULLS LAST, n_nationkey DESC")
_sql("order_alias", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders ORDER BY half DESC, o_orderkey")
_sql("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
_sql("offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_sql("distinct_limit", "SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 5 OFFSET 2")

# Subqueries
_sql("sub_scalar_where", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
_sql("sub_scalar_select", "SELECT n_nationkey, (SELECT COUNT(*) FROM region) AS regions FROM nation")
_sql("sub_scalar_empty_null", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey < 0) AS x FROM nation")
_sql("sub_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_sql("sub_in_distinct", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier)")
_sql("sub_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_sql("sub_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region)")
_sql("sub_exists", "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
_sql("sub_not_exists", "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
_sql("sub_corr_scalar", "SELECT o_orderkey FROM orders AS o WHERE o_totalprice > (SELECT 1.5 * AVG(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)")
_sql("sub_corr_exists", "SELECT p_partkey FROM part AS p WHERE EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size)")
_sql("sub_nested", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
_sql("sub_derived_table", "SELECT x.o_custkey, x.n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS x WHERE x.n > 12")


# Statements: the table that is left
def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return (base or f"{tempfile.gettempdir()}/tessera-shared").rstrip("/")  # one process


def _database(spark: SparkSession, folder: str, table: str, columns: str, log: changelog.ChangeLog | None = None):
    from tessera.engine import Database

    c = Database(spark, f"{_shared(spark)}/engine", log).connect()
    c.execute(f"CREATE TABLE t ({columns})")
    source = read(spark, folder, table)
    c.insert("t", source.select(*[w.split()[0] for w in columns.split(", ")]))
    return c


_PART = "p_partkey INT PRIMARY KEY, p_name TEXT NOT NULL, p_size INT, p_retailprice REAL"
_P = "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


def _dml(name: str, statements: list[str], oracle: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        c = _database(spark, folder, "part", _PART)
        for s in statements:
            c.execute(s)
        return c.execute("SELECT * FROM t")

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle


_dml("dml_insert_values", ["INSERT INTO t (p_partkey, p_name) VALUES (-1, 'a'), (-2, 'it''s')"], _P + " UNION ALL SELECT * FROM (VALUES (-1, 'a', NULL, NULL), (-2, 'it''s', NULL, NULL))")
_dml("dml_insert_select", ["INSERT INTO t SELECT -p_partkey - 1, p_name, p_size, p_retailprice FROM t WHERE p_size > 40"], _P + " UNION ALL SELECT -p_partkey - 1, p_name, CAST(p_size AS BIGINT), p_retailprice FROM part WHERE p_size > 40")
_dml("dml_update_where", ["UPDATE t SET p_name = 'big' WHERE p_size > 40"], "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_name END AS p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
_dml("dml_update_expr", ["UPDATE t SET p_retailprice = p_retailprice * 2, p_size = p_size + 1 WHERE p_partkey < 100"], "SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey < 100 THEN p_size + 1 ELSE p_size END AS BIGINT) AS p_size, CASE WHEN p_partkey < 100 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
_dml("dml_delete_where", ["DELETE FROM t WHERE p_size > 10 OR p_name LIKE 'a%'"], _P + " WHERE NOT (p_size > 10 OR p_name LIKE 'a%')")
_dml("ddl_drop_recreate", ["DROP TABLE t", "CREATE TABLE t (k INT, v TEXT)", "INSERT INTO t VALUES (1, 'new WHERE SET')", "UPDATE t SET v = 'a, WHERE b' WHERE k = 1"], "SELECT CAST(1 AS BIGINT) AS k, 'a, WHERE b' AS v")
_dml("txn_rollback", ["BEGIN", "DELETE FROM t WHERE p_size > 10", "ROLLBACK"], _P)
_dml("txn_commit", ["BEGIN TRANSACTION ISOLATION LEVEL REPEATABLE READ", "DELETE FROM t WHERE p_size > 10", "COMMIT"], _P + " WHERE p_size <= 10")


# Statistics, versions, log
@_query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, "
        f"CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM (SELECT p_partkey, p_brand, nullif(p_size, 1) AS p_size FROM part)"
        for c in ("p_partkey", "p_brand", "p_size")
    )
)
def stats_columns(spark: SparkSession, folder: str) -> DataFrame:
    return stats.columns(read(spark, folder, "part").selectExpr("p_partkey", "p_brand", "nullif(p_size, 1) AS p_size"))


@_query(
    "WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM c) "
    "SELECT CAST(b * 10 // t AS INT) AS bucket, min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct FROM r GROUP BY 1"
)
def stats_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(read(spark, folder, "part"), "p_size", 10)


@_query("SELECT p_size, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_size LIMIT 10")
def stats_mcv(spark: SparkSession, folder: str) -> DataFrame:
    return stats.most_common(read(spark, folder, "part"), "p_size")


def _versioned(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey AS _row_id", "o_orderkey % 40 + 1 AS _xmin", "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 40 + 5 END AS _xmax"
    )


_V = "(SELECT o_orderkey AS _row_id, o_orderkey % 40 + 1 AS _xmin, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 40 + 5 END AS _xmax FROM orders)"


@_query(
    f"SELECT * FROM {_V} WHERE (_xmin = 20 OR (_xmin < 25 AND _xmin NOT IN (7, 21))) "
    "AND NOT coalesce(_xmax = 20 OR (_xmax < 25 AND _xmax NOT IN (7, 21)), false)"
)
def mvcc_visible(spark: SparkSession, folder: str) -> DataFrame:
    return versions.visible(_versioned(spark, folder), versions.Snapshot(20, frozenset({7, 21}), 25))


@_query(
    "WITH v AS (SELECT _row_id % 500 AS _row_id, _xmin * 100000 + _row_id AS _xmin, _xmax * 100000 AS _xmax FROM "
    + _V
    + ") SELECT _row_id, _xmin, _xmax FROM (SELECT *, row_number() OVER (PARTITION BY _row_id ORDER BY _xmin DESC) AS n FROM v) "
    "WHERE n = 1 OR _xmax IS NULL OR _xmax >= 2000000"
)
def mvcc_vacuum(spark: SparkSession, folder: str) -> DataFrame:
    rows = _versioned(spark, folder).selectExpr("_row_id % 500 AS _row_id", "_xmin * 100000 + _row_id AS _xmin", "_xmax * 100000 AS _xmax")
    return versions.vacuum(rows, 2_000_000)


_SEEN = "coalesce(_xmin = 20 OR (_xmin < 25 AND _xmin NOT IN (7, 21)), false) AND NOT coalesce(_xmax = 20 OR (_xmax < 25 AND _xmax NOT IN (7, 21)), false)"


@_query(
    f"SELECT _row_id, _xmin, CASE WHEN {_SEEN} AND _row_id % 3 = 0 THEN 20 ELSE _xmax END AS _xmax FROM {_V} "
    f"UNION ALL SELECT _row_id, 20, NULL FROM {_V} WHERE {_SEEN} AND _row_id % 3 = 0"
)
def mvcc_update(spark: SparkSession, folder: str) -> DataFrame:
    s = versions.Snapshot(20, frozenset({7, 21}), 25)
    return versions.update(_versioned(spark, folder), {}, F.expr("_row_id % 3 = 0"), s)


@_query(f"SELECT _row_id, _xmin, CASE WHEN {_SEEN} AND _row_id % 3 = 0 THEN 20 ELSE _xmax END AS _xmax FROM {_V}")
def mvcc_delete(spark: SparkSession, folder: str) -> DataFrame:
    s = versions.Snapshot(20, frozenset({7, 21}), 25)
    return versions.delete(_versioned(spark, folder), F.expr("_row_id % 3 = 0"), s)


_LOG = (
    "SELECT event_id * 2 AS lsn, user_id AS xid, CASE event_id % 4 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'INSERT' ELSE 'UPDATE' END AS type, "
    "event_type AS table_name, event_id % 700 AS row_id, CAST(event_id AS {0}) AS new_json FROM events "
    "UNION ALL SELECT event_id * 2 + 1, user_id, 'COMMIT', NULL, NULL, NULL FROM events WHERE user_id % 3 <> 0 AND event_id % 5 = 0"
)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return views(spark, folder, ["events"]).sql(_LOG.format("STRING"))


@_query(
    f"WITH log AS ({_LOG.format('VARCHAR')}), c AS (SELECT l.* FROM (SELECT * FROM log WHERE type <> 'COMMIT') AS l "
    "ASOF JOIN (SELECT xid, lsn FROM log WHERE type = 'COMMIT') AS e ON l.xid = e.xid AND l.lsn < e.lsn), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY table_name, row_id ORDER BY lsn DESC) AS n FROM c) "
    "SELECT table_name, row_id, new_json FROM r WHERE n = 1 AND type <> 'DELETE'"
)
def wal_replay(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.replay(_log(spark, folder))


@_query(f"SELECT type, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM ({_LOG.format('VARCHAR')}) GROUP BY type")
def wal_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.summary(_log(spark, folder))


@_query(
    f"WITH log AS ({_LOG.format('VARCHAR')}), e AS (SELECT xid, max(lsn) AS last FROM log WHERE type = 'COMMIT' GROUP BY xid) "
    "SELECT l.lsn, l.xid, l.type FROM log AS l LEFT JOIN e ON l.xid = e.xid WHERE l.type <> 'COMMIT' AND (e.last IS NULL OR l.lsn > e.last)"
)
def wal_losers(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.losers(_log(spark, folder)).select("lsn", "xid", "type")


@_query(
    "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_name END AS p_name, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 10 "
    "UNION ALL SELECT -1, 'new', NULL"
)
def wal_recover(spark: SparkSession, folder: str) -> DataFrame:
    """The table that recovery finds from the log that the engine wrote, across a checkpoint and a rolled-back transaction."""
    log = changelog.ChangeLog(spark, f"{_shared(spark)}/log-{uuid.uuid4().hex}")
    c = _database(spark, folder, "part", _PART, log)
    c.execute("UPDATE t SET p_name = 'big' WHERE p_size > 40")
    log.checkpoint()
    for s in ("BEGIN", "DELETE FROM t WHERE p_size <= 10", "INSERT INTO t (p_partkey, p_name) VALUES (-1, 'new')", "COMMIT", "BEGIN", "DELETE FROM t", "ROLLBACK"):
        c.execute(s)
    rows = log.recover().rows.filter("table_name = 't'")
    return rows.select(F.from_json("new_json", "p_partkey long, p_name string, p_size long").alias("r")).select("r.*")


_WAITS = "SELECT DISTINCT user_id % 40 AS x, event_id % 41 AS y FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL"


@_query(
    f"WITH RECURSIVE e AS ({_WAITS}), reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach AS r JOIN e ON r.y = e.x) "
    "SELECT p.x AS a, p.y AS b, EXISTS (SELECT 1 FROM e WHERE e.x = p.x AND e.y = p.y) AND EXISTS (SELECT 1 FROM e WHERE e.x = p.y AND e.y = p.x) AS direct "
    "FROM reach AS p JOIN reach AS q ON p.x = q.y AND p.y = q.x WHERE p.x < p.y"
)
def deadlock_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that wait for each other, directly or by a cycle of any length; at most 40 * 41 edges are brought to the driver."""
    waits: dict[int, set[int]] = {}
    for x, y in views(spark, folder, ["events"]).sql(rewrite(_WAITS)).collect():
        waits.setdefault(x, set()).add(y)
    pairs = [
        (a, b, b in waits[a] and a in waits[b]) for group in locks.groups(waits) for a in group for b in group if a < b
    ]
    return spark.createDataFrame(pairs, "a long, b long, direct boolean")
