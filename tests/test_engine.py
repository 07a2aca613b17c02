import pathlib
import threading

import pytest
from pyspark.sql import functions as F

from tessera.engine import ConstraintError, Database
from tessera.functions import semantics
from tessera.operators import changelog, costs, locks, stats, versions
from tessera.operators.transactions import Transactions
from tessera.plans.dialect import SqlError, rewrite, statements


@pytest.fixture()
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


@pytest.fixture()
def c(db):
    c = db.connect()
    c.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE, age INT, active BOOL DEFAULT TRUE)")
    c.execute("INSERT INTO users (id, name, email, age) VALUES (1, 'Alice', 'a@x', 30), (2, 'Bob', NULL, 25), (3, 'Ümit; \"q\"', NULL, NULL)")
    return c


def got(c, sql):
    return [tuple(r) for r in c.execute(sql).collect()]


def test_insert_and_defaults(c):
    assert got(c, "SELECT id, active FROM users ORDER BY id") == [(1, True), (2, True), (3, True)]
    assert [r[0] for r in c.rows("users").orderBy("_row_id").select("_row_id").collect()] == [0, 1, 2]


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO users (id, name) VALUES (4, 'x'), (1, 'y')",
        "INSERT INTO users (id, name) VALUES (4, NULL)",
        "INSERT INTO users (id, name, email) VALUES (4, 'x', 'a@x')",
        "INSERT INTO users (id, name) VALUES ('4', 'x')",
        "UPDATE users SET id = 1",
        "UPDATE users SET name = NULL WHERE id = 2",
        "UPDATE users SET age = 'old'",
    ],
)
def test_failing_statements_change_nothing(c, sql):
    before = sorted(got(c, "SELECT * FROM users"), key=str)
    with pytest.raises(ConstraintError):
        c.execute(sql)
    assert sorted(got(c, "SELECT * FROM users"), key=str) == before


def test_update_sees_the_old_row_and_unknown_is_no_match(c):
    assert c.execute("UPDATE users SET age = age + 1, id = id + 10 WHERE age > 20").count == 2
    assert got(c, "SELECT id, age FROM users ORDER BY id") == [(3, None), (11, 31), (12, 26)]
    assert c.execute("DELETE FROM users WHERE age < 30").count == 1


def test_unique_index_is_enforced(c):
    c.execute("CREATE UNIQUE INDEX by_age ON users (age)")
    with pytest.raises(ConstraintError):
        c.execute("INSERT INTO users (id, name, age) VALUES (9, 'z', 30)")
    c.execute("DROP INDEX by_age")
    c.execute("INSERT INTO users (id, name, age) VALUES (9, 'z', 30)")
    c.execute("CREATE TABLE IF NOT EXISTS users (id INT)")
    c.execute("DROP TABLE IF EXISTS nothing")
    with pytest.raises(SqlError):
        c.execute("DROP TABLE nothing")


def test_transactions(db, c):
    other = db.connect()
    c.execute("BEGIN")
    c.execute("DELETE FROM users WHERE id = 1")
    assert got(other, "SELECT COUNT(*) FROM users") == [(3,)]
    c.execute("ROLLBACK")
    assert got(c, "SELECT COUNT(*) FROM users") == [(3,)]
    other.execute("BEGIN ISOLATION LEVEL REPEATABLE READ")
    c.execute("DELETE FROM users WHERE id = 1")
    assert got(other, "SELECT COUNT(*) FROM users") == [(3,)]
    other.execute("UPDATE users SET age = 1")
    with pytest.raises(ConstraintError):
        other.execute("COMMIT")
    assert got(other, "SELECT COUNT(*) FROM users") == [(2,)]


def test_save_and_load(spark, c, tmp_path):
    c.execute("CREATE TABLE empty (x REAL)")
    c.execute(f"SAVE '{tmp_path}/saved'")
    new = Database(spark, str(tmp_path / "new")).connect()
    new.execute(f"LOAD '{tmp_path}/saved'")
    assert sorted(got(new, "SELECT * FROM users"), key=str) == sorted(got(c, "SELECT * FROM users"), key=str)
    assert got(new, "SELECT * FROM empty") == []
    with pytest.raises(ConstraintError):
        new.execute("INSERT INTO users (id, name) VALUES (1, 'again')")


def test_explain_and_analyze(c):
    assert "rows: 3" in c.execute("EXPLAIN ANALYZE SELECT * FROM users").message
    assert {r["column"]: r["n_distinct"] for r in c.execute("ANALYZE TABLE users").collect()}["age"] == 2
    assert stats.table(c.rows("users")).first()["pages"] == 1


def test_dialect(c):
    assert got(c, "SELECT 7 / 2, 1 / 0, -7 % 3, 7 % -3, 5-3, 1.5") == [(3.5, None, 2, -2, 2, 1.5)]
    assert statements("SELECT ';'; -- x;\nSELECT 2;") == ["SELECT ';'", "SELECT 2"]
    assert "NULLS LAST" in rewrite("SELECT a FROM t ORDER BY a DESC LIMIT 3")
    for bad in ("SELECT 'x", "SELECT (1", "SELECT id FROM users LIMIT -1"):
        with pytest.raises(SqlError):
            c.execute(bad)


def test_shell(c):
    from tessera.__main__ import Shell

    s = Shell(c)
    assert s.line(".tables") == "users" and "Alice" in s.line("SELECT name FROM users")
    assert s.line("SELECT nothing FROM users").startswith("Error") and s.line(".schema users").startswith("users: id bigint")


def test_locks():
    m = locks.LockManager(timeout=0.05)
    assert m.acquire("t", 1, "S") and m.acquire("t", 2, "S")
    assert not m.acquire("t", 3, "X", wait="SKIP")
    with pytest.raises(locks.LockTimeout):
        m.acquire("t", 3, "X", wait="NOWAIT")
    with pytest.raises(locks.LockTimeout):
        m.acquire("t", 3, "X")
    m.release_all(1)
    m.release_all(2)
    assert m.acquire("t", 3, "X")
    waits = {1: {2}, 2: {3}, 3: {1}, 4: {1}}
    assert locks.groups(waits) == [{1, 2, 3}] and set(locks.cycle(waits, 1)) == {1, 2, 3} and not locks.cycle(waits, 4)
    assert locks.victim([1, 2, 3], {}) == 3 and locks.victim([1, 2, 3], {2: 5}, "MOST_LOCKS") == 2


def test_dropped_and_rolled_back_tables_are_gone(c):
    c.execute("SELECT * FROM users").collect()
    c.execute("DROP TABLE users")
    with pytest.raises(Exception, match="(?i)users"):
        c.execute("SELECT * FROM users").collect()
    c.execute("BEGIN")
    c.execute("CREATE TABLE t (x INT)")
    assert got(c, "SELECT * FROM t") == []
    c.execute("ROLLBACK")
    with pytest.raises(Exception, match="(?i)t"):
        c.execute("SELECT * FROM t").collect()


def test_no_insert_is_lost(db, c):
    connections = [db.connect() for _ in range(3)]
    threads = [threading.Thread(target=x.execute, args=(f"INSERT INTO users (id, name) VALUES ({100 + k}, 'n')",)) for k, x in enumerate(connections)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got(c, "SELECT id FROM users WHERE id >= 100 ORDER BY id") == [(100,), (101,), (102,)]
    ids = [r[0] for r in c.rows("users").select("_row_id").collect()]
    assert len(set(ids)) == len(ids)


def test_words_in_strings_are_no_keywords(c):
    c.execute("UPDATE users SET name = 'no WHERE, SET here', age = COALESCE(age, CASE WHEN id = 3 THEN 1 ELSE 2 END) WHERE id = 3 OR name = 'x WHERE y'")
    assert got(c, "SELECT name, age FROM users WHERE id = 3") == [("no WHERE, SET here", 1)]
    assert c.execute("DELETE FROM users WHERE name = 'no WHERE, SET here'").count == 1
    for bad in ("UPDATE users age = 1", "DELETE users", "SELECT CASE WHEN 1 = 1 THEN 2"):
        with pytest.raises(SqlError):
            c.execute(bad)


def test_hints_casts_and_division_after_case(c):
    assert "BROADCAST" in rewrite("SELECT /*+ BROADCAST(a) */ 1 FROM a -- x")
    assert got(c, "SELECT CASE WHEN 1 = 1 THEN 4 END / 0, CAST('abc' AS BOOL), CAST('Yes' AS BOOLEAN), CAST(0 AS BOOL), CAST(2.5 AS BOOL)") == [
        (None, False, True, False, True)
    ]


def test_a_failed_statement_leaves_no_files(c, db):
    files = lambda: sorted(p for p in pathlib.Path(db.folder).rglob("part-*"))
    before = files()
    with pytest.raises(ConstraintError):
        c.execute("INSERT INTO users (id, name) VALUES (1, 'again')")
    assert files() == before


def test_clear_lookup_and_statistics(c):
    assert [r.name for r in c.lookup("users", [0, 99]).collect()] == ["Alice"]
    c.execute("ANALYZE users")
    assert "statistics of users: 3 rows, 1 pages, cost of a scan 1.03" in c.execute("EXPLAIN SELECT * FROM users").message
    c.clear("users")
    assert got(c, "SELECT COUNT(*) FROM users") == [(0,)] and "older" in c.execute("EXPLAIN SELECT * FROM users").message
    c.drop_statistics("users")
    assert "statistics" not in c.execute("EXPLAIN SELECT * FROM users").message
    c.clear()
    assert c.tables() == {}


def test_lock_modes_add_up_and_the_policy_chooses_the_victim():
    m = locks.LockManager(timeout=5)
    m.acquire("t", 1, "S")
    m.acquire("t", 1, "IS")
    assert m.holders("t") == {1: "S"} and not m.acquire("t", 2, "IX", wait="SKIP")
    m.acquire("t", 1, "IX")
    assert m.holders("t") == {1: "X"}
    m.release("t", 1)
    assert m.holders("t") == {}
    m = locks.LockManager(timeout=5, policy="OLDEST")
    m.acquire("a", 1)
    m.acquire("b", 2)
    caught = []

    def older():
        try:
            m.acquire("b", 1)
        except locks.Deadlock:
            caught.append(1)
            m.release_all(1)

    t = threading.Thread(target=older)
    t.start()
    while not m.waiting():
        pass
    assert m.acquire("a", 2)
    t.join()
    assert caught == [1]
    assert locks.cycle({k: {k + 1} for k in range(5000)} | {5000: {0}}, 0) and locks.cycle({1: {1}}, 1) == [1]


def test_log_is_read_in_its_order(spark):
    rows = [
        (1, 7, "COMMIT", None, None, None, None), (2, 7, "INSERT", "t", 1, None, "a"), (3, 8, "UPDATE", "t", 2, "old", "b"),
        (4, 8, "COMMIT", None, None, None, None), (5, 8, "DELETE", "t", 3, "gone", None), (6, 9, "INSERT", "t", 4, None, "c"),
        (7, 9, "ABORT", None, None, None, None), (8, 0, "CHECKPOINT", None, None, None, None), (9, 9, "INSERT", "t", 5, None, "d"), (10, 9, "COMMIT", None, None, None, None),
    ]
    log = spark.createDataFrame([(*r, None) for r in rows], changelog.SCHEMA)
    assert sorted((r.row_id, r.new_json) for r in changelog.replay(log).collect()) == [(2, "b"), (5, "d")]
    assert [r.lsn for r in changelog.losers(log).collect()] == [5, 2]
    assert {(r.row_id, r.old_json) for r in changelog.undo(log).collect()} == {(3, "gone"), (1, None)}
    assert [r.lsn for r in changelog.since_checkpoint(log).orderBy("lsn").collect()] == [9, 10]


def test_selectivity_and_column_helpers(spark):
    assert stats.selectivity("<", 25, 0, 100, 10) == 0.25 and stats.selectivity(">", 25, 0, 100, 10) == 0.75
    assert stats.selectivity("=", 3, 0, 9, 5) == 0.2 and stats.selectivity("=", 3, 0, 9, 5, {3: 0.5}) == 0.5
    df = spark.createDataFrame([(7, 2), (-7, 3), (7, 0)], "a long, b long")
    rows = df.select(semantics.div(F.col("a"), F.col("b")), semantics.mod(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(3.5, 1), (-7 / 3, 2), (None, None)]


def test_following_a_log(spark, tmp_path):
    from tessera.streaming.follow import follow

    seen = []
    for k in range(2):
        spark.createDataFrame([(k, 1, "INSERT", "t", k, None, "x", None)], changelog.SCHEMA).write.mode("append").json(f"{tmp_path}/log")
        query = follow(spark, f"{tmp_path}/log", f"{tmp_path}/checkpoint", lambda df, n: seen.extend(r.lsn for r in df.collect()))
        query.awaitTermination()
    assert seen == [0, 1]


def test_inserts_add_folders_until_they_are_too_many(db, c, monkeypatch):
    import tessera.engine as engine

    first = c.table("users").paths
    c.execute("INSERT INTO users (id, name) VALUES (4, 'd')")
    assert c.table("users").paths[:1] == first and len(c.table("users").paths) == 2
    monkeypatch.setattr(engine, "FOLDERS", 2)
    c.execute("INSERT INTO users (id, name) VALUES (5, 'e')")
    assert len(c.table("users").paths) == 1
    assert [r[0] for r in c.rows("users").orderBy("_row_id").select("_row_id").collect()] == [0, 1, 2, 3, 4]


def test_the_log_recovers_the_table_across_checkpoints(spark, tmp_path):
    log = changelog.ChangeLog(spark, f"{tmp_path}/log")
    c = Database(spark, f"{tmp_path}/db", log).connect()
    rows = lambda: sorted((r.row_id, r.new_json) for r in log.recover().rows.collect())
    assert rows() == []
    c.execute("CREATE TABLE t (k INT PRIMARY KEY, v TEXT)")
    c.execute("INSERT INTO t VALUES (1, 'a'), (2, NULL)")
    c.execute("UPDATE t SET v = 'b' WHERE k = 1")
    for end in ("ROLLBACK", "COMMIT"):
        c.execute("BEGIN")
        c.execute("INSERT INTO t VALUES (3, 'c')")
        c.execute("DELETE FROM t WHERE k = 2")
        c.execute(end)
    with pytest.raises(ConstraintError):
        c.execute("INSERT INTO t VALUES (3, 'again')")
    want = [(0, '{"k":1,"v":"b"}'), (2, '{"k":3,"v":"c"}')]
    assert rows() == want
    lsns = [r.lsn for r in log.read().orderBy("lsn").collect()]
    assert lsns == list(range(len(lsns)))
    log.write(99, spark.createDataFrame([("DELETE", "t", 0, "x", None)], "type string, table_name string, row_id long, old_json string, new_json string"))
    assert rows() == want and [r.xid for r in log.uncommitted().collect()] == [99]
    assert [(r.row_id, r.old_json) for r in log.recover().undone.collect()] == [(0, "x")]
    n = log.read().count()
    log.checkpoint()
    assert rows() == want and 0 < log.read().count() < n and log.uncommitted().count() == 1
    log.mark(99, "COMMIT")
    assert rows() == want[1:]
    again = changelog.ChangeLog(spark, f"{tmp_path}/log")
    assert again.next_lsn == log.next_lsn
    log.checkpoint()
    assert rows() == want[1:] and log.read().count() == 1
    assert changelog.ChangeLog(spark, f"{tmp_path}/log").next_lsn == log.next_lsn


def test_damaged_records_and_torn_segments_are_left_out(spark, tmp_path):
    log = changelog.ChangeLog(spark, f"{tmp_path}/log")
    row = lambda k: spark.createDataFrame([("INSERT", "t", k, None, "{}")], "type string, table_name string, row_id long, old_json string, new_json string")
    log.commit(1, [row(1)])
    log.commit(2, [row(2)])
    bad = spark.read.parquet(log._path("segment", 2)).withColumn("row_id", F.lit(7).cast("long"))
    bad.write.parquet(f"{tmp_path}/bad")
    spark.read.parquet(f"{tmp_path}/bad").write.mode("overwrite").parquet(log._path("segment", 2))
    found = log.recover()
    assert [r.row_id for r in found.rows.collect()] == [1] and found.n_damaged == 1 and found.last_lsn == 3
    pathlib.Path(log._path("segment", 0), "_SUCCESS").unlink()
    assert log.recover().rows.count() == 0


def test_transactions_are_forgotten_and_seen():
    t = Transactions(kept=2)
    a, b = t.begin(), t.begin()
    assert t.snapshot(b) == versions.Snapshot(2, frozenset({1}), 3) and t.oldest() == 1
    t.end(a, "COMMITTED")
    with pytest.raises(ValueError):
        t.end(a, "ABORTED")
    for _ in range(2):
        t.end(t.begin(), "ABORTED")
    assert (t.state(a), t.state(b), t.state(4)) == (None, "ACTIVE", "ABORTED")
    assert t.cleanup(0) == 2 and t.state(4) is None and t.oldest() == 2


def test_versions_are_inserted_updated_and_deleted(spark):
    df = versions.insert(spark.createDataFrame([(1, "a"), (2, None)], "_row_id long, v string"), 5)
    s = versions.Snapshot(6, frozenset(), 6)
    df = versions.update(df, {"v": F.lit("b")}, F.col("v") == "a", s)
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "a", 5, 6), (1, "b", 6, None), (2, None, 5, None)]
    df = versions.delete(df, None, versions.Snapshot(7, frozenset({6}), 8))
    assert sorted((r._row_id, r._xmin, r._xmax) for r in df.collect() if r._xmax) == [(1, 5, 7), (2, 5, 7)]


def test_costs():
    assert costs.scan(1000, 10).total == 20 and costs.scan(1000, 10, 0.5).rows == 500
    few, many = costs.index_scan(1000, 0.01), costs.index_scan(1000, 0.2)
    assert (round(few.total, 6), few.startup) == (52.075, 12) and round(many.total, 6) == 413.5
    assert costs.index_scan(1000, 1.0) == costs.scan(1000, 10)
    assert round(costs.nested_loop(10, 20, 5).total, 6) == 50.6
    assert round(costs.hash_join(100, 200, 8).total, 6) == 3.75
    assert round(costs.hash_join(1, 10**7, 100).startup, 6) == 187500
    assert costs.merge_join(10, 10, True, True).startup == 0 and round(costs.merge_join(8, 1, False, True).startup, 6) == 0.3
    assert costs.aggregate(100, 5, 2).total == 1.5 and costs.sort(1, 8).total == 0 and round(costs.sort(4, 8).total, 6) == 0.06
    assert [costs.scan_choice(x, True) for x in (0.05, 0.2, 0.5)] == ["INDEX", "BITMAP", "SCAN"] and costs.scan_choice(0.01, False) == "SCAN"
    assert [costs.join_choice(50, 50), costs.join_choice(500, 500, True, True), costs.join_choice(10**5, 10**5), costs.join_choice(200, 4)] == [
        "NESTED_LOOP", "MERGE", "HASH", "NESTED_LOOP"
    ]


def test_histograms_and_columns(spark):
    df = spark.range(20000).selectExpr("IF(id < 5000, 0, id % 7000) AS v", "CAST(NULL AS DOUBLE) AS w", "IF(id % 2 = 0, 0.0D, -0.0D) AS z")
    rows = stats.histogram(df, "v", 10).orderBy("bucket").collect()
    assert sum(r.n_rows for r in rows) == 20000 and rows[0].low == 0 and all(a.high < b.low for a, b in zip(rows, rows[1:]))
    assert sum(r.n_distinct for r in rows) == 7000 and max(r.n_rows for r in rows[1:]) <= 2010
    assert stats.histogram(df, "w", 10).count() == 0
    assert {r.column: (r.n_distinct, r.n_null) for r in stats.columns(df).collect()} == {"v": (7000, 0), "w": (0, 20000), "z": (1, 0)}
    assert stats.selectivity("<", 5, 0, 10, 9, buckets=[(0, 4, 90), (5, 10, 10)]) == 0.9
