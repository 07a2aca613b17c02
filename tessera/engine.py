"""A database of declared tables: DDL, DML with constraints, transactions, queries, save and load.

Every table is a list of Parquet folders that are never changed.  INSERT adds a folder with its rows
and checks them, against the keys of the others by a semi join; UPDATE and DELETE write the table's
next content as one folder, and so does an INSERT that finds ``FOLDERS`` of them.  The constraints are
checked on what was written, and then the reference is swapped, so a statement takes effect as a whole
or not at all, and lineage never grows.  The swap compares the version that
the statement began with; a statement outside of a transaction that lost such a race is run again.
A transaction collects its new
references and publishes them at COMMIT, unless a table that it wrote was published by another
one meanwhile (the first to commit wins).  With a change log, the changed rows and a COMMIT are
written to it before the references are swapped.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import costs, stats
from tessera.operators.changelog import ChangeLog, numbered
from tessera.operators.transactions import Transactions
from tessera.plans.dialect import SqlError, rewrite, split, statements, tokens

ROW = "_row_id"
#: How often a statement that loses a race with another connection is run.
TRIES = 5
#: Folders that a table is read from at most.
FOLDERS = 32
TYPES = {
    "INT": T.LongType(), "INTEGER": T.LongType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "STRING": T.StringType(),
    "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
}
ACCEPTED = {
    "bigint": ("tinyint", "smallint", "int", "bigint"),
    "double": ("tinyint", "smallint", "int", "bigint", "float", "double"),
    "string": ("string",),
    "boolean": ("boolean",),
}


class ConstraintError(ValueError):
    pass


class Conflict(ConstraintError):
    """Another connection published the table first."""


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    unique: bool = False
    primary_key: bool = False
    default: str | None = None  # an SQL literal


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    paths: tuple[str, ...] = ()
    version: int = 0
    next_row: int = 0
    indexes: tuple[tuple[str, str, bool], ...] = ()  # name, column, unique

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(c.name, c.type) for c in self.columns)])

    def unique_columns(self) -> list[str]:
        named = {c.name for c in self.columns if c.unique or c.primary_key} | {c for _, c, u in self.indexes if u}
        return [c.name for c in self.columns if c.name in named]


#: Makes a statement's records from the folder that it wrote.
Changes = Callable[[DataFrame], DataFrame]


def _changes(t: Table, kind: str, rows: DataFrame, after: list | None = None) -> DataFrame:
    """A record of the change log for each row; ``after``: the new values of an UPDATE."""
    none = F.lit(None).cast("string")
    as_json = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    own = as_json([F.col(c.name) for c in t.columns])
    return rows.select(
        F.lit(kind).alias("type"), F.lit(t.name).alias("table_name"), F.col(ROW).alias("row_id"),
        (none if kind == "INSERT" else own).alias("old_json"),
        {"INSERT": own, "DELETE": none}.get(kind, as_json(after) if after else none).alias("new_json"),
    )


@dataclass
class CommandResult:
    message: str
    count: int = 0


@dataclass
class Transaction:
    xid: int
    isolation: str
    base: dict[str, Table]
    written: dict[str, Table | None] = field(default_factory=dict)
    changes: list[DataFrame] = field(default_factory=list)


class Database:
    """Published tables, shared by connections."""

    def __init__(self, spark: SparkSession, folder: str, log: ChangeLog | None = None):
        self.spark, self.folder, self.log = spark, folder, log
        self.tables: dict[str, Table] = {}
        self.lock = threading.RLock()
        self.transactions = Transactions()
        #: What ANALYZE found: of each table its version, rows, width and pages, and its columns' figures.
        self.statistics: dict[str, dict] = {}

    def connect(self) -> Connection:
        return Connection(self)


class Connection:
    def __init__(self, db: Database):
        self.db = db
        self.session = db.spark.newSession()
        self.txn: Transaction | None = None
        self.views: set[str] = set()

    # Tables as this connection sees them

    def tables(self) -> dict[str, Table]:
        if self.txn is None:
            return dict(self.db.tables)
        base = self.txn.base if self.txn.isolation == "REPEATABLE READ" else self.db.tables
        out = dict(base) | {k: t for k, t in self.txn.written.items() if t is not None}
        return {k: t for k, t in out.items() if self.txn.written.get(k, t) is not None}

    def table(self, name: str) -> Table:
        try:
            return self.tables()[name]
        except KeyError:
            raise SqlError(f"no table {name}") from None

    def rows(self, name: str) -> DataFrame:
        t = self.table(name)
        if not t.paths:
            return self.session.createDataFrame([], t.schema)
        return self.session.read.schema(t.schema).parquet(*t.paths)

    def lookup(self, name: str, row_ids: list[int]) -> DataFrame:
        """The rows of these row ids."""
        return self.rows(name).filter(F.col(ROW).isin(*row_ids))

    def clear(self, name: str | None = None) -> None:
        """Remove all rows of a table, or all tables."""
        for t in [self.table(name)] if name else list(self.tables().values()):
            if name:
                self._store(t, self.rows(name).limit(0), t.next_row, lambda _, rows=self.rows(name): _changes(t, "DELETE", rows))
            else:
                self._publish(t.name, None, t)

    def _views(self, sql: str) -> None:
        """The tables that the text names as views, and no others."""
        tables, named = self.tables(), {t.strip("`") for t in tokens(sql)}
        for name in self.views - set(tables):
            self.session.catalog.dropTempView(name)
        used = named & set(tables)
        for name in used:
            self.rows(name).drop(ROW).createOrReplaceTempView(name)
        self.views = (self.views & set(tables)) | used

    def _publish(self, name: str, t: Table | None, before: Table | None, changes: DataFrame | None = None) -> None:
        if self.txn is not None:
            self.txn.written[name] = t
            if changes is not None:
                self.txn.changes.append(changes)
            return
        with self.db.lock:
            if self.db.tables.get(name) != before:
                raise Conflict(f"{name} was changed by another connection")
            if changes is not None and self.db.log is not None:
                xid = self.db.transactions.begin()
                self.db.log.commit(xid, [changes])
                self.db.transactions.end(xid, "COMMITTED")
            if t is None:
                self.db.tables.pop(name, None)
                self.db.statistics.pop(name, None)
            else:
                self.db.tables[name] = t

    # Statements

    def run_script(self, script: str) -> list:
        return [self.execute(s) for s in statements(script)]

    def execute(self, sql: str) -> DataFrame | CommandResult:
        sql = sql.strip().rstrip(";").strip()
        head = sql.split(None, 1)[0].upper() if sql else ""
        method = {
            "SELECT": self._select, "CREATE": self._create, "DROP": self._drop, "INSERT": self._insert, "UPDATE": self._update,
            "DELETE": self._delete, "ANALYZE": self._analyze, "EXPLAIN": self._explain, "BEGIN": self._begin,
            "COMMIT": self._commit, "ROLLBACK": self._rollback, "SAVE": self._save, "LOAD": self._load,
        }.get(head)
        if method is None:
            raise SqlError(f"unknown statement {head}")
        for _ in range(TRIES - 1):
            try:
                return method(sql)
            except Conflict:
                if self.txn is not None:
                    raise
        return method(sql)

    def _select(self, sql: str) -> DataFrame:
        if re.search(r"\bLIMIT\s+-", sql, re.I):
            raise SqlError("LIMIT is negative")
        self._views(sql)
        return self.session.sql(rewrite(sql))

    def _create(self, sql: str) -> CommandResult:
        if m := re.match(r"CREATE\s+(UNIQUE\s+)?INDEX\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)\s*\)$", sql, re.I):
            unique, quiet, name, table, column = m.groups()
            t = self.table(table)
            if any(name == i[0] for x in self.tables().values() for i in x.indexes):
                if quiet:
                    return CommandResult(f"index {name} exists")
                raise SqlError(f"index {name} exists")
            if column not in [c.name for c in t.columns]:
                raise SqlError(f"no column {column}")
            new = replace(t, indexes=(*t.indexes, (name, column, bool(unique))), version=t.version + 1)
            self._check(new, self.rows(table))
            self._publish(table, new, t)
            return CommandResult(f"index {name} created")
        m = re.match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)$", sql, re.I | re.S)
        if not m:
            raise SqlError("CREATE is not understood")
        if m[2] in self.tables():
            if m[1]:
                return CommandResult(f"table {m[2]} exists")
            raise SqlError(f"table {m[2]} exists")
        columns = []
        for part in re.split(r",(?=(?:[^']*'[^']*')*[^']*$)", m[3]):
            words = tokens(part)
            if len(words) < 2 or words[1].upper() not in TYPES:
                raise SqlError(f"column {part.strip()} is not understood")
            rest = " ".join(words[2:])
            pk = bool(re.search(r"\bPRIMARY KEY\b", rest, re.I))
            default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I)
            columns.append(
                Column(words[0], TYPES[words[1].upper()], not pk and not re.search(r"\bNOT NULL\b", rest, re.I),
                       bool(re.search(r"\bUNIQUE\b", rest, re.I)), pk, default and default[1])
            )
        if len({c.name for c in columns}) < len(columns):
            raise SqlError("a column is named twice")
        self._publish(m[2], Table(m[2], tuple(columns)), None)
        return CommandResult(f"table {m[2]} created")

    def _drop(self, sql: str) -> CommandResult:
        m = re.match(r"DROP\s+(TABLE|INDEX)\s+(IF\s+EXISTS\s+)?(\w+)$", sql, re.I)
        if not m:
            raise SqlError("DROP is not understood")
        kind, quiet, name = m[1].upper(), m[2], m[3]
        if kind == "TABLE" and name in self.tables():
            self._publish(name, None, self.table(name))
            return CommandResult(f"table {name} dropped")
        for t in self.tables().values() if kind == "INDEX" else ():
            if name in [i[0] for i in t.indexes]:
                self._publish(t.name, replace(t, indexes=tuple(i for i in t.indexes if i[0] != name), version=t.version + 1), t)
                return CommandResult(f"index {name} dropped")
        if quiet:
            return CommandResult(f"no {kind.lower()} {name}")
        raise SqlError(f"no {kind.lower()} {name}")

    def _check(self, t: Table, rows: DataFrame, old: DataFrame | None = None) -> None:
        """NOT NULL and uniqueness of ``rows``, and that no key of theirs is in ``old``; null is never a duplicate."""
        needed = [c.name for c in t.columns if not c.nullable]
        if needed:
            n = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first()
            for c in needed:
                if n[c]:
                    raise ConstraintError(f"{t.name}.{c} is null")
        for c in t.unique_columns():
            keys = rows.filter(F.col(c).isNotNull()).groupBy(c).count()
            if keys.filter("count > 1").limit(1).count() or (
                old is not None and old.select(c).join(keys, c, "left_semi").limit(1).count()
            ):
                raise ConstraintError(f"{t.name}.{c} has a duplicate")

    def _store(self, t: Table, rows: DataFrame, next_row: int, changes: Changes | None = None, new: bool = False) -> None:
        """Make ``rows`` the content of the table."""
        self._write(t, rows, (), next_row, changes, self.tables().get(t.name) if new else t)

    def _write(self, t: Table, rows: DataFrame, kept: tuple[str, ...], next_row: int, changes: Changes | None, before: Table | None) -> None:
        """Add a folder with ``rows`` to the folders that are kept."""
        path = f"{self.db.folder}/{t.name}/{uuid.uuid4().hex}"
        rows.select(*t.schema.names).write.parquet(path)
        read = self.session.read.schema(t.schema)
        try:
            self._check(t, read.parquet(path), read.parquet(*kept) if kept else None)
            after = replace(t, paths=(*kept, path), version=t.version + 1, next_row=next_row)
            self._publish(t.name, after, before, changes(read.parquet(path)) if changes and self.db.log is not None else None)
        except ConstraintError:
            self._delete_folder(path)
            raise

    def _delete_folder(self, path: str) -> None:
        sc = self.session.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def _insert(self, sql: str) -> CommandResult:
        m = re.match(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^()]*)\))?\s*(VALUES\b.*|SELECT\b.*)$", sql, re.I | re.S)
        if not m:
            raise SqlError("INSERT is not understood")
        t = self.table(m[1])
        names = [c.strip() for c in m[2].split(",")] if m[2] else [c.name for c in t.columns]
        self._views(m[3])
        new = self.session.sql(rewrite(m[3] if m[3][:6].upper() == "SELECT" else f"SELECT * FROM {m[3]}"))
        if unknown := set(names) - {c.name for c in t.columns}:
            raise SqlError(f"no column {sorted(unknown)[0]}")
        if len(new.columns) != len(names):
            raise SqlError(f"{len(names)} columns but {len(new.columns)} values")
        return self.insert(t.name, new.toDF(*names))

    def insert(self, name: str, new: DataFrame) -> CommandResult:
        """Append rows given by column name; columns left out take their default or null."""
        t = self.table(name)
        given = dict(new.dtypes)
        columns = []
        for c in t.columns:
            kind = c.type.simpleString()
            if c.name not in given:
                columns.append((F.expr(c.default) if c.default else F.lit(None)).cast(c.type).alias(c.name))
            elif given[c.name] in (*ACCEPTED[kind], "void"):
                columns.append(F.col(c.name).cast(c.type).alias(c.name))
            else:
                raise ConstraintError(f"{name}.{c.name} is {kind}, not {given[c.name]}")
        # Ids are fixed when the batch is written: a dense number for each row.
        path = f"{self.db.folder}/{name}/batch-{uuid.uuid4().hex}"
        batch = numbered(new.select(*columns), path, ROW, t.next_row)
        n = batch.count()
        keep = len(t.paths) < FOLDERS
        rows = batch if keep else self.rows(name).unionByName(batch)
        try:
            fresh = lambda written: _changes(t, "INSERT", written.filter(F.col(ROW) >= t.next_row))
            self._write(t, rows, t.paths if keep else (), t.next_row + n, fresh, t)
        finally:
            self._delete_folder(path)
        return CommandResult(f"{n} rows inserted", n)

    def _update(self, sql: str) -> CommandResult:
        head, *rest = split(tokens(sql), "SET")
        if len(rest) != 1 or len(head) != 2:
            raise SqlError("UPDATE is not understood")
        assigned, *where = split(rest[0], "WHERE")
        t = self.table(head[1])
        kinds = {c.name: c.type for c in t.columns}
        hit = self._predicate(t, where)
        changes = {}
        for name, *value in split(assigned, ","):
            value = " ".join(value[1:])
            if name not in kinds:
                raise SqlError(f"no column {name}")
            kind = self.rows(t.name).select(F.expr(rewrite(value)).alias("x")).dtypes[0][1]
            if kind not in (*ACCEPTED[kinds[name].simpleString()], "void"):
                raise ConstraintError(f"{t.name}.{name} is {kinds[name].simpleString()}, not {kind}")
            changes[name] = F.when(F.col("_hit"), F.expr(rewrite(value)).cast(kinds[name])).otherwise(F.col(name))
        rows = self.rows(t.name).withColumn("_hit", hit)
        n = rows.filter("_hit").count()
        # All new values are made from the old row.
        after = [changes.get(c.name, F.col(c.name)).alias(c.name) for c in t.columns]
        self._store(t, rows.select(ROW, *after), t.next_row, lambda _: _changes(t, "UPDATE", rows.filter("_hit"), after))
        return CommandResult(f"{n} rows updated", n)

    def _predicate(self, t: Table, where: list[list[str]]):
        if len(where) > 1:
            raise SqlError("two WHEREs")
        text = " ".join(where[0]) if where else ""
        self._views(text)
        return F.coalesce(F.expr(rewrite(text)), F.lit(False)) if where else F.lit(True)

    def _delete(self, sql: str) -> CommandResult:
        head, *where = split(tokens(sql), "WHERE")
        if len(head) != 3 or head[1].upper() != "FROM":
            raise SqlError("DELETE is not understood")
        t = self.table(head[2])
        rows = self.rows(t.name).withColumn("_hit", self._predicate(t, where))
        n = rows.filter("_hit").count()
        self._store(t, rows.filter("NOT _hit").drop("_hit"), t.next_row, lambda _: _changes(t, "DELETE", rows.filter("_hit")))
        return CommandResult(f"{n} rows deleted", n)

    def _analyze(self, sql: str) -> DataFrame:
        """Finds and stores a table's statistics, which EXPLAIN shows while they are of its version."""
        m = re.match(r"ANALYZE\s+(?:TABLE\s+)?(\w+)$", sql, re.I)
        if not m:
            raise SqlError("ANALYZE is not understood")
        t, rows = self.table(m[1]), self.rows(m[1]).drop(ROW)
        found = stats.columns(rows)
        figures = {r["column"]: r.asDict() for r in found.collect()}
        self.db.statistics[t.name] = {"version": t.version, **stats.table(rows).first().asDict(), "columns": figures}
        return found

    def drop_statistics(self, name: str) -> None:
        self.db.statistics.pop(name, None)

    def _known(self, sql: str) -> str:
        """What ANALYZE found of the tables that the text names."""
        out = []
        for name in sorted({x.strip("`") for x in tokens(sql)} & set(self.tables())):
            s = self.db.statistics.get(name)
            if s:
                stale = "" if s["version"] == self.table(name).version else ", older than the table"
                scan = costs.scan(s["n_rows"], s["pages"]).total
                out.append(f"statistics of {name}: {s['n_rows']} rows, {s['pages']} pages, cost of a scan {scan:.2f}{stale}")
        return "\n".join(out)

    def _explain(self, sql: str) -> CommandResult:
        m = re.match(r"EXPLAIN\s+(ANALYZE\s+)?(.*)$", sql, re.I | re.S)
        df = self._select(m[2])
        plan = self.session._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        plan += self._known(m[2])
        if m[1]:
            began = time.perf_counter()
            n = df.count()
            plan += f"\nrows: {n}\nexecution time: {(time.perf_counter() - began) * 1000:.3f} ms"
        return CommandResult(plan)

    # Transactions

    def _begin(self, sql: str) -> CommandResult:
        m = re.match(r"BEGIN(?:\s+TRANSACTION)?(?:\s+ISOLATION\s+LEVEL\s+(READ\s+COMMITTED|REPEATABLE\s+READ))?$", sql, re.I)
        if not m:
            raise SqlError("BEGIN is not understood")
        if self.txn is not None:
            raise SqlError("a transaction is open")
        with self.db.lock:
            xid = self.db.transactions.begin()
            level = " ".join((m[1] or "READ COMMITTED").upper().split())
            self.txn = Transaction(xid, level, dict(self.db.tables))
        return CommandResult(f"transaction {xid} begun")

    def _commit(self, sql: str) -> CommandResult:
        if self.txn is None:
            raise SqlError("no transaction is open")
        txn, self.txn = self.txn, None
        with self.db.lock:
            for name in txn.written:
                if self.db.tables.get(name) != txn.base.get(name):
                    self.db.transactions.end(txn.xid, "ABORTED")
                    raise ConstraintError(f"{name} was changed by another transaction")
            if txn.changes and self.db.log is not None:
                self.db.log.commit(txn.xid, txn.changes)
            self.db.transactions.end(txn.xid, "COMMITTED")
            for name, t in txn.written.items():
                if t is None:
                    self.db.tables.pop(name, None)
                else:
                    self.db.tables[name] = t
        return CommandResult(f"transaction {txn.xid} committed")

    def _rollback(self, sql: str) -> CommandResult:
        if self.txn is None:
            raise SqlError("no transaction is open")
        xid, self.txn = self.txn.xid, None
        self.db.transactions.end(xid, "ABORTED")
        return CommandResult(f"transaction {xid} rolled back")

    # Save and load: a folder with each table's rows as JSON lines and a manifest

    def _save(self, sql: str) -> CommandResult:
        folder = re.match(r"SAVE\s+'([^']+)'$", sql, re.I)
        if not folder:
            raise SqlError("SAVE needs a path")
        manifest = []
        for t in self.tables().values():
            self.rows(t.name).write.mode("overwrite").json(f"{folder[1]}/{t.name}")
            columns = [
                {"name": c.name, "type": c.type.simpleString(), "nullable": c.nullable, "unique": c.unique,
                 "primary_key": c.primary_key, "default": c.default} for c in t.columns
            ]
            manifest.append({"name": t.name, "columns": columns, "indexes": t.indexes, "next_row": t.next_row})
        self.session.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{folder[1]}/_manifest.d"
        )
        return CommandResult(f"{len(manifest)} tables saved", len(manifest))

    def _load(self, sql: str) -> CommandResult:
        folder = re.match(r"LOAD\s+'([^']+)'$", sql, re.I)
        if not folder:
            raise SqlError("LOAD needs a path")
        manifest = json.loads(self.session.read.text(f"{folder[1]}/_manifest.d").first()[0])
        for x in manifest:
            columns = tuple(
                Column(c["name"], T._parse_datatype_string(c["type"]), c["nullable"], c["unique"], c["primary_key"], c["default"])
                for c in x["columns"]
            )
            t = Table(x["name"], columns, indexes=tuple(map(tuple, x["indexes"])))
            self._store(t, self.session.read.schema(t.schema).json(f"{folder[1]}/{t.name}"), x["next_row"], lambda rows, t=t: _changes(t, "INSERT", rows), new=True)
        return CommandResult(f"{len(manifest)} tables loaded", len(manifest))
