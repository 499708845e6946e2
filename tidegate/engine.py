"""The engine: tables, views and policies around a Spark session, and statements of the dialect on them.

Tables are lists of Parquet files that no statement changes in place: each one makes the next list, so a transaction is
a copy of the map of names. An INSERT adds files; an UPDATE or DELETE writes only those files anew in which it finds
rows. Queries become one Spark SQL text; rows of changes are computed by joins on hidden row ids.
"""

from __future__ import annotations

import copy
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from types import SimpleNamespace as Record

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate import types
from tidegate.dialect.lexer import DialectError
from tidegate.dialect.statements import StatementReader
from tidegate.dialect.translate import Scope, Sql, Translator, name, value
from tidegate.functions import json
from tidegate.operators import constraints, partitions, recursive, search, security, temporal, vector_index
from tidegate.operators.constraints import ConstraintError
from tidegate.operators.temporal import CREATED, DELETED
from tidegate.plans import explain, statistics
from tidegate.session import dialect_session
from tidegate.sources import foreign, parquet
from tidegate.storage import add_files, canonical, delete_files, new_path, read_files, written

ROW, FILE, PART = "_row", "_file", "_partition"
HIDDEN = [ROW, CREATED, DELETED]
#: Triggers run row by row on the driver: rows of one statement, and triggers fired by triggers, at most.
MOST_TRIGGER_ROWS, MOST_TRIGGER_DEPTH = 1000, 16
#: An upsert's rows of one key are folded in shares of so many bytes at least, and of all keys with more of so many together.
FOLD_LEAST, FOLD_BYTES = 2 << 20, 128 << 20


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple  # records: name, type, not_null, default, auto, dims
    rows: DataFrame  # versions, with the hidden columns
    constraints: tuple = ()
    partition: Record | None = None
    secured: bool = False
    kind: str = "table"
    files: tuple | None = ()  # paths; None if rows are not those of files
    root: str = ""

    @property
    def parted(self) -> bool:
        """Whether rows are routed to partitions, which lie in folders of their own."""
        p = self.partition
        return p is not None and (p.how == "RANGE" and bool(p.bounds) or p.how in ("HASH", "LIST") and p.n > 0)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, wanted: str) -> Record:
        for c in self.columns:
            if c.name.lower() == wanted.lower():
                return c
        raise DialectError(f"{self.name} has no column {wanted}")

    def keys(self) -> list[list[str]]:
        return [c.columns for c in self.constraints if c.kind in ("primary", "unique")]


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, Record] = field(default_factory=dict)
    materialized: dict[str, Record] = field(default_factory=dict)
    foreign: dict[str, Record] = field(default_factory=dict)
    indexes: dict[str, Record] = field(default_factory=dict)
    policies: dict[str, Record] = field(default_factory=dict)
    procedures: dict[str, Record] = field(default_factory=dict)
    triggers: dict[str, Record] = field(default_factory=dict)

    def copy(self) -> State:
        return State(**{k: dict(v) for k, v in vars(self).items()})


class Engine:
    """sql(text, args) runs one statement and returns a DataFrame. A context manager; closing drops its views."""

    def __init__(self, spark: SparkSession, folder: str | None = None, user: str | None = None, role: str | None = None):
        self.spark = dialect_session(spark)
        self.folder, self.user, self.role = folder, user, role
        self.state, self.saved, self.variables, self.firing, self.json = State(), [], {}, 0, False
        self.past: set[str] = set()  # files that some state had
        self.filters: Counter = Counter()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for t in self.spark.catalog.listTables():
            if t.isTemporary:
                self.spark.catalog.dropTempView(t.name)

    # statements

    def sql(self, text: str, args: list | None = None) -> DataFrame:
        """Run one statement; ? stands for the next of args. Changes return rows_affected, or what RETURNING asks."""
        before = self.state.copy()
        if not self.json and "json_" in text.lower():  # the functions in Python are made known when they may be needed
            json.register(self.spark)
            self.json = True
        try:
            return self.run(StatementReader(text, self.scope(args, run=not text.lstrip().upper().startswith("EXPLAIN"))).statement())
        except Exception:
            self.state = before  # a statement that fails changes nothing
            raise

    query = execute = sql

    def translate(self, text: str, args: list | None = None) -> str:
        """The Spark SQL of a query; nothing runs."""
        return StatementReader(text, self.scope(args, run=False)).statement().sql

    def scope(self, args: list | None = None, run: bool = True) -> Scope:
        return Scope(table=self.resolve, args=list(args or []), recursive=self.recursion if run else self.unrun)

    def run(self, s: Record) -> DataFrame:
        if s.kind == "query":
            return self.spark.sql(s.sql)
        return getattr(self, f"do_{s.kind}")(s)

    def affected(self, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    # names

    def resolve(self, table: str, as_of: str | None = None) -> str:
        """The FROM item of a name: a temporary view of the table as it now is, or a view's query."""
        key = table.lower()
        st = self.state
        if key in st.views and as_of is None:
            return self.view_sql(st.views[key])
        if key in st.materialized and as_of is None:
            return self.shown(f"mv_{key}", st.materialized[key].rows)
        if key in st.foreign and as_of is None:
            f = st.foreign[key]
            return self.shown(f"foreign_{key}", foreign.open_table(self.spark, f.wrapper, [(c.name, types.spark_type(c.type)) for c in f.columns], f.options))
        if key not in st.tables:
            self.attach(key)
        if key not in st.tables:
            raise DialectError(f"no table {table}")
        t = st.tables[key]
        if t.kind == "external":
            if as_of is not None:
                raise DialectError(f"{table} keeps no versions")
            rows = t.rows
        else:
            rows = temporal.live(t.rows) if as_of is None else temporal.as_of(t.rows, temporal.seconds(as_of))
        if t.parted and PART in rows.columns:  # always true; with a value for the column it names the folders to read
            rows = rows.filter(F.col(PART).eqNullSafe(self.partition(t)))
        rows = rows.select(*[F.col(f"`{c}`") for c in t.names])
        if t.secured and self.user is not None:
            rows = rows.filter(self.policy(t, "SELECT"))
        return self.shown(f"{key}_{temporal.seconds(as_of)}" if as_of is not None else key, rows)

    def shown(self, view: str, rows: DataFrame) -> str:
        rows.createOrReplaceTempView(name(view))
        return name(view)

    def attach(self, key: str) -> None:
        """A Parquet table of the engine's folder, read when it is first named."""
        if not self.folder:
            return
        try:
            rows = parquet.table(self.spark, self.folder, key)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return
            raise
        columns = tuple(Record(name=f.name, type=types.dialect_type(f.dataType), not_null=False, default=None, auto=False, dims=0) for f in rows.schema.fields)
        self.state.tables[key] = Table(key, columns, rows, kind="external")

    def table(self, wanted: str) -> Table:
        """A table that can be changed; an external one becomes one of the engine's own."""
        key = wanted.lower()
        if key not in self.state.tables:
            self.attach(key)
        t = self.state.tables.get(key)
        if t is None:
            raise DialectError(f"no table {wanted}")
        if t.kind == "external":
            self.store(replace(t, kind="table"), self.stamped(t.rows))
            t = self.state.tables[key]
        return t

    def stamped(self, rows: DataFrame) -> DataFrame:
        batch = uuid.uuid4().hex[:12]
        return rows.withColumn(ROW, F.concat(F.lit(f"{batch}-"), F.monotonically_increasing_id().cast("string"))).withColumn(CREATED, F.lit(int(time.time())).cast("long")).withColumn(DELETED, F.lit(0).cast("long"))

    # tables as lists of files

    def partition(self, t: Table) -> Column:
        p = t.partition
        return partitions.route(p.column, p.how, p.bounds, p.n)

    def added(self, t: Table, rows: DataFrame) -> tuple[str, list[str]]:
        """The table's folder, and the files there that the rows are written to; rows of a partition lie by themselves."""
        root = t.root or new_path(self.spark, "table")
        rows = rows.select(*[F.col(f"`{c}`") for c in t.names], *HIDDEN)
        return root, add_files(rows.withColumn(PART, self.partition(t)), root, PART) if t.parted else add_files(rows, root)

    def read(self, t: Table, files: list[str], located: bool = False) -> DataFrame:
        schema = self.empty(t.columns).schema
        return read_files(self.spark, schema.add(PART, "string") if t.parted else schema, files, PART if t.parted else None, FILE if located else None)

    def with_files(self, t: Table, root: str, files: list[str]) -> Table:
        new = replace(t, rows=self.read(t, files), files=tuple(files), root=root)
        self.state.tables[t.name.lower()] = new
        return new

    def store(self, t: Table, rows: DataFrame) -> None:
        """The table with these rows instead of its own."""
        self.with_files(t, *self.added(t, rows))

    def append(self, t: Table, rows: DataFrame) -> None:
        if t.files is None:
            self.store(t, t.rows.select(*t.names, *HIDDEN).unionByName(rows.select(*t.names, *HIDDEN)))
            return
        root, files = self.added(t, rows)
        self.with_files(t, root, [*t.files, *files])

    def located(self, t: Table) -> DataFrame:
        """The table's rows with the file that each lies in."""
        return self.read(t, list(t.files), located=True) if t.files else t.rows.withColumn(FILE, F.lit(None).cast("string"))

    def rewrite(self, t: Table, hits: DataFrame, change: Callable[[DataFrame], DataFrame], fresh: DataFrame | None = None) -> None:
        """Change the rows that hits(_row, _file) names: only their files are written anew. fresh: further rows."""
        if t.files is None:
            rows = change(t.rows).select(*t.names, *HIDDEN)
            self.store(t, rows if fresh is None else rows.unionByName(fresh.select(*t.names, *HIDDEN)))
            return
        touched = {canonical(r[0]) for r in hits.select(FILE).distinct().collect()}  # at most the table's files
        kept, root, new = [f for f in t.files if f not in touched], t.root, []
        if touched:
            root, new = self.added(t, change(self.read(t, [f for f in t.files if f in touched])))
        if fresh is not None:
            root, more = self.added(replace(t, root=root), fresh)
            new += more
        self.with_files(t, root, [*kept, *new])

    def view_sql(self, view: Record) -> str:
        reader = Translator("SELECT 1", self.scope())
        reader.tokens, reader.at = [*view.tokens, reader.tokens[-1]], 0
        body = reader.query()
        return f"(SELECT * FROM ({body}) AS _v({', '.join(map(name, view.columns))}))" if view.columns else f"({body})"

    def unrun(self, cte: str, columns: list[str], base: str, step: str, earlier: list[str]) -> str:
        """What stands for a recursion where nothing may run: the rows that it begins with."""
        first = self.spark.sql((f"WITH {', '.join(earlier)} " if earlier else "") + base)
        return self.shown(f"_recursive_{cte}", first.toDF(*columns) if columns else first).strip("`")

    def recursion(self, cte: str, columns: list[str], base: str, step: str, earlier: list[str]) -> str:
        """WITH RECURSIVE ... UNION, by a fixed point on the driver's side; the name of a view of its rows."""
        head = f"WITH {', '.join(earlier)} " if earlier else ""
        first = self.spark.sql(head + base)
        first = first.toDF(*columns) if columns else first

        def once(rows: DataFrame) -> DataFrame:
            rows.createOrReplaceTempView(name(cte))
            return self.spark.sql(head + step)

        return self.shown(f"_recursive_{cte}_{uuid.uuid4().hex[:6]}", recursive.fixpoint(first, once)).strip("`")

    # queries about things

    def do_explain(self, s: Record) -> DataFrame:
        if s.inner.kind == "query":
            df = self.spark.sql(s.inner.sql)
            self.filters.update(explain.filtered_columns(df))
            return explain.explain(df).to(self.spark.createDataFrame([], explain.SCHEMA).schema)
        return self.spark.createDataFrame([(1, None, s.inner.kind.upper(), getattr(s.inner, "table", ""), 0.0, -1)], explain.SCHEMA)

    def recommendations(self) -> DataFrame:
        """Columns by how often explained queries filter or join by them: keys to lay tables out by."""
        return self.spark.createDataFrame(sorted(self.filters.items(), key=lambda x: (-x[1], x[0])), "column_name string, uses long")

    def listing(self) -> list[tuple[str, str]]:
        st = self.state
        return sorted([(t.name, "table") for t in st.tables.values()] + [(v.name, "view") for v in st.views.values()] + [(v.name, "materialized view") for v in st.materialized.values()] + [(f.name, "foreign table") for f in st.foreign.values()])

    tables = property(lambda self: [n for n, _ in self.listing()])

    def do_show_tables(self, s: Record) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n, _ in self.listing()], "table_name string")

    def do_show_databases(self, s: Record) -> DataFrame:
        return self.spark.createDataFrame([("main",)], "database_name string")

    def do_describe(self, s: Record) -> DataFrame:
        key = s.table.lower()
        if key in self.state.views or key in self.state.materialized or key in self.state.foreign:
            schema = self.spark.sql(f"SELECT * FROM {self.resolve(s.table)}").schema
            rows = [(f.name, types.dialect_type(f.dataType), "YES", "", None, "") for f in schema.fields]
        else:
            self.resolve(s.table)
            t = self.state.tables[key]
            primary = {c.lower() for k in t.constraints if k.kind == "primary" for c in k.columns}
            unique = {k.columns[0].lower() for k in t.constraints if k.kind == "unique" and len(k.columns) == 1}
            rows = [(c.name, c.type, "NO" if c.not_null or c.name.lower() in primary else "YES", "PRI" if c.name.lower() in primary else "UNI" if c.name.lower() in unique else "", c.default, "auto_increment" if c.auto else "") for c in t.columns]
        return self.spark.createDataFrame(rows, "Field string, Type string, `Null` string, `Key` string, `Default` string, Extra string")

    def do_show_create(self, s: Record) -> DataFrame:
        return self.spark.createDataFrame([self.ddl(s.table)], "table_name string, create_statement string")

    def export(self) -> list[str]:
        """Statements that make all definitions again: tables, views, materialized views, indexes, triggers."""
        st = self.state
        out = [self.ddl(n)[1] for n in [*st.tables, *st.views, *st.materialized]]
        for i in st.indexes.values():
            out.append(f"CREATE {'UNIQUE ' if i.unique else ''}INDEX {i.name} ON {i.table} ({', '.join(i.columns)})")
        for g in st.triggers.values():
            test = f" WHEN {text_of(g.test)}" if g.test else ""
            out.append(f"CREATE TRIGGER {g.name} {g.when}{' OF' if g.when == 'INSTEAD' else ''} {g.event} ON {g.table}{test} BEGIN {' '.join(text_of(b) + ';' for b in g.body)} END")
        return out

    def ddl(self, wanted: str) -> tuple[str, str]:
        for kind, views in (("VIEW", self.state.views), ("MATERIALIZED VIEW", self.state.materialized)):
            if wanted.lower() in views:
                v = views[wanted.lower()]
                columns = f" ({', '.join(v.columns)})" if v.columns else ""
                return v.name, f"CREATE {kind} {v.name}{columns} AS {text_of(v.tokens)}"
        self.resolve(wanted)
        t = self.state.tables[wanted.lower()]
        parts = [f"{c.name} {c.type}{' NOT NULL' if c.not_null else ''}{f' DEFAULT {c.default}' if c.default else ''}{' AUTO_INCREMENT' if c.auto else ''}" for c in t.columns]
        for k in t.constraints:
            if k.kind in ("primary", "unique"):
                parts.append(f"{'PRIMARY KEY' if k.kind == 'primary' else 'UNIQUE'} ({', '.join(k.columns)})")
            elif k.kind == "check":
                parts.append(f"CHECK ({k.sql})")
            else:
                parts.append(f"FOREIGN KEY ({', '.join(k.columns)}) REFERENCES {k.table} ({', '.join(k.target)}) ON DELETE {k.delete} ON UPDATE {k.update}")
        p, by = t.partition, ""
        if p:
            bounds = ", ".join(f"PARTITION {n} VALUES LESS THAN {'MAXVALUE' if b is None else f'({b})'}" for n, b in p.bounds or [])
            by = f" PARTITION BY {p.how}({p.column})" + (f" ({bounds})" if bounds else f" PARTITIONS {p.n}")
        return t.name, f"CREATE TABLE {t.name} ({', '.join(parts)}){by}"

    def do_show_index(self, s: Record) -> DataFrame:
        rows = [(i.table, i.name, ",".join(i.columns), bool(i.unique)) for i in self.state.indexes.values() if i.table.lower() == s.table.lower()]
        return self.spark.createDataFrame(rows, "table_name string, index_name string, columns string, is_unique boolean")

    def do_analyze(self, s: Record) -> DataFrame:
        names = [s.table] if s.table else [t.name for t in self.state.tables.values()]
        out = None
        for n in names:
            one = statistics.analyze(self.spark.sql(f"SELECT * FROM {self.resolve(n)}")).select(F.lit(n).alias("table_name"), "*")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.affected()

    def do_vacuum(self, s: Record) -> DataFrame:
        """Deleted versions go, files are written anew, and files that neither this state nor an open transaction has are deleted."""
        for n in [s.table] if s.table else list(self.state.tables):
            t = self.state.tables.get(n.lower())
            if t and t.kind != "external":
                self.store(t, temporal.live(t.rows))
                self.past |= set(t.files or ())
        states = [self.state, *(state for _, state in self.saved)]
        used = {f for state in states for t in state.tables.values() for f in t.files or ()}
        derived = any(t.files is None for state in states for t in state.tables.values())  # may still read any file
        if not derived:
            delete_files(self.spark, sorted(self.past - used))
            self.past &= used
        return self.affected()

    def do_nothing(self, s: Record) -> DataFrame:
        return self.affected()

    def do_set(self, s: Record) -> DataFrame:
        self.variables[s.name.lower()] = s.value
        return self.affected()

    # definitions

    def free(self, key: str, s: Record) -> bool:
        """Whether the name can be made; fails if it is taken and nobody said IF NOT EXISTS."""
        taken = any(key in m for m in (self.state.tables, self.state.views, self.state.materialized, self.state.foreign))
        if taken and not s.quiet:
            raise DialectError(f"{s.name} is there already")
        return not taken

    def empty(self, columns) -> DataFrame:
        fields = [f"{name(c.name)} {types.spark_type(c.type)}" for c in columns]
        return self.spark.createDataFrame([], ", ".join([*fields, f"{ROW} string", f"{CREATED} long", f"{DELETED} long"]))

    def do_create_table(self, s: Record) -> DataFrame:
        if not self.free(s.name.lower(), s):
            return self.affected()
        if s.sql is not None and not s.columns:
            rows = self.spark.sql(s.sql)
            if len(set(c.lower() for c in rows.columns)) < len(rows.columns):
                raise DialectError("columns need different names")
            rows = rows.select(*[F.col(f"`{f.name}`").cast(types.spark_type(types.dialect_type(f.dataType))).alias(f.name) for f in rows.schema.fields])
            s.columns = [Record(name=f.name, type=types.dialect_type(f.dataType), not_null=False, default=None, auto=False, dims=0) for f in rows.schema.fields]
            versions = self.stamped(rows)
        else:
            versions = None
        for k in s.constraints:
            if k.kind == "foreign" and not k.target:
                parent = self.table(k.table)
                k.target = next((p.columns for p in parent.constraints if p.kind == "primary"), parent.names[:1])
        t = Table(s.name, tuple(s.columns), self.empty(s.columns), tuple(s.constraints), s.partition)
        self.state.tables[s.name.lower()] = t
        if versions is not None:
            self.store(t, versions)
        return self.affected()

    def do_create_collection(self, s: Record) -> DataFrame:
        if self.free(s.name.lower(), s):
            columns = (Record(name="_id", type="INTEGER", not_null=False, default=None, auto=True, dims=0), Record(name="data", type="JSON", not_null=False, default=None, auto=False, dims=0))
            self.state.tables[s.name.lower()] = Table(s.name, columns, self.empty(columns), (Record(kind="primary", name="", columns=["_id"]),), kind="collection")
        return self.affected()

    def do_create_view(self, s: Record) -> DataFrame:
        key = s.name.lower()
        if s.replace:
            self.state.views.pop(key, None)
        if self.free(key, s):
            self.spark.sql(s.sql)  # it must be a query that can be read
            self.state.views[key] = s
        return self.affected()

    def do_create_materialized(self, s: Record) -> DataFrame:
        if self.free(s.name.lower(), s):
            s.rows = written(self.spark.sql(s.sql), "materialized")
            self.state.materialized[s.name.lower()] = s
        return self.affected()

    def do_refresh(self, s: Record) -> DataFrame:
        key = s.name.lower()
        if key not in self.state.materialized:
            raise DialectError(f"no materialized view {s.name}")
        new = copy.copy(self.state.materialized[key])
        new.rows = written(self.spark.sql(f"SELECT * FROM {self.view_sql(new)}"), "materialized")
        self.state.materialized[key] = new
        return self.affected()

    def do_create_foreign(self, s: Record) -> DataFrame:
        if self.free(s.name.lower(), s):
            self.state.foreign[s.name.lower()] = s
        return self.affected()

    def do_create_index(self, s: Record) -> DataFrame:
        """Spark has no indexes: a unique one is a constraint, others are listed only."""
        if s.name.lower() in self.state.indexes:
            if s.quiet:
                return self.affected()
            raise DialectError(f"{s.name} is there already")
        if s.unique:
            t = self.table(s.table)
            constraints.demand(constraints.duplicates(temporal.live(t.rows), s.columns), f"UNIQUE: {s.table} has equal {', '.join(s.columns)}")
            self.state.tables[t.name.lower()] = replace(t, constraints=(*t.constraints, Record(kind="unique", name=s.name, columns=s.columns)))
        else:
            self.resolve(s.table)
        self.state.indexes[s.name.lower()] = s
        return self.affected()

    def do_create_fulltext(self, s: Record) -> DataFrame:
        """Its postings are written, for search_text."""
        self.do_create_index(s)
        rows = self.spark.sql(f"SELECT * FROM {self.resolve(s.table)}")
        key = next((k[0] for k in self.state.tables[s.table.lower()].keys() if len(k) == 1), rows.columns[0])
        s.key, s.postings = key, written(search.postings(rows, key, s.columns), "postings")
        return self.affected()

    def do_create_vector(self, s: Record) -> DataFrame:
        """Every row of the table as it now is goes to a list of vectors near each other."""
        self.do_create_index(s)
        self.resolve(s.table)
        s.of = self.state.tables[s.table.lower()].rows
        s.vectors = vector_index.build(self.spark.sql(f"SELECT * FROM {self.resolve(s.table)}"), s.columns[0])
        return self.affected()

    def search_text(self, index: str, words: str) -> DataFrame:
        """Keys of the rows that hold all words, as of the index's creation."""
        i = self.state.indexes[index.lower()]
        return search.search(i.postings, i.key, words)

    def search_vector(self, index: str, q: list[float], k: int | None = None, radius: float | None = None, exact: bool = True) -> DataFrame:
        """The k nearest rows, or those within a radius, by L2 distance; not exact: those of the lists nearest to q.

        An index is as old as its creation: once the table has changed, or where a policy hides rows, all rows are searched.
        """
        i = self.state.indexes[index.lower()]
        t = self.state.tables.get(i.table.lower())
        if k is not None and t is not None and t.rows is i.of and not (t.secured and self.user is not None):
            return vector_index.nearest(i.vectors, q, k, exact=exact)
        rows = self.spark.sql(f"SELECT * FROM {self.resolve(i.table)}")
        return search.knn(rows, i.columns[0], q, k) if k is not None else search.within(rows, i.columns[0], q, radius or 0.0)

    def do_create_trigger(self, s: Record) -> DataFrame:
        if s.name.lower() in self.state.triggers and not s.quiet:
            raise DialectError(f"{s.name} is there already")
        self.state.triggers.setdefault(s.name.lower(), s)
        return self.affected()

    def fire(self, t: Table, event: str, old: DataFrame | None, new: DataFrame | None, before: bool = False) -> None:
        """Run the table's triggers, one changed row after the other, by the driver: for small changes only.

        BEFORE triggers run while the table is still as it was, the others once it is changed.
        """
        mine = [g for g in self.state.triggers.values() if g.table.lower() == t.name.lower() and g.event == event and (g.when == "BEFORE") == before]
        if not mine:
            return
        if self.firing >= MOST_TRIGGER_DEPTH:
            raise DialectError("triggers fire each other without end")
        both = {k: {r[ROW]: r.asDict() for r in df.limit(MOST_TRIGGER_ROWS + 1).collect()} if df is not None else {} for k, df in (("old", old), ("new", new))}
        changed = list(both["new"] or both["old"])
        if len(changed) > MOST_TRIGGER_ROWS:
            raise DialectError(f"triggers of {t.name} fire for at most {MOST_TRIGGER_ROWS} rows of a statement")
        self.firing += 1
        try:
            for g in mine:
                for row in sorted(changed):
                    bound = {f"{k}.{c.lower()}": value(v) for k in both for c, v in both[k].get(row, {}).items()}
                    if g.test and not self.spark.sql(f"SELECT {self.reader(g.test, bound).expression().condition}").first()[0]:
                        continue
                    for statement in g.body:
                        self.run(self.reader(statement, bound).statement())
        finally:
            self.firing -= 1

    def instead(self, s: Record) -> DataFrame:
        """A change of a view's rows: its INSTEAD OF triggers run for each of them."""
        event = s.kind.upper()
        if not any(g.table.lower() == s.table.lower() and g.event == event and g.when == "INSTEAD" for g in self.state.triggers.values()):
            raise DialectError(f"{s.table} is a view without an INSTEAD OF {event} trigger")
        rows = self.spark.sql(f"SELECT * FROM {self.resolve(s.table)}")
        columns = tuple(Record(name=f.name, type=types.dialect_type(f.dataType), not_null=False, default=None, auto=False, dims=0) for f in rows.schema.fields)
        t = Table(s.table, columns, written(self.stamped(rows)), kind="view")
        if event == "INSERT":
            old, new = None, written(self.stamped(self.new_rows(t, s).drop("_pos")))
        else:
            select = "".join(f", ({x}) AS {name('_set_' + t.column(c).name)}" for c, x in getattr(s, "sets", []))
            found = self.hits(t, s, select, event)
            old = written(t.rows.join(found.select(ROW), ROW, "left_semi"))
            new = written(self.with_changes(t, t.rows, found, [t.column(c).name for c, _ in s.sets])[1]) if event == "UPDATE" else None
        self.fire(t, event, old, new)
        return self.returned(t, old if new is None else new, s.returning)

    def do_create_procedure(self, s: Record) -> DataFrame:
        if s.name.lower() in self.state.procedures and not s.quiet and not s.replace:
            raise DialectError(f"{s.name} is there already")
        self.state.procedures.setdefault(s.name.lower(), s)
        return self.affected()

    def do_create_policy(self, s: Record) -> DataFrame:
        key = f"{s.table}.{s.name}".lower()
        if key in self.state.policies:
            raise DialectError(f"{s.name} is there already")
        self.table(s.table)
        self.state.policies[key] = s
        return self.affected()

    def policy(self, t: Table, operation: str, check: bool = False) -> str:
        mine = [p for p in self.state.policies.values() if p.table.lower() == t.name.lower()]
        me = value(self.user)
        return security.predicate(mine, operation, self.role, check).replace("'root@localhost'", me)

    def _drop(self, where: dict, s: Record) -> DataFrame:
        if where.pop(s.name.lower(), None) is None and not s.quiet:
            raise DialectError(f"no {s.kind[5:]} {s.name}")
        return self.affected()

    def do_drop_table(self, s: Record) -> DataFrame:
        return self._drop(self.state.foreign if s.name.lower() in self.state.foreign else self.state.tables, s)

    do_drop_collection = do_drop_table
    do_drop_view = lambda self, s: self._drop(self.state.views, s)
    do_drop_materialized = lambda self, s: self._drop(self.state.materialized, s)
    do_drop_procedure = lambda self, s: self._drop(self.state.procedures, s)
    do_drop_trigger = lambda self, s: self._drop(self.state.triggers, s)

    def do_drop_index(self, s: Record) -> DataFrame:
        i = self.state.indexes.get(s.name.lower())
        if i is not None and i.unique and i.table.lower() in self.state.tables:
            t = self.state.tables[i.table.lower()]
            self.state.tables[i.table.lower()] = replace(t, constraints=tuple(k for k in t.constraints if k.name != i.name))
        return self._drop(self.state.indexes, s)

    def do_drop_policy(self, s: Record) -> DataFrame:
        if self.state.policies.pop(f"{s.table}.{s.name}".lower(), None) is None and not s.quiet:
            raise DialectError(f"no policy {s.name}")
        return self.affected()

    def do_alter(self, s: Record) -> DataFrame:
        t, key = self.table(s.table), s.table.lower()
        put = lambda **k: self.state.tables.__setitem__(key, replace(t, **k))
        if s.action == "enable_rls" or s.action == "disable_rls":
            put(secured=s.action == "enable_rls")
        elif s.action == "add_column":
            if s.column.name.lower() in map(str.lower, t.names):
                raise DialectError(f"{s.table} has {s.column.name} already")
            new = F.expr(f"cast({s.column.default or 'NULL'} AS {types.spark_type(s.column.type)})")
            if s.column.not_null and s.column.default is None:
                constraints.demand(temporal.live(t.rows), f"NOT NULL: {s.column.name} needs a default")
            put(columns=(*t.columns, s.column), rows=t.rows.withColumn(s.column.name, new), constraints=(*t.constraints, *s.constraints), files=None)
        elif s.action == "drop_column":
            t.column(s.name)
            if t.partition and t.partition.column.lower() == s.name.lower():
                raise DialectError(f"{s.table} is partitioned by {s.name}")
            put(columns=tuple(c for c in t.columns if c.name.lower() != s.name.lower()), rows=t.rows.drop(s.name), files=None, constraints=tuple(k for k in t.constraints if s.name.lower() not in map(str.lower, getattr(k, "columns", []))))
        elif s.action == "rename_column":
            old = t.column(s.name)
            new = copy.copy(old)
            new.name = s.to
            if s.to.lower() != s.name.lower() and s.to.lower() in map(str.lower, t.names):
                raise DialectError(f"{s.table} has {s.to} already")
            part = copy.copy(t.partition)
            if part and part.column.lower() == s.name.lower():
                part.column = s.to
            put(columns=tuple(new if c is old else c for c in t.columns), rows=t.rows.withColumnRenamed(old.name, s.to), partition=part, files=None)
            self.renamed(key, key, {s.name.lower(): s.to})
        elif s.action == "rename":
            if s.to.lower() != key and not self.free(s.to.lower(), Record(name=s.to, quiet=False)):
                return self.affected()
            del self.state.tables[key]
            self.state.tables[s.to.lower()] = replace(t, name=s.to)
            self.renamed(key, s.to, {})
        elif s.action == "add_constraint":
            k = s.constraint
            if k.kind == "foreign" and not k.target:
                parent = self.table(k.table)
                k.target = next((p.columns for p in parent.constraints if p.kind == "primary"), parent.names[:1])
            rows = temporal.live(t.rows)
            self.check(replace(t, constraints=(k,)), rows, rows)
            put(constraints=(*t.constraints, k))
        elif s.action == "drop_constraint":
            left = tuple(k for k in t.constraints if k.name.lower() != s.name.lower())
            if len(left) == len(t.constraints):
                raise DialectError(f"no constraint {s.name}")
            put(constraints=left)
        return self.affected()

    def renamed(self, old: str, new: str, columns: dict[str, str]) -> None:
        """Whatever names the table, or columns of it, by their old names gets the new ones."""
        swap = lambda names: [columns.get(c.lower(), c) for c in names]

        def text(sql: str) -> str:
            return re.sub(r"'(?:[^'\\]|\\.)*'|`((?:[^`]|``)+)`", lambda m: name(columns[m[1].lower()]) if m[1] and m[1].lower() in columns else m[0], sql)

        def constraint(k: Record, own: bool) -> Record:
            k = copy.copy(k)
            if own and hasattr(k, "columns"):
                k.columns = swap(k.columns)
            if own and k.kind == "check":
                k.sql = text(k.sql)
            if k.kind == "foreign" and k.table.lower() == old:
                k.table, k.target = new, swap(k.target)
            return k

        st = self.state
        for key, t in st.tables.items():
            st.tables[key] = replace(t, constraints=tuple(constraint(k, key == new.lower()) for k in t.constraints))
        for holder in (st.indexes, st.triggers, st.policies):
            for key, x in list(holder.items()):
                if x.table.lower() != old:
                    continue
                x = copy.copy(x)
                x.table = new
                if hasattr(x, "columns"):
                    x.columns = swap(x.columns)
                if holder is st.policies:
                    x.using, x.check = text(x.using), text(x.check)
                    del holder[key]
                    key = f"{new}.{x.name}".lower()
                holder[key] = x

    # transactions: copies of the state

    def do_begin(self, s: Record) -> DataFrame:
        if any(not n for n, _ in self.saved):
            raise DialectError("a transaction is open already")
        self.saved = [("", self.state.copy())]
        return self.affected()

    def do_commit(self, s: Record) -> DataFrame:
        self.saved = []
        return self.affected()

    def do_rollback(self, s: Record) -> DataFrame:
        wanted = s.name.lower()
        at = max((i for i, (n, _) in enumerate(self.saved) if n == wanted), default=-1)
        if at < 0:
            raise DialectError(f"no savepoint {s.name}" if wanted else "no transaction")
        self.state = self.saved[at][1].copy()
        self.saved = self.saved[: at + 1] if wanted else []
        return self.affected()

    def do_savepoint(self, s: Record) -> DataFrame:
        self.saved.append((s.name.lower(), self.state.copy()))
        return self.affected()

    def do_release(self, s: Record) -> DataFrame:
        self.saved = [x for x in self.saved if x[0] != s.name.lower()]
        return self.affected()

    def do_call(self, s: Record) -> DataFrame:
        """Runs a procedure's statements with its parameters replaced; the last one's result is returned.

        SET of an OUT parameter gives it a value, which later statements see and, without other results, is returned.
        """
        p = self.state.procedures.get(s.name.lower())
        if p is None:
            raise DialectError(f"no procedure {s.name}")
        given = iter(s.args)
        bound = {n.lower(): next(given, "NULL") if mode != "OUT" or len(s.args) == len(p.params) else "NULL" for mode, n in p.params}
        outs = [n.lower() for mode, n in p.params if mode != "IN"]
        result, from_query = self.affected(), False
        for statement in p.body:
            if statement[0].upper == "SET" and len(statement) > 2 and statement[1].text.lower() in bound:
                reader = self.reader(statement[3:], bound)
                bound[statement[1].text.lower()] = value(self.spark.sql(f"SELECT {reader.expression().text}").first()[0])
                continue
            record = self.reader(statement, bound).statement()
            result, from_query = self.run(record), from_query or record.kind == "query"
        if outs and not from_query:
            return self.spark.sql("SELECT " + ", ".join(f"{bound[o]} AS {name(o)}" for o in outs))
        return result

    def reader(self, statement: list, bound: dict[str, str]) -> StatementReader:

        class Bound(StatementReader):
            def primary(self):
                t = self.now
                if t.kind == "word" and t.text.lower() in bound and self.ahead().text not in (".", "("):
                    self.take()
                    return Sql(bound[t.text.lower()], constant=True)
                if t.kind == "word" and self.ahead().text == "." and f"{t.text}.{self.ahead(2).text}".lower() in bound:
                    self.at += 3
                    return Sql(bound[f"{t.text}.{self.tokens[self.at - 1].text}".lower()], constant=True)
                return super().primary()

        out = Bound("SELECT 1", self.scope())
        out.tokens = [*statement, out.tokens[-1]]
        return out

    # changes of rows

    def returned(self, t: Table, rows: DataFrame, returning: str | None, n: int | None = None) -> DataFrame:
        if returning is None:
            return self.affected(rows.count() if n is None else n)
        rows = written(rows.select(*[F.col(f"`{c}`") for c in t.names]), "returned")
        return self.spark.sql(f"SELECT {returning} FROM {self.shown('_returned', rows)} AS {name(t.name)}")

    def check(self, t: Table, new: DataFrame, after: DataFrame) -> None:
        """Fail if new rows break a constraint of the table as it will be."""
        needed = [c.name for c in t.columns if c.not_null] + [c for k in t.constraints if k.kind == "primary" for c in k.columns]
        if needed:
            constraints.demand(new.filter(constraints.nulls(new, needed)), f"NOT NULL: {t.name} needs {', '.join(needed)}")
        for c in t.columns:
            if c.dims:
                constraints.demand(new.filter(F.size(F.col(c.name)) != c.dims), f"VECTOR: {c.name} has {c.dims} dimensions")
        for k in t.constraints:
            if k.kind in ("primary", "unique"):
                # only keys of new rows can have become equal to others: a semi-join with these few
                same = after if new is after else after.join(new.select(*k.columns).distinct(), list(k.columns), "left_semi")
                constraints.demand(constraints.duplicates(same, k.columns), f"UNIQUE: {t.name} has equal {', '.join(k.columns)}")
            elif k.kind == "check":
                constraints.demand(new.filter(F.expr(f"NOT coalesce({k.sql}, TRUE)")), f"CHECK: {k.sql}")
            elif k.kind == "foreign":
                parent = after if k.table.lower() == t.name.lower() else temporal.live(self.table(k.table).rows)
                constraints.demand(constraints.orphans(new, k.columns, parent, k.target), f"FOREIGN KEY: {k.table} has no such {', '.join(k.target)}")
        if t.secured and self.user is not None:
            constraints.demand(new.filter(f"NOT ({self.policy(t, 'INSERT', check=True)})"), f"policy of {t.name}")
        if t.partition and t.partition.how == "RANGE":
            constraints.demand(new.filter(partitions.route(t.partition.column, "RANGE", t.partition.bounds).isNull()), f"no partition of {t.name} for the row")

    def new_rows(self, t: Table, s: Record) -> DataFrame:
        """The rows to insert with the table's columns, and _pos, their place."""
        columns = [t.column(c).name for c in s.columns] or t.names
        default = {c.name: c.default or "NULL" for c in t.columns}
        if s.rows is not None:
            rows = s.rows
            if rows == [[]]:
                columns = []
            if any(len(r) != len(columns) for r in rows):
                raise DialectError(f"{len(columns)} values are needed")
            filled = []
            for i, r in enumerate(rows):
                given = dict(zip(columns, r))
                cells = [given[c.name] if given.get(c.name) is not None else default[c.name] for c in t.columns]
                filled.append(f"SELECT {i}L AS _pos, " + ", ".join(f"try_cast({x} AS {types.spark_type(c.type)}) AS {name(c.name)}" for x, c in zip(cells, t.columns)))
            out = self.spark.sql(" UNION ALL ".join(filled)) if len(filled) < 2 or any("SELECT" in f[6:] for f in filled) else self.inline(t, filled)
        else:
            source = self.spark.sql(s.sql)
            if len(source.columns) != len(columns):
                raise DialectError(f"{len(columns)} columns are needed")
            source = source.toDF(*[f"_c{i}" for i in range(len(columns))]).withColumn("_pos", F.monotonically_increasing_id())
            place = {c: f"_c{i}" for i, c in enumerate(columns)}
            out = source.select("_pos", *[F.expr(f"try_cast({place.get(c.name, default[c.name])} AS {types.spark_type(c.type)})").alias(c.name) for c in t.columns])
        primary = next((k.columns for k in t.constraints if k.kind == "primary"), [])
        for c in t.columns:
            if c.auto or (primary == [c.name] and types.spark_type(c.type) == "bigint"):
                if out.filter(F.col(c.name).isNull()).take(1):
                    top = temporal.live(t.rows).agg(F.max(c.name)).first()[0] or 0
                    if s.rows is not None:
                        out = out.withColumn(c.name, F.coalesce(F.col(c.name), F.col("_pos") + 1 + top))
                    else:  # places of one insertion, numbered within each task's share
                        out = written(out, "new")
                        share = F.shiftright("_pos", 33)
                        counts = out.groupBy(share.alias("_share")).agg(F.count("*").alias("_n"))
                        before = counts.select("_share", (F.sum("_n").over(Window.orderBy("_share")) - F.col("_n")).alias("_before"))
                        number = F.col("_before") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + top
                        out = out.withColumn("_share", share).join(before, "_share").withColumn(c.name, F.coalesce(F.col(c.name), number)).drop("_share", "_before")
        return written(out, "new")

    def inline(self, t: Table, filled: list[str]) -> DataFrame:
        """Many rows of literals as one table; expressions that are no literals keep a SELECT for each row."""
        rows = ", ".join("(" + re.sub(r" AS (_pos|`(?:[^`]|``)+`)(?=, |$)", "", f[7:]) + ")" for f in filled)
        try:
            return self.spark.sql(f"SELECT * FROM VALUES {rows} AS v(_pos, {', '.join(map(name, t.names))})")
        except AnalysisException:
            return self.spark.sql(" UNION ALL ".join(filled))

    def do_insert(self, s: Record) -> DataFrame:
        if s.table.lower() in self.state.views:
            return self.instead(s)
        t = self.table(s.table)
        new = self.new_rows(t, s)
        keys = [[t.column(c).name for c in s.on]] if s.on else t.keys()
        if s.conflict == "UPDATE" and (len(keys) > 1 or any(constraints.duplicates(new, key).take(1) for key in keys)):
            folded = self.folded(t, s, new, keys[0]) if len(keys) == 1 else None
            if folded is None:
                return self.inserted_in_order(t, s, new, keys)
            old, fresh, changed, n = folded
            return self.returned(t, self.put(t, s, old, fresh, changed), s.returning, n)
        touched = self.insert(t, s, new, keys)
        return self.returned(t, touched, s.returning)

    def folded(self, t: Table, s: Record, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
        """New rows that meet each other's key, one after the other, in one pass over each key's rows and one change of the table.

        The rows of the table that they meet, the rows to insert, the values to change, and how many rows were inserted
        or changed, each time counted. None where what lies between counts (triggers, or values that other rows are
        compared with) or an expression cannot be evaluated within an array.
        """
        sets = {t.column(c).name: x for c, x in s.sets}
        fixed = {c.lower() for c in key} | {c.lower() for k in t.constraints if k.kind in ("primary", "unique", "foreign") for c in k.columns}
        fixed |= {t.partition.column.lower()} if t.partition else set()
        if len(sets) < len(s.sets) or fixed & {c.lower() for c in sets} or t.secured and self.user is not None:
            return None
        if any(g.table.lower() == t.name.lower() and g.event in ("INSERT", "UPDATE") for g in self.state.triggers.values()):
            return None
        here = {(s.alias or t.name).lower(): "`_old`.`row`", "excluded": "`_add`", "": "`_old`.`row`"}

        def of(sql: str) -> str:
            """An expression on the row that is there and on excluded as one on the fold's."""
            return re.sub(r"'(?:[^'\\]|\\.)*'|(?:`((?:[^`]|``)+)`\.)?(`(?:[^`]|``)+`)", lambda m: f"{here[(m[1] or '').lower()]}.{m[2]}" if m[2] and (m[1] or "").lower() in here else m[0], sql)

        hit = f"coalesce({of(s.where)}, FALSE)" if s.where else "TRUE"
        cells = ", ".join(f"{value(c)}, " + (f"CASE WHEN {hit} THEN try_cast(({of(sets[c])}) AS {types.spark_type(t.column(c).type)}) ELSE `_old`.`row`.{name(c)} END" if c in sets else f"`_old`.`row`.{name(c)}") for c in t.names)
        # each step checks the row as the step before left it; the last one is checked when it is written
        needed = [c.name for c in t.columns if c.not_null] + [c for k in t.constraints if k.kind == "primary" for c in k.columns]
        bad = [(f"`_old`.`row`.{name(c)} IS NULL", f"NOT NULL: {t.name} needs {', '.join(needed)}") for c in needed]
        bad += [(f"size(`_old`.`row`.{name(c.name)}) != {c.dims}", f"VECTOR: {c.name} has {c.dims} dimensions") for c in t.columns if c.dims]
        bad += [(f"NOT coalesce({of(k.sql)}, TRUE)", f"CHECK: {k.sql}") for k in t.constraints if k.kind == "check"]
        wrong = f"CASE {' '.join(f'WHEN {test} THEN {value(what)}' for test, what in bad)} END" if bad else "cast(NULL AS string)"
        step = f"named_struct('row', named_struct({cells}), 'n', `_old`.`n` + CASE WHEN {hit} THEN 1L ELSE 0L END, 'bad', coalesce(`_old`.`bad`, {wrong}))"
        fold = F.expr(f"CASE WHEN _rows IS NULL THEN _fold ELSE aggregate(_rows, _fold, (`_old`, `_add`) -> {step}) END")

        keyed = new.filter(~constraints.nulls(new, key))
        old = temporal.live(self.located(t)).join(keyed.select(*key).distinct(), key, "left_semi")
        begin = F.struct(F.struct(*[F.col(f"`{c}`") for c in t.names]).alias("row"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("bad")).alias("_fold")
        by = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)]
        lists = lambda rows: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_pos", *[F.col(f"`{c}`") for c in t.names]))).alias("_rows"))
        on = [f"_k{i}" for i in range(len(key))]
        try:
            old.select(*by, begin).join(lists(keyed), on, "left").withColumn("_fold", fold)
        except AnalysisException:
            return None
        old = written(old, "met")
        first = written(self.one_of_each(keyed.join(old.select(*key).distinct(), key, "left_anti"), key, first=True), "first")
        nothing = F.lit(None).cast("string")
        state = old.select(*by, ROW, FILE, begin).unionByName(first.select(*by, nothing.alias(ROW), nothing.alias(FILE), begin))
        for rows in self.shares(keyed.join(first.select("_pos"), "_pos", "left_anti"), key):
            state = written(state.join(lists(rows), on, "left").withColumn("_fold", fold).drop("_rows"), "folded")
        broken = state.filter("_fold.bad IS NOT NULL").select("_fold.bad").first()
        if broken:
            raise ConstraintError(broken[0])
        was = F.col(ROW).isNotNull()
        changed = state.filter(was & (F.col("_fold.n") > 0)).select(ROW, FILE, *[F.col(f"_fold.row.`{c}`").alias(f"_set_{c}") for c in sets])
        fresh = state.filter(~was).select(*[F.col(f"_fold.row.`{c}`").alias(c) for c in t.names])
        fresh = fresh.unionByName(new.filter(constraints.nulls(new, key)).select(*[F.col(f"`{c}`") for c in t.names]))
        return old, fresh, changed, fresh.count() + (state.agg(F.sum("_fold.n")).first()[0] or 0)

    def shares(self, rows: DataFrame, key: list[str]) -> list[DataFrame]:
        """Rows in shares to be taken one after the other, so that no key has more of one than a task can hold at once."""
        size = F.lit(48)
        for c, kind in rows.dtypes:
            one = F.octet_length(F.col(f"`{c}`")) if kind in ("string", "binary") else F.size(F.col(f"`{c}`")) * 8 if kind.startswith("array") else F.lit(8)
            size = size + F.coalesce(one, F.lit(0))
        sized = rows.withColumn("_bytes", size.cast("long"))
        large = sized.groupBy(*key).agg(F.sum("_bytes").alias("_all")).filter(F.col("_all") > FOLD_LEAST)
        most, many = large.agg(F.max("_all"), F.count("*")).first()
        if not many:
            return [rows]
        share = max(FOLD_LEAST, FOLD_BYTES // many)
        before = F.sum("_bytes").over(Window.partitionBy(*key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1))
        dealt = sized.withColumn("_share", F.floor(F.coalesce(before, F.lit(0)) / share).cast("int")).select(*rows.columns, "_share")
        path = new_path(self.spark, "shares")
        dealt.write.partitionBy("_share").parquet(path)
        read = self.spark.read.schema(dealt.schema).parquet(path)
        return [read.filter(F.col("_share") == i).drop("_share") for i in range(most // share + 1)]

    def inserted_in_order(self, t: Table, s: Record, new: DataFrame, keys: list[list[str]]) -> DataFrame:
        """New rows that meet each other's keys, or one row by several keys, one after the other.

        Each round takes those before which no row left has any of their keys, or meets the same row of the table.
        """
        rounds = []
        while new.take(1):
            turn, t = new, self.table(s.table)
            for key in keys:
                turn = turn.join(self.one_of_each(new, key, first=True).select("_pos"), "_pos", "left_semi")
            met = written(self.met(temporal.live(self.located(t)), turn, keys).select(ROW, "_pos"), "met")
            later = met.join(met.groupBy(ROW).agg(F.min("_pos").alias("_first")), ROW).filter("_pos > _first").select("_pos")
            turn = written(turn.join(later, "_pos", "left_anti"), "turn")
            rounds.append(self.insert(t, s, turn, keys))
            new = written(new.join(turn.select("_pos"), "_pos", "left_anti"), "new")
        last = None
        for touched in rounds:  # of a row that several rounds changed, what the last one made of it
            last = touched if last is None else last.join(touched.select(ROW), ROW, "left_anti").unionByName(touched)
        if last is None:
            return self.returned(t, self.empty(t.columns), s.returning)
        return self.returned(t, last, s.returning, sum(x.count() for x in rounds))

    def met(self, old: DataFrame, new: DataFrame, keys: list[list[str]]) -> DataFrame:
        """The old rows that have a key of a new one: (_row, _file, _pos)."""
        out = None
        for key in keys:
            same = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in key]
            hit = new.alias("n").join(old.alias("o"), same).select(F.col(f"o.{ROW}").alias(ROW), F.col(f"o.{FILE}").alias(FILE), F.col("n._pos").alias("_pos"))
            out = hit if out is None else out.unionAll(hit)
        return out

    def insert(self, t: Table, s: Record, new: DataFrame, keys: list[list[str]]) -> DataFrame:
        """Insert new rows, of which no two have equal keys where conflicts update; the rows made or changed."""
        old = temporal.live(self.located(t))
        gone = changed = None
        if s.conflict in ("IGNORE", "REPLACE", "UPDATE"):
            if s.conflict == "IGNORE":
                needed = [c.name for c in t.columns if c.not_null]
                new = new.filter(~constraints.nulls(new, needed))
            for key in keys:
                new = self.one_of_each(new, key, first=s.conflict == "IGNORE")
            gone = self.met(old, new, keys) if keys else None
            if gone is not None:
                gone = written(gone.dropDuplicates([ROW]), "hits")
        if s.conflict == "IGNORE" and gone is not None:
            new = new.join(gone.select("_pos").distinct(), "_pos", "left_anti")
        if s.conflict == "UPDATE" and gone is not None:
            o, n = self.shown("_old", old.join(gone.drop(FILE), ROW)), self.shown("_new", new)
            sets = ", ".join(f"({x}) AS {name('_set_' + t.column(c).name)}" for c, x in s.sets)
            # a name alone is the row that is there; excluded is the one that could not be inserted
            plain = self.spark.sql(f"SELECT * FROM {n} WHERE FALSE").columns
            pairs = f"(SELECT {', '.join(name(c) + ' AS ' + name('_x_' + c) for c in plain)} FROM {n})"
            sets = sets.replace("`excluded`.`", "`excluded`.`_x_")
            where = f" AND {s.where.replace('`excluded`.`', '`excluded`.`_x_')}" if s.where else ""
            me = name(s.alias or t.name)
            changed = written(self.spark.sql(f"SELECT {me}.{ROW}, {me}.{FILE}, {sets} FROM {o} AS {me} JOIN {pairs} AS excluded ON {me}._pos = excluded._x__pos{where}"), "changed")
            new = new.join(gone.select("_pos").distinct(), "_pos", "left_anti")
        return self.put(t, s, old, new.select(*[F.col(f"`{c}`") for c in t.names]), changed, gone)

    def put(self, t: Table, s: Record, old: DataFrame, new: DataFrame, changed: DataFrame | None, gone: DataFrame | None = None) -> DataFrame:
        """Add new rows, give rows of old the values of changed(_row, _file, _set_<column>), or delete those gone(_row, _file)."""
        fresh = written(self.stamped(new), "fresh")
        self.fire(t, "INSERT", None, fresh, before=True)
        t, touched = self.table(t.name), fresh
        if changed is not None:
            columns = [t.column(c).name for c, _ in s.sets]
            was = written(old.drop(FILE).join(changed.select(ROW), ROW, "left_semi"), "was")
            updated = written(self.with_changes(t, was, changed, columns)[1], "updated")
            self.fire(t, "UPDATE", was, updated, before=True)
            self.rewrite(t, changed, lambda rows: self.with_changes(t, rows, changed, columns)[0], fresh)
            touched = fresh.unionByName(updated)
        elif s.conflict == "REPLACE" and gone is not None:
            self.rewrite(t, gone, lambda rows: self.marked(rows, gone.select(ROW)), fresh)
        else:
            self.append(t, fresh)
        self.past |= set(t.files or ())
        self.check(t, touched, temporal.live(self.table(t.name).rows))
        self.fire(t, "INSERT", None, fresh)
        if changed is not None:
            self.fire(t, "UPDATE", was, updated)
        return touched

    def one_of_each(self, rows: DataFrame, key: list[str], first: bool) -> DataFrame:
        """Of new rows with equal keys the first or the last one; keys with a NULL are never equal."""
        pick = F.min("_pos") if first else F.max("_pos")
        keep = rows.filter(~constraints.nulls(rows, key)).groupBy(*key).agg(pick.alias("_pos")).select("_pos")
        return rows.join(keep, "_pos", "left_semi").unionByName(rows.filter(constraints.nulls(rows, key)))

    def marked(self, rows: DataFrame, which: DataFrame) -> DataFrame:
        """The rows named by which(_row) as deleted now."""
        flags = which.select(ROW, F.lit(True).alias("_hit"))
        now = F.lit(int(time.time())).cast("long")
        return rows.join(flags, ROW, "left").withColumn(DELETED, F.when(F.col("_hit") & (F.col(DELETED) == 0), now).otherwise(F.col(DELETED))).drop("_hit")

    def with_changes(self, t: Table, rows: DataFrame, changed: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """rows with the values of changed(_row, _set_<column>), and the changed rows alone. Old values are not kept."""
        marked = changed.drop(FILE).withColumn("_hit", F.lit(True))
        joined = rows.join(marked, ROW, "left")
        hit = F.col("_hit").isNotNull()
        for c in columns:
            kind = types.spark_type(t.column(c).type)
            joined = joined.withColumn(c, F.when(hit, F.col(f"_set_{c}").try_cast(kind)).otherwise(F.col(f"`{c}`")))
        joined = joined.withColumn(CREATED, F.when(hit, F.lit(int(time.time())).cast("long")).otherwise(F.col(CREATED)))
        shown = [*[F.col(f"`{c}`") for c in t.names], *HIDDEN]
        return joined.select(*shown), joined.filter(hit).select(*shown)

    def hits(self, t: Table, s: Record, select: str, operation: str) -> DataFrame:
        """The rows that an UPDATE or DELETE means, each once."""
        rows = temporal.live(self.located(t))
        if t.secured and self.user is not None:
            rows = rows.filter(self.policy(t, operation))
        me = name(s.alias or t.name)
        view = self.shown(f"_target_{t.name.lower()}", rows)
        where = f" WHERE {s.where}" if s.where else ""
        found = self.spark.sql(f"SELECT {me}.{ROW}, {me}.{FILE}{select} FROM {view} AS {me}{s.joins}{where}")
        return written(found.dropDuplicates([ROW]), "hits")

    def do_update(self, s: Record) -> DataFrame:
        if s.table.lower() in self.state.views:
            return self.instead(s)
        t = self.table(s.table)
        columns = [t.column(c).name for c, _ in s.sets]
        select = "".join(f", ({x}) AS {name('_set_' + c)}" for c, (_, x) in zip(columns, s.sets))
        changed = self.hits(t, s, select, "UPDATE")
        before = written(temporal.live(t.rows).join(changed.select(ROW), ROW, "left_semi").select(*t.names, *HIDDEN), "before")
        updated = written(self.with_changes(t, before, changed, columns)[1], "updated")
        self.fire(t, "UPDATE", before, updated, before=True)
        t = self.table(t.name)
        self.rewrite(t, changed, lambda rows: self.with_changes(t, rows, changed, columns)[0])
        self.past |= set(t.files or ())
        self.check(t, updated, temporal.live(self.state.tables[t.name.lower()].rows))
        self.cascade(t, before, updated)
        self.fire(t, "UPDATE", before, updated)
        return self.returned(t, updated, s.returning)

    def do_delete(self, s: Record) -> DataFrame:
        if s.table.lower() in self.state.views:
            return self.instead(s)
        t = self.table(s.table)
        found = self.hits(t, s, "", "DELETE")
        gone = written(temporal.live(t.rows).join(found, ROW, "left_semi").select(*t.names, *HIDDEN), "gone")
        self.fire(t, "DELETE", gone, None, before=True)
        t = self.table(t.name)
        self.rewrite(t, found, lambda rows: self.marked(rows, found))
        self.past |= set(t.files or ())
        self.cascade(t, gone, None)
        self.fire(t, "DELETE", gone, None)
        return self.returned(t, gone, s.returning)

    def do_truncate(self, s: Record) -> DataFrame:
        return self.do_delete(Record(kind="delete", table=s.table, alias="", joins="", where="", returning=None))

    def cascade(self, t: Table, before: DataFrame, after: DataFrame | None, depth: int = 0) -> None:
        """What foreign keys demand once rows are gone (after is None) or have other keys: one join for each child table."""
        if depth > 64:
            raise ConstraintError("foreign keys refer to each other without end")
        for child in list(self.state.tables.values()):
            for k in child.constraints:
                if k.kind != "foreign" or k.table.lower() != t.name.lower():
                    continue
                old = before.select(ROW, *[F.col(x).alias(f"_o{i}") for i, x in enumerate(k.target)])
                if after is not None:
                    new = after.select(ROW, *[F.col(x).alias(f"_n{i}") for i, x in enumerate(k.target)])
                    same = F.lit(True)
                    for i in range(len(k.target)):
                        same = same & F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}"))
                    old = old.join(new, ROW).filter(~same)
                old = old.drop(ROW)
                child = self.state.tables[child.name.lower()]
                rows = temporal.live(self.located(child))
                hit = written(rows.join(old, [F.col(c) == F.col(f"_o{i}") for i, c in enumerate(k.columns)]), "children")
                if not hit.take(1):
                    continue
                action = k.delete if after is None else k.update
                if action in ("RESTRICT", "NO ACTION"):
                    raise ConstraintError(f"FOREIGN KEY: {child.name} refers to {t.name}")
                gone = hit.select(*[F.col(f"`{c}`") for c in child.names], *HIDDEN)
                if action == "CASCADE" and after is None:
                    self.rewrite(child, hit, lambda r, h=hit: self.marked(r, h.select(ROW).distinct()))
                    self.past |= set(child.files or ())
                    self.cascade(child, gone, None, depth + 1)
                    continue
                sets = []
                for i, c in enumerate(k.columns):
                    new = F.col(f"_n{i}") if action == "CASCADE" else F.expr(child.column(c).default or "NULL") if action == "SET DEFAULT" else F.lit(None)
                    sets.append(new.alias(f"_set_{c}"))
                moved = hit.select(ROW, *sets)
                updated = written(self.with_changes(child, gone, moved, list(k.columns))[1], "updated")
                self.rewrite(child, hit, lambda r, c=child, m=moved, k=k: self.with_changes(c, r, m, list(k.columns))[0])
                self.past |= set(child.files or ())
                self.cascade(child, gone, updated, depth + 1)


def text_of(tokens: list) -> str:
    """A statement's tokens as text again."""
    quote = {"string": lambda x: "'" + x.replace("\\", "\\\\").replace("'", "''") + "'", "name": lambda x: f"`{x}`", "blob": lambda x: f"X'{x}'"}
    out = ""
    for t in tokens:
        piece = quote[t.kind](t.text) if t.kind in quote else t.text
        tight = not out or piece in (".", ",", ")", ";") or out[-1] in ".(" or (piece == "(" and out[-1:].isalnum() and t.kind == "op" and out.rsplit(" ", 1)[-1].isidentifier() and out.rsplit(" ", 1)[-1].upper() not in _OPENS)
        out += piece if tight else f" {piece}"
    return out


#: Words behind which a parenthesis does not open a call.
_OPENS = {"IN", "AS", "AND", "OR", "NOT", "FROM", "VALUES", "EXISTS", "WHERE", "ON", "OVER", "FILTER", "SELECT", "JOIN", "BY", "THEN", "ELSE", "WHEN", "UNION", "ALL", "EXCEPT", "INTERSECT"}


def partition_of(t: Table) -> DataFrame:
    """The table's live rows with the partition that each belongs to."""
    p = t.partition
    return temporal.live(t.rows).select(*t.names, partitions.route(p.column, p.how, p.bounds, p.n).alias("partition_name"))
