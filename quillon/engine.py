"""The engine: statements of the dialect over external Parquet tables and versioned tables."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mutations
from .client import Cells, Cursor
from .definitions import Definitions
from .errors import ConstraintError, QuillonError, TransactionError, ValidationError
from .functions.scalar import Value, clock, quote, zone
from .operators.relational import fixpoint
from .operators.render import ascii_table
from .plans import tree as t
from .plans.lexer import script_is_complete, split_script
from .plans.parser import parse
from .plans.render import Renderer
from .plans.types import BIGINT, BLOB, BOOLEAN, DATE, DATETIME, DOUBLE, INT, NULL, TEXT, Type, from_spark
from .sources.parquet import ParquetTables
from .sources.storage import ROWID, Catalog, Storage, Trigger

__all__ = ["Engine", "Prepared", "script_is_complete"]


def literal(value: Any) -> Value:
    """A Python value as a typed literal."""
    import datetime
    import decimal

    if value is None:
        return Value("NULL", NULL)
    if isinstance(value, bool):
        return Value("TRUE" if value else "FALSE", BOOLEAN)
    if isinstance(value, int):
        if abs(value) < 2**31:
            return Value(f"({value})", INT)
        return Value(f"CAST('{value}' AS BIGINT)", BIGINT) if abs(value) < 2**63 else Value(f"CAST('{value}' AS DECIMAL(38,0))", Type("int128"))
    if isinstance(value, float):
        return Value(f"CAST('{value!r}' AS DOUBLE)", DOUBLE)
    if isinstance(value, decimal.Decimal):
        scale = max(0, -value.as_tuple().exponent)
        return Value(f"CAST('{value}' AS DECIMAL(38,{scale}))", Type("decimal", 38, scale))
    if isinstance(value, str):
        return Value(quote(value), TEXT)
    if isinstance(value, bytes | bytearray):
        return Value(f"X'{bytes(value).hex()}'", BLOB)
    if isinstance(value, datetime.datetime):
        return Value(f"TIMESTAMP_NTZ'{value:%Y-%m-%d %H:%M:%S}'", DATETIME)
    if isinstance(value, datetime.date):
        return Value(f"DATE'{value:%Y-%m-%d}'", DATE)
    raise ValidationError(f"no literal for {type(value).__name__}")


class Engine:
    """One connection. `sources` are directories of read-only Parquet tables; `path` keeps own tables."""

    def __init__(self, spark: SparkSession, path: str | None = None, sources: str | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1024")
        self.storage = Storage(spark, path)
        self.catalog = self.storage.load()
        self.external = ParquetTables(spark, sources) if sources else None
        self.id = uuid.uuid4().hex[:12]
        self._begun: Catalog | None = None
        self._savepoints: list[tuple[str, Catalog]] = []
        self._views = 0
        self.definitions = Definitions(self)

    # relations

    def _view(self, df: DataFrame) -> str:
        self._views += 1
        name = f"quillon_{self.id}_{self._views}"
        df.createOrReplaceTempView(name)
        return name

    def lookup(self, name: str):
        """The renderer's view of a name: table, view, or external table."""
        table = self.catalog.tables.get(name)
        if table is not None:
            return self._view(self.storage.read(table)), [(c.name, c.type) for c in table.columns] + [(ROWID, BIGINT)], {ROWID}
        if name in self.catalog.views:
            query, _ = parse(self.catalog.views[name] + ";")
            out = self.renderer().select(query, None)
            return f"({out.sql})", out.columns, set()
        df = self.external.get(name) if self.external else None
        if df is None:
            return None
        return self._view(df), [(c, from_spark(kind)) for c, kind in df.dtypes], set()

    def renderer(self, parameters: list[Value] | None = None, rows: dict | None = None) -> Renderer:
        return Renderer(self.lookup, parameters, rows, self._materialize)

    def _save(self, df: DataFrame) -> DataFrame:
        at = f"{self.storage.path}/rounds/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _materialize(self, first: str, again) -> str:
        """Recursive UNION: rounds on DataFrames; the result is a view."""
        return self._view(fixpoint(self.spark.sql(first), lambda delta: self.spark.sql(again(self._view(delta))), self._save))

    def plan(self, query: t.Select, parameters: list[Value] | None = None, rows: dict | None = None, edge: bool = True) -> DataFrame:
        out = self.renderer(parameters, rows).select(query, None)
        df = self.spark.sql(out.sql)
        names = [n for n, _ in out.columns]
        if edge and any(ty.kind in ("time", "timetz") for _, ty in out.columns):
            # times are shown as text
            df = df.toDF(*[f"c{i}" for i in range(len(names))])
            shown = [F.expr(clock(f"c{i}")) if ty.kind == "time" else F.expr(f"CASE WHEN c{i} IS NULL THEN NULL ELSE {zone(f'c{i}')} END") if ty.kind == "timetz" else F.col(f"c{i}") for i, (_, ty) in enumerate(out.columns)]
            df = df.select(*[s.alias(n) for s, n in zip(shown, names)])
        return df

    # statements

    def query(self, sql: str, *values: Any) -> DataFrame:
        """The rows of a SELECT, or of a statement that reports."""
        node, wanted = parse(sql)
        return self._report(node, self._bound(wanted, values))

    def execute(self, sql: str, *values: Any) -> int:
        """Runs a statement; the number of affected rows (a query's rows are counted)."""
        node, wanted = parse(sql)
        return self._run(node, self._bound(wanted, values))

    @staticmethod
    def _bound(wanted: int, values: tuple) -> list[Value]:
        if len(values) != wanted:
            raise ValidationError(f"{wanted} parameters are to be bound, not {len(values)}")
        return [literal(v) for v in values]

    def _report(self, node, parameters: list[Value]) -> DataFrame:
        self._refresh()
        if isinstance(node, t.Select):
            if node.into:
                raise ValidationError("SELECT INTO is executed, not queried")
            return self.plan(node, parameters)
        if node.kind == "explain":
            if not isinstance(node.query, t.Select):
                raise ValidationError("only queries are explained")
            df = self.plan(node.query, parameters)
            plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            logical = df._jdf.queryExecution().optimizedPlan().toString()
            return self.spark.createDataFrame([("logical", logical), ("physical", plan)], "kind string, detail string")
        if node.kind in ("describe", "show", "show_create"):
            return self.definitions.report(node)
        raise ValidationError(f"{node.kind} returns no rows")

    def _run(self, node, parameters: list[Value], rows: dict | None = None, depth: int = 0) -> int:
        if not depth:
            self._refresh()
        if isinstance(node, t.Select) and not node.into:
            return self.plan(node, parameters, rows).count()
        if isinstance(node, t.Statement):
            control = getattr(self, f"_{node.kind}", None)
            if node.kind in ("begin", "commit", "rollback", "savepoint", "rollback_to", "release"):
                control(*([node.name] if "name" in node.parts else []))
                return 0
            if node.kind in ("explain", "describe", "show", "show_create"):
                return self._report(node, parameters).count()
        before = self.catalog.copy()
        try:
            if isinstance(node, t.Select):
                affected, events = self.definitions.select_into(node, parameters), []
            elif node.kind in ("insert", "update", "delete"):
                affected, events = getattr(mutations, node.kind)(self, node, parameters, rows)
            else:
                affected, events = self.definitions.apply(node), []
            for event in events:
                self._fire(event, depth)
            if depth == 0 and self._begun is None:
                self.storage.publish(self.catalog)
            return affected
        except BaseException:
            self.catalog = before
            raise

    def _fire(self, event: mutations.Event, depth: int) -> None:
        """Runs the table's triggers for each changed row, in order of their names."""
        triggers: list[Trigger] = sorted((g for g in self.catalog.triggers.values() if g.table == event.table and g.event == event.kind), key=lambda g: g.name)
        if not triggers:
            return
        if depth >= 32:
            raise QuillonError("triggers nest deeper than 32")
        types = {c.name: c.type for c in self.catalog.tables[event.table].columns}
        for old, new in event.changes():
            rows = {key: {n: _as(literal(v), types[n]) for n, v in row.items() if n in types} for key, row in (("OLD", old), ("NEW", new)) if row is not None}
            for trigger in triggers:
                body, _ = parse(trigger.body + ";")
                self._run(body, [], rows, depth + 1)

    # transactions

    def _refresh(self) -> None:
        """Outside a transaction, takes over what other engines have published at this path."""
        if self._begun is None and self.storage.persistent:
            there = self.storage.load()
            if there.version != self.catalog.version:
                self.catalog = there

    def _begin(self) -> None:
        if self._begun is not None:
            raise TransactionError("a transaction is open already")
        self._refresh()
        self._begun = self.catalog.copy()

    def _need(self) -> None:
        if self._begun is None:
            raise TransactionError("no transaction is open")

    def _commit(self) -> None:
        self._need()
        try:
            self.storage.publish(self.catalog)
        except BaseException:
            self._rollback()
            raise
        self._begun, self._savepoints = None, []

    def _rollback(self) -> None:
        self._need()
        self.catalog, self._begun, self._savepoints = self._begun, None, []

    def _savepoint(self, name: str) -> None:
        self._need()
        if any(n == name for n, _ in self._savepoints):
            raise TransactionError(f"savepoint {name} exists already")
        self._savepoints.append((name, self.catalog.copy()))

    def _point(self, name: str) -> int:
        self._need()
        at = next((i for i, (n, _) in enumerate(self._savepoints) if n == name), None)
        if at is None:
            raise TransactionError(f"no savepoint {name}")
        return at

    def _rollback_to(self, name: str) -> None:
        at = self._point(name)
        self.catalog = self._savepoints[at][1].copy()
        del self._savepoints[at + 1 :]

    def _release(self, name: str) -> None:
        del self._savepoints[self._point(name) :]

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        """Commits at the end, rolls back on an error."""
        self._begin()
        try:
            yield self
        except BaseException:
            if self._begun is not None:
                self._rollback()
            raise
        if self._begun is not None:
            self._commit()

    # further ways in

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def script(self, text: str) -> Iterator[DataFrame | int]:
        """Runs a script's statements one by one as the iterator is advanced; the first error ends it."""
        for statement in split_script(text):
            node, wanted = parse(statement)
            self._bound(wanted, ())
            reports = isinstance(node, t.Select) and not node.into or isinstance(node, t.Statement) and node.kind in ("explain", "describe", "show", "show_create")
            yield self._report(node, []) if reports else self._run(node, [])

    def execute_batch(self, text: str) -> int:
        return sum(out if isinstance(out, int) else out.count() for out in self.script(text))

    def query_row(self, sql: str, *values: Any):
        """The first row, or None."""
        rows = self.query(sql, *values).take(1)
        return rows[0] if rows else None

    def query_one(self, sql: str, *values: Any) -> Any:
        """The only value of the only row."""
        rows = self.query(sql, *values).take(2)
        if len(rows) != 1 or len(rows[0]) != 1:
            raise ValidationError("one row of one value is expected")
        return rows[0][0]

    def query_as(self, kind: type, sql: str, *values: Any) -> list:
        """Rows as dataclass instances, by column name."""
        names = {f.name for f in dataclasses.fields(kind)}
        return [kind(**{k: v for k, v in row.asDict().items() if k in names}) for row in self.query(sql, *values).collect()]

    def query_one_as(self, kind: type, sql: str, *values: Any):
        """The first row as a dataclass instance, or None."""
        names = {f.name for f in dataclasses.fields(kind)}
        row = self.query_row(sql, *values)
        return None if row is None else kind(**{k: v for k, v in row.asDict().items() if k in names})

    def cells(self, sql: str, *values: Any) -> list[Cells]:
        """Rows whose values are got by type."""
        return [Cells(row) for row in self.query(sql, *values).collect()]

    def cursor(self, table: str, key: str = ROWID) -> Cursor:
        """A cursor over an own table in the order of its row numbers, or of another column."""
        meta = mutations.target_table(self, table)
        if key != ROWID and meta.column(key) is None:
            raise ValidationError(f"unknown column {table}.{key}")
        return Cursor(self.storage.read(meta), key)

    def integrity_check(self) -> list[str]:
        """What is wrong with the own tables: missing or odd parts, row numbers, NOT NULL, checks, keys, references."""
        self._refresh()
        found = []
        for table in self.catalog.tables.values():
            bad = self.storage.faults(table)
            found += bad
            if bad or not table.parts:
                continue
            rows = self.storage.read(table)
            if rows.groupBy(ROWID).count().where("count > 1").take(1) or rows.where(f"{ROWID} IS NULL OR {ROWID} >= {table.next_rowid}").take(1):
                found.append(f"{table.name}: row numbers are not unique and below {table.next_rowid}")
            for check in (lambda: mutations.check_rows(self, table, rows), lambda: mutations.check_keys(table, rows, None), lambda: mutations.check_parents(self, table, rows)):  # noqa: B023
                try:
                    check()
                except ConstraintError as error:
                    found.append(str(error))
        return found

    def table_text(self, sql: str, *values: Any) -> str:
        df = self.query(sql, *values)
        return ascii_table(df.columns, [tuple(r) for r in df.collect()])

    def vacuum(self) -> int:
        """Deletes parts that no version in use points at."""
        return self.storage.vacuum([self.catalog, *([self._begun] if self._begun else []), *(c for _, c in self._savepoints)])


def _as(value: Value, kind: Type) -> Value:
    """A trigger row's literal with its column's type."""
    if value.type.kind == "null":
        return Value(f"CAST(NULL AS {kind.spark()})", kind)
    return Value(f"CAST({value.sql} AS {kind.spark()})", kind) if kind.kind not in ("timetz",) else value


class Prepared:
    """A parsed statement with positional parameters, bound from 1."""

    def __init__(self, engine: Engine, sql: str):
        self.engine, (self.node, self.parameter_count) = engine, parse(sql)
        self.clear()

    def clear(self) -> None:
        self.values: list[Value | None] = [None] * self.parameter_count

    def bind(self, index: int, value: Any) -> Prepared:
        if not 1 <= index <= self.parameter_count:
            raise ValidationError(f"no parameter {index}")
        self.values[index - 1] = literal(value)
        return self

    def bind_all(self, *values: Any) -> Prepared:
        if len(values) != self.parameter_count:
            raise ValidationError(f"{self.parameter_count} parameters are to be bound, not {len(values)}")
        self.values = [literal(v) for v in values]
        return self

    def _ready(self) -> list[Value]:
        for i, v in enumerate(self.values, 1):
            if v is None:
                raise ValidationError(f"parameter {i} is not bound")
        return self.values

    def query(self) -> DataFrame:
        return self.engine._report(self.node, self._ready())

    def execute(self) -> int:
        return self.engine._run(self.node, self._ready())
