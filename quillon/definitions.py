"""Tables, views, indexes and triggers: definitions, their rules, and reports about them."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError, ValidationError
from .functions.scalar import Value
from .mutations import check_keys, check_parents, check_rows, check_sql, numbered, part_rows, stored
from .plans import tree as t
from .plans.parser import parse, parse_expression
from .plans.render import Scope, children, ident, tables
from .plans.types import FLOATS, INT, TEXT, Type
from .sources.storage import ROWID, ColumnMeta, ForeignKey, Table, Trigger

if TYPE_CHECKING:
    from .engine import Engine


class Definitions:
    def __init__(self, engine: Engine):
        self.engine = engine

    @property
    def catalog(self):
        return self.engine.catalog

    def apply(self, node: t.Statement) -> int:
        getattr(self, node.kind)(node)
        return 0

    def _free(self, name: str) -> None:
        if name in self.catalog.tables or name in self.catalog.views:
            raise ValidationError(f"{name} exists already")

    def _table(self, name: str) -> Table:
        if name not in self.catalog.tables:
            raise ValidationError(f"unknown table {name}")
        return self.catalog.tables[name]

    # tables

    def create_table(self, node: t.Statement) -> None:
        if node.lenient and node.name in self.catalog.tables:
            return
        self._free(node.name)
        names = [c.name for c in node.columns]
        if len(set(names)) < len(names):
            raise ValidationError("a column is declared twice")
        primary = [c.name for c in node.columns if c.primary]
        for c in node.constraints:
            if c.kind == "PRIMARY":
                primary += [n for n in c.columns if n not in primary]
        if not primary:
            raise ValidationError("a table needs a primary key")
        table = Table(node.name, [ColumnMeta(c.name, c.type, c.nullable and c.name not in primary, c.auto, c.default_text) for c in node.columns], primary)
        for c in node.columns:
            if c.auto and not (c.type.is_integer and primary == [c.name]):
                raise ValidationError("AUTO_INCREMENT needs a single integer primary key")
        self.catalog.tables[node.name] = table
        for c in node.columns:
            if c.unique:
                self._add(table, t.Constraint("UNIQUE", None, (c.name,)), check=False)
            if c.check:
                self._add(table, t.Constraint("CHECK", None, check=c.check), check=False)
            if c.references:
                target, columns, on_delete, on_update = c.references
                self._add(table, t.Constraint("FOREIGN", None, (c.name,), None, target, columns, on_delete, on_update), check=False)
            if c.default_text is not None:
                self._default(table, table.column(c.name), c.default_text)
        for c in node.constraints:
            if c.kind != "PRIMARY":
                self._add(table, c, check=False)

    def _default(self, table: Table, column: ColumnMeta, text: str) -> None:
        node = parse_expression(text)
        if _columns(node):
            raise ValidationError("a default is a constant")
        stored(self.engine.renderer().value(node, Scope()), column.type)
        column.default = text

    def _add(self, table: Table, c: t.Constraint, check: bool = True) -> None:
        for name in c.columns:
            if table.column(name) is None:
                raise ValidationError(f"unknown column {table.name}.{name}")
        taken = {*table.unique, *table.checks, *(f.name for f in table.foreign)}
        base = c.name or f"{ {'UNIQUE': 'uq', 'CHECK': 'chk', 'FOREIGN': 'fk'}[c.kind]}_{table.name}" + ("_" + "_".join(c.columns) if c.columns else "")
        if c.name in taken:
            raise ValidationError(f"constraint {c.name} exists already")
        name, k = base, 1
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        rows = self.engine.storage.read(table) if check and table.parts else None
        if c.kind == "UNIQUE":
            if rows is not None:
                check_keys(table, rows, None, [list(c.columns)])
            table.unique[name] = list(c.columns)
        elif c.kind == "CHECK":
            check_sql(self.engine, table, c.check)
            table.checks[name] = c.check
            if rows is not None:
                check_rows(self.engine, table, rows)
        elif c.kind == "FOREIGN":
            parent = self._table(c.target)
            if len(c.columns) != len(c.target_columns) or any(parent.column(n) is None for n in c.target_columns):
                raise ValidationError(f"{name}: the columns do not match {c.target}")
            if list(c.target_columns) != parent.primary and list(c.target_columns) not in parent.unique.values():
                raise ValidationError(f"{name}: the parent columns are no key of {c.target}")
            table.foreign.append(ForeignKey(name, list(c.columns), c.target, list(c.target_columns), c.on_delete, c.on_update))
            if rows is not None:
                check_parents(self.engine, table, rows)
        else:
            raise ValidationError("a primary key cannot be added")

    def drop_table(self, node: t.Statement) -> None:
        if node.lenient and node.name not in self.catalog.tables:
            return
        self._table(node.name)
        self._unused(node.name)
        for other in self.catalog.tables.values():
            if other.name != node.name and any(f.table == node.name for f in other.foreign):
                raise ValidationError(f"{node.name} is referenced by {other.name}")
        del self.catalog.tables[node.name]
        self.catalog.triggers = {k: g for k, g in self.catalog.triggers.items() if g.table != node.name}

    def _unused(self, name: str) -> None:
        for view, text in self.catalog.views.items():
            if name in tables(parse(text + ";")[0]):
                raise ValidationError(f"view {view} depends on {name}")

    def alter(self, node: t.Statement) -> None:
        table = self._table(node.table)
        getattr(self, f"_alter_{node.action}")(table, node)

    def _alter_rename(self, table: Table, node: t.Statement) -> None:
        self._free(node.to)
        self._unused(table.name)
        old = table.name
        self.catalog.tables = {node.to if k == old else k: v for k, v in self.catalog.tables.items()}
        table.name = node.to
        for other in self.catalog.tables.values():
            for f in other.foreign:
                f.table = node.to if f.table == old else f.table
        for g in self.catalog.triggers.values():
            g.table = node.to if g.table == old else g.table

    def _alter_rename_column(self, table: Table, node: t.Statement) -> None:
        column = self._column(table, node.column)
        if table.column(node.to):
            raise ValidationError(f"{table.name}.{node.to} exists already")
        self._unused(table.name)
        rows = self.engine.storage.read(table) if table.parts else None
        old, column.name = column.name, node.to
        swap = lambda names: [node.to if n == old else n for n in names]
        table.primary = swap(table.primary)
        table.unique = {k: swap(v) for k, v in table.unique.items()}
        table.indexes = {k: swap(v) for k, v in table.indexes.items()}
        table.checks = {k: _renamed(v, old, node.to) for k, v in table.checks.items()}
        for f in table.foreign:
            f.columns = swap(f.columns)
        for other in self.catalog.tables.values():
            for f in other.foreign:
                if f.table == table.name:
                    f.target = swap(f.target)
        if rows is not None:
            table.parts = [self.engine.storage.write(table.name, rows.withColumnRenamed(old, node.to))]

    @staticmethod
    def _column(table: Table, name: str) -> ColumnMeta:
        column = table.column(name)
        if column is None:
            raise ValidationError(f"unknown column {table.name}.{name}")
        return column

    def _alter_add_column(self, table: Table, node: t.Statement) -> None:
        c = node.definition
        if table.column(c.name):
            raise ValidationError(f"{table.name}.{c.name} exists already")
        if c.primary or c.unique or c.check or c.references or c.auto:
            raise ValidationError("an added column takes no key, check or reference")
        if not c.nullable and c.default_text is None:
            raise ValidationError("an added column must be nullable or have a default")
        rows = self.engine.storage.read(table) if table.parts else None
        meta = ColumnMeta(c.name, c.type, c.nullable)
        table.columns.append(meta)
        value = Value("NULL", Type("null"))
        if c.default_text is not None:
            self._default(table, meta, c.default_text)
            value = self.engine.renderer().value(parse_expression(c.default_text), Scope())
        if rows is not None:
            wide = rows.withColumn(c.name, F.expr(stored(value, c.type))).select(*[F.col(ident(n)) for n in [*table.names(), ROWID]])
            table.parts = [self.engine.storage.write(table.name, wide)]

    def _alter_drop_column(self, table: Table, node: t.Statement) -> None:
        name = self._column(table, node.column).name
        used = [*table.primary, *(n for v in [*table.unique.values(), *table.indexes.values()] for n in v), *(n for f in table.foreign for n in f.columns)]
        used += [n for text in table.checks.values() for n in _columns(parse_expression(text))]
        used += [n for other in self.catalog.tables.values() for f in other.foreign if f.table == table.name for n in f.target]
        if name in used:
            raise ValidationError(f"{table.name}.{name} is part of a key, index, check or reference")
        self._unused(table.name)
        rows = self.engine.storage.read(table) if table.parts else None
        table.columns = [c for c in table.columns if c.name != name]
        if rows is not None:
            table.parts = [self.engine.storage.write(table.name, rows.drop(name))]

    def _alter_add_constraint(self, table: Table, node: t.Statement) -> None:
        self._add(table, node.constraint)

    def _alter_drop_constraint(self, table: Table, node: t.Statement) -> None:
        if node.name in table.unique:
            columns = table.unique[node.name]
            if any(f.table == table.name and f.target == columns for o in self.catalog.tables.values() for f in o.foreign):
                raise ValidationError(f"{node.name} is referenced")
            del table.unique[node.name]
        elif node.name in table.checks:
            del table.checks[node.name]
        elif any(f.name == node.name for f in table.foreign):
            table.foreign = [f for f in table.foreign if f.name != node.name]
        else:
            raise ValidationError(f"no constraint {node.name}")

    def _alter_set_default(self, table: Table, node: t.Statement) -> None:
        self._default(table, self._column(table, node.column), node.default_text)

    def _alter_drop_default(self, table: Table, node: t.Statement) -> None:
        self._column(table, node.column).default = None

    def _alter_set_not_null(self, table: Table, node: t.Statement) -> None:
        column = self._column(table, node.column)
        if table.parts and self.engine.storage.read(table).where(f"{ident(column.name)} IS NULL").take(1):
            raise ConstraintError(f"{table.name}.{column.name} holds NULL")
        column.nullable = False

    def _alter_drop_not_null(self, table: Table, node: t.Statement) -> None:
        column = self._column(table, node.column)
        if column.name in table.primary:
            raise ValidationError("a primary key is never NULL")
        column.nullable = True

    # indexes, views, triggers

    def create_index(self, node: t.Statement) -> None:
        table = self._table(node.table)
        if node.name in table.indexes or node.name in table.unique:
            if node.lenient:
                return
            raise ValidationError(f"index {node.name} exists already")
        if node.unique:
            self._add(table, t.Constraint("UNIQUE", node.name, node.columns))
        else:
            for c in node.columns:
                self._column(table, c)
            table.indexes[node.name] = list(node.columns)

    def drop_index(self, node: t.Statement) -> None:
        table = self._table(node.table)
        if node.name in table.indexes:
            del table.indexes[node.name]
        elif node.name in table.unique:
            del table.unique[node.name]
        elif not node.lenient:
            raise ValidationError(f"no index {node.name}")

    def create_view(self, node: t.Statement) -> None:
        if node.lenient and node.name in self.catalog.views:
            return
        self._free(node.name)
        if node.name in tables(node.query):
            raise ValidationError(f"view {node.name} refers to itself")
        columns = self.engine.renderer().select(node.query, None).columns
        if len({n for n, _ in columns}) < len(columns):
            raise ValidationError("a view's columns need different names")
        self.catalog.views[node.name] = node.query.text

    def drop_view(self, node: t.Statement) -> None:
        if node.name not in self.catalog.views:
            if node.lenient:
                return
            raise ValidationError(f"unknown view {node.name}")
        self._unused(node.name)
        del self.catalog.views[node.name]

    def create_trigger(self, node: t.Statement) -> None:
        table = self._table(node.table)
        if node.name in self.catalog.triggers:
            raise ValidationError(f"trigger {node.name} exists already")
        body = node.body
        if not (isinstance(body, t.Select) and not body.into or isinstance(body, t.Statement) and body.kind in ("insert", "update", "delete")):
            raise ValidationError("a trigger runs one SELECT, INSERT, UPDATE or DELETE")
        wrong = {"INSERT": "OLD", "DELETE": "NEW"}.get(node.event)
        words = node.body_text.replace("(", " ").replace(",", " ").split()
        if wrong and any(w.startswith(f"{wrong}.") for w in words):
            raise ValidationError(f"{node.event} has no {wrong}")
        for row in ("OLD", "NEW"):
            for w in words:
                if w.startswith(f"{row}.") and table.column(w[4:].rstrip(";)")) is None:
                    raise ValidationError(f"unknown column {w}")
        if isinstance(body, t.Statement) and node.table == (body.parts.get("table") or getattr(body.parts.get("source"), "name", None)):
            raise ValidationError("a trigger does not change its own table")
        self.catalog.triggers[node.name] = Trigger(node.name, node.event, node.table, node.body_text)

    def drop_trigger(self, node: t.Statement) -> None:
        if node.name not in self.catalog.triggers:
            if node.lenient:
                return
            raise ValidationError(f"unknown trigger {node.name}")
        del self.catalog.triggers[node.name]

    def select_into(self, node: t.Select, parameters: list[Value]) -> int:
        """A table of the query's rows, with a numbered primary key; types come from the query."""
        from dataclasses import replace

        self._free(node.into)
        engine = self.engine
        out = engine.renderer(parameters).select(replace(node, into=None), None)
        names = [n for n, _ in out.columns]
        if len(set(names)) < len(names):
            raise ValidationError("the columns need different names")
        key = next(n for n in ("id", *(f"id_{i}" for i in range(1, 100))) if n not in names)
        kinds = [TEXT if ty.kind == "null" else Type("float64") if ty.kind in FLOATS else ty for _, ty in out.columns]
        table = Table(node.into, [ColumnMeta(key, INT, False, True), *(ColumnMeta(n, ty) for n, ty in zip(names, kinds))], [key])
        self.catalog.tables[node.into] = table
        typed = ", ".join(f"CAST(x.c{i} AS {ty.spark()}) AS {ident(n)}" for i, (n, ty) in enumerate(zip(names, kinds)))
        df = numbered(engine, engine.spark.sql(f"SELECT {typed} FROM ({out.sql}) AS x({', '.join(f'c{i}' for i in range(len(names)))})"), 1)
        part = engine.storage.write(table.name, df.withColumn(key, F.col(ROWID).cast("int")).select(*[F.col(ident(c)) for c in [*table.names(), ROWID]]))
        table.parts = [part]
        many = part_rows(engine, table, part).count()
        table.next_rowid = many + 1
        return many

    # reports

    def report(self, node: t.Statement) -> DataFrame:
        rows = getattr(self, f"_rows_{node.kind}")(node)
        return self.engine.spark.createDataFrame(*rows)

    def _rows_describe(self, node: t.Statement):
        table = self._table(node.table)
        rows = [(c.name, c.type.ddl(), c.nullable, c.name in table.primary, c.auto, c.default) for c in table.columns]
        return rows, "`column` string, type string, nullable boolean, primary_key boolean, auto_increment boolean, `default` string"

    def _rows_show(self, node: t.Statement):
        c = self.catalog
        if node.table:
            self._table(node.table)
        if node.what == "tables":
            return [(n,) for n in sorted(c.tables)], "table_name string"
        if node.what == "views":
            return [(n,) for n in sorted(c.views)], "view_name string"
        chosen = [x for x in c.tables.values() if node.table in (None, x.name)]
        if node.what == "indexes":
            rows = [(x.name, k, u, ", ".join(v)) for x in chosen for u, group in ((True, x.unique), (False, x.indexes)) for k, v in sorted(group.items())]
            return rows, "table_name string, index_name string, is_unique boolean, columns string"
        rows = [(g.name, g.event, g.table, g.body) for g in sorted(c.triggers.values(), key=lambda g: g.name) if node.table in (None, g.table)]
        return rows, "trigger_name string, event string, table_name string, body string"

    def _rows_show_create(self, node: t.Statement):
        if node.of == "view":
            if node.name not in self.catalog.views:
                raise ValidationError(f"unknown view {node.name}")
            return [(node.name, f"CREATE VIEW {node.name} AS {self.catalog.views[node.name]};")], "name string, sql string"
        x = self._table(node.name)
        lines = [f"{c.name} {c.type.ddl()}" + (" PRIMARY KEY" if c.name in x.primary else "") + (" AUTO_INCREMENT" if c.auto else "") + ("" if c.nullable or c.name in x.primary else " NOT NULL") + (f" DEFAULT {c.default}" if c.default is not None else "") for c in x.columns]
        lines += [f"CONSTRAINT {k} UNIQUE ({', '.join(v)})" for k, v in x.unique.items()]
        lines += [f"CONSTRAINT {k} CHECK ({v})" for k, v in x.checks.items()]
        lines += [f"CONSTRAINT {f.name} FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.table}({', '.join(f.target)}) ON DELETE {f.on_delete} ON UPDATE {f.on_update}" for f in x.foreign]
        return [(x.name, f"CREATE TABLE {x.name} (" + ", ".join(lines) + ");")], "name string, sql string"


def _columns(node) -> list[str]:
    return ([node.name] if isinstance(node, t.Column) else []) + [n for c in children(node) for n in _columns(c)]


def _renamed(text: str, old: str, new: str) -> str:
    """A check's text with a column renamed, token by token."""
    from .plans.lexer import tokenize

    out, at = [], 0
    for token in tokenize(text):
        if token.kind == "name" and token.value == old:
            out += [text[at : token.start], new]
            at = token.stop
    return "".join(out) + text[at:]
