"""INSERT, UPDATE and DELETE: change sets as DataFrames, checked, then published as new parts.

A change is written once, then read by all checks. Only parts that hold changed rows are
rewritten; the others stay in the next version as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError, ValidationError
from .functions.scalar import Value, cast_to, quote
from .operators.relational import duplicate_keys
from .plans import tree as t
from .plans.parser import parse_expression
from .plans.render import Scope, children, contains, ident, sources_of, subqueries
from .plans.types import Type
from .sources.storage import ROWID, Table

if TYPE_CHECKING:
    from .engine import Engine


@dataclass
class Event:
    """A statement's row changes for triggers: DataFrames by rowid, read only if a trigger asks."""

    kind: str
    table: str
    old: DataFrame | None
    new: DataFrame | None

    def changes(self) -> Iterator[tuple[dict | None, dict | None]]:
        old = {r[ROWID]: r.asDict() for r in self.old.collect()} if self.old is not None else {}
        new = {r[ROWID]: r.asDict() for r in self.new.collect()} if self.new is not None else {}
        for key in sorted(old.keys() | new.keys()):
            yield old.get(key), new.get(key)


def target_table(engine: Engine, name: str) -> Table:
    if name in engine.catalog.views:
        raise ValidationError(f"view {name} is read-only")
    if name not in engine.catalog.tables:
        raise ValidationError(f"unknown table {name}")
    return engine.catalog.tables[name]


def stored(v: Value, to: Type) -> str:
    """A value as a column keeps it: widening and text to typed; anything else is an error."""
    f = v.type
    fits = (
        f.kind in ("null", to.kind)
        or f.is_integer and (to.is_numeric or to.is_blob)
        or f.is_numeric and (to.kind in ("float32", "float64", "decimal"))
        or f.is_text and (to.is_text or to.is_blob or to.kind in ("date", "time", "datetime", "timetz", "decimal"))
        or f.is_blob and to.is_blob
        or f.kind == "datetime" and to.kind == "date"
    )
    if not fits:
        raise ValidationError(f"a column of type {to.ddl()} does not take {f.ddl()}")
    return cast_to(v, to).sql


def keys_of(table: Table) -> list[list[str]]:
    return ([table.primary] if table.primary else []) + list(table.unique.values())


def _on(columns: list[str], left: str, right: str):
    out = None
    for c in columns:
        same = F.col(f"{left}.{ident(c)}") == F.col(f"{right}.{ident(c)}")
        out = same if out is None else out & same
    return out


# checks


def check_rows(engine: Engine, table: Table, rows: DataFrame) -> None:
    """NOT NULL and CHECK of changed rows."""
    needed = [c.name for c in table.columns if not c.nullable]
    if needed:
        bad = rows.where(" OR ".join(f"{ident(c)} IS NULL" for c in needed)).take(1)
        if bad:
            name = next(c for c in needed if bad[0][c] is None)
            raise ConstraintError(f"{table.name}.{name} must not be NULL")
    for name, text in table.checks.items():
        if rows.where(f"NOT coalesce({check_sql(engine, table, text)}, TRUE)").take(1):
            raise ConstraintError(f"{table.name} breaks check {name}: {text}")


def check_sql(engine: Engine, table: Table, text: str) -> str:
    """A CHECK over the columns of a DataFrame of the table's rows."""
    node = parse_expression(text)
    if subqueries(node) or contains(node, t.Aggregate):
        raise ValidationError("a check refers to its row only")
    scope = Scope([("__row", [(c.name, c.type) for c in table.columns], set())])
    return engine.renderer().condition(node, scope).replace("`__row`.", "")


def folded(table: Table, rows: DataFrame) -> DataFrame:
    """rows as keys are compared: texts without case where the column's collation says so."""
    cased = [c.name for c in table.columns if c.type.is_text and c.type.nocase]
    return rows.select(*[F.lower(F.col(ident(c))).alias(c) if c in cased else F.col(ident(c)) for c in rows.columns]) if cased else rows


def check_keys(table: Table, rows: DataFrame, rest: DataFrame | None, keys: list[list[str]] | None = None) -> None:
    """No key of rows is in rows twice, nor in the rest. NULLs are distinct."""
    rows, rest = folded(table, rows), folded(table, rest) if rest is not None else None
    for key in keys if keys is not None else keys_of(table):
        found = duplicate_keys(rows, key).take(1)
        if not found and rest is not None:
            found = rows.alias("n").join(rest.alias("o"), _on(key, "n", "o"), "left_semi").take(1)
        if found:
            raise ConstraintError(f"{table.name}: duplicate key ({', '.join(key)})")


def check_parents(engine: Engine, table: Table, rows: DataFrame) -> None:
    """Every foreign key of rows without NULL parts has its parent."""
    for key in table.foreign:
        parent = engine.storage.read(engine.catalog.tables[key.table])
        whole = rows.where(" AND ".join(f"{ident(c)} IS NOT NULL" for c in key.columns))
        child = whole.select(*[F.col(ident(c)).alias(f"k{i}") for i, c in enumerate(key.columns)])
        there = parent.select(*[F.col(ident(c)).alias(f"k{i}") for i, c in enumerate(key.target)])
        if child.join(there, [f"k{i}" for i in range(len(key.columns))], "left_anti").take(1):
            raise ConstraintError(f"{table.name}: {key.name} has no parent in {key.table}")


# versions


def rewrite(engine: Engine, table: Table, gone: DataFrame, fresh: str | None) -> None:
    """The next version: the parts without the rows of gone (rowid), and the fresh part."""
    storage = engine.storage
    each = [storage.spark.read.schema(table.schema()).parquet(f"{storage.path}/{p}") for p in table.parts]
    hit: set[int] = set()
    if each:
        marked = None
        for i, df in enumerate(each):
            one = df.select(ROWID, F.lit(i).alias("part"))
            marked = one if marked is None else marked.unionAll(one)
        hit = {r["part"] for r in marked.join(gone.select(ROWID), ROWID, "left_semi").select("part").distinct().collect()}
    parts = []
    for i, name in enumerate(table.parts):
        parts.append(storage.write(table.name, each[i].join(gone.select(ROWID), ROWID, "left_anti").select(*each[i].columns)) if i in hit else name)
    table.parts = parts + ([fresh] if fresh else [])


def part_rows(engine: Engine, table: Table, part: str) -> DataFrame:
    return engine.spark.read.schema(table.schema()).parquet(f"{engine.storage.path}/{part}")


def remove_rows(engine: Engine, table: Table, gone: DataFrame) -> None:
    """Deletes the rows of gone (all columns), and follows the foreign keys that point at them."""
    rewrite(engine, table, gone, None)
    for child, key in inbound(engine, table.name):
        lost = gone.select(*[F.col(ident(c)).alias(f"k{i}") for i, c in enumerate(key.target)])
        hurt = referencing(engine, child, key, lost)
        if not hurt.take(1):
            continue
        if key.on_delete == "RESTRICT":
            raise ConstraintError(f"{table.name}: rows are referenced by {child.name} ({key.name})")
        if key.on_delete == "CASCADE":
            remove_rows(engine, child, hurt)
        else:
            change_rows(engine, child, hurt, hurt.select(*[F.lit(None).cast(child.column(c).type.spark()).alias(c) if c in key.columns else F.col(ident(c)) for c in hurt.columns]), set(key.columns))


def inbound(engine: Engine, name: str):
    return [(child, key) for child in list(engine.catalog.tables.values()) for key in child.foreign if key.table == name]


def referencing(engine: Engine, child: Table, key, lost: DataFrame) -> DataFrame:
    rows = engine.storage.read(child)
    on = None
    for i, c in enumerate(key.columns):
        same = F.col(f"c.{ident(c)}") == F.col(f"l.k{i}")
        on = same if on is None else on & same
    return rows.alias("c").join(lost.distinct().alias("l"), on, "left_semi")


def change_rows(engine: Engine, table: Table, old: DataFrame, new: DataFrame, changed: set[str]) -> DataFrame:
    """Replaces rows by rowid, checks them, and follows the foreign keys to changed columns. The rows as written."""
    part = engine.storage.write(table.name, new.select(*[F.col(ident(c)) for c in [*table.names(), ROWID]]))
    rows = part_rows(engine, table, part)
    check_rows(engine, table, rows)
    rest = engine.storage.read(table).join(rows.select(ROWID), ROWID, "left_anti")
    check_keys(table, rows, rest, [k for k in keys_of(table) if changed & set(k)])
    rewrite(engine, table, rows, part)
    for child, key in inbound(engine, table.name):
        if not changed & set(key.target):
            continue
        named = lambda df, prefix: df.select(ROWID, *[F.col(ident(c)).alias(f"{prefix}{i}") for i, c in enumerate(key.target)])  # noqa: B023, E731
        pairs = named(old, "k").join(named(rows, "n"), ROWID)
        moved = pairs.where(" OR ".join(f"NOT (k{i} <=> n{i})" for i in range(len(key.target))))
        hurt = referencing(engine, child, key, moved.select(*[f"k{i}" for i in range(len(key.target))]))
        if not hurt.take(1):
            continue
        if key.on_update == "RESTRICT":
            raise ConstraintError(f"{table.name}: rows are referenced by {child.name} ({key.name})")
        lookup = {c: i for i, c in enumerate(key.columns)}
        if key.on_update == "CASCADE":
            on = None
            for i, c in enumerate(key.columns):
                same = F.col(f"c.{ident(c)}") == F.col(f"m.k{i}")
                on = same if on is None else on & same
            replaced = hurt.alias("c").join(moved.alias("m"), on).select(*[F.col(f"m.n{lookup[c]}").cast(child.column(c).type.spark()).alias(c) if c in lookup else F.col(f"c.{ident(c)}") for c in hurt.columns])
        else:
            replaced = hurt.select(*[F.lit(None).cast(child.column(c).type.spark()).alias(c) if c in lookup else F.col(ident(c)) for c in hurt.columns])
        change_rows(engine, child, hurt, replaced, set(key.columns))
    check_parents(engine, table, rows)
    return rows


# statements


def numbered(engine: Engine, df: DataFrame, first: int) -> DataFrame:
    """df with rowids first, first + 1, ...: counted per partition, so no task sees all rows."""
    held = engine._save(df.withColumn("__at", F.monotonically_increasing_id()))
    counts = sorted((r["task"], r["n"]) for r in held.groupBy(F.shiftrightunsigned("__at", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    start, at = [], first
    for task, n in counts:
        start.append((task, at))
        at += n
    offsets = engine.spark.createDataFrame(start, "task bigint, start bigint")
    return held.withColumn("task", F.shiftrightunsigned("__at", 33)).join(offsets, "task").withColumn(ROWID, F.col("start") + F.expr("__at & 8589934591")).drop("task", "start", "__at")


def insert(engine: Engine, node: t.Statement, parameters: list[Value], rows: dict | None) -> tuple[int, list[Event]]:
    table = target_table(engine, node.table)
    columns = list(node.columns)
    for name in columns:
        if table.column(name) is None:
            raise ValidationError(f"unknown column {node.table}.{name}")
    if len(set(columns)) < len(columns):
        raise ValidationError("a column is listed twice")
    for c in table.columns:
        if c.name not in columns and not (c.auto or c.default is not None or c.nullable):
            raise ValidationError(f"{table.name}.{c.name} needs a value")
    if node.duplicate and node.rows and len(node.rows) > 1 and not settles(table, node):  # one after another, each sees the last
        total, events = 0, []
        for row in node.rows:
            n, e = insert(engine, t.Statement("insert", {**node.parts, "rows": (row,)}), parameters, rows)
            total, events = total + n, events + e
        return total, events
    renderer, scope = engine.renderer(parameters, rows), Scope()
    defaults = {c.name: renderer.value(parse_expression(c.default), scope) if c.default is not None else Value("NULL", Type("null")) for c in table.columns if c.name not in columns}
    if node.rows:
        lines = []
        for i, row in enumerate(node.rows):
            if len(row) != len(columns):
                raise ValidationError(f"{len(columns)} values are expected")
            if any(subqueries(v) or _names(v) for v in row):
                raise ValidationError("VALUES take no columns or subqueries")
            given = dict(zip(columns, (renderer.value(v, scope) for v in row))) | defaults
            lines.append("SELECT " + ", ".join(f"{stored(given[c.name], c.type)} AS {ident(c.name)}" for c in table.columns) + f", CAST({table.next_rowid + i} AS BIGINT) AS {ROWID}")
        df, many = engine.spark.sql(" UNION ALL ".join(lines)), len(node.rows)
        table.next_rowid += many
    else:
        query = renderer.select(node.query, None)
        if len(query.columns) != len(columns):
            raise ValidationError(f"{len(columns)} columns are expected")
        source = {c: Value(f"x.c{i}", ty) for i, (c, (_, ty)) in enumerate(zip(columns, query.columns))} | defaults
        own = ", ".join(f"{stored(source[c.name], c.type)} AS {ident(c.name)}" for c in table.columns)
        df = numbered(engine, engine.spark.sql(f"SELECT {own} FROM ({query.sql}) AS x({', '.join(f'c{i}' for i in range(len(columns)))})"), table.next_rowid)
    for c in table.columns:
        if c.auto:
            df = df.withColumn(c.name, F.coalesce(F.col(ident(c.name)), F.col(ROWID).cast(c.type.spark())))
    part = engine.storage.write(table.name, df.select(*[F.col(ident(c)) for c in [*table.names(), ROWID]]))
    fresh = part_rows(engine, table, part)
    if not node.rows:
        many = fresh.count()
        table.next_rowid += many
    for c in table.columns:
        if c.auto and c.name in columns:  # an explicit number moves the counter
            top = fresh.agg(F.max(F.col(ident(c.name))).cast("bigint")).first()[0]
            table.next_rowid = max(table.next_rowid, (top or 0) + 1)
    if node.duplicate:
        fresh, part = on_duplicate(engine, table, node, fresh, part, parameters)
    check_rows(engine, table, fresh)
    check_keys(table, fresh, engine.storage.read(table) if table.parts else None)
    table.parts = [*table.parts, part]
    check_parents(engine, table, fresh)
    return many, [Event("INSERT", table.name, None, fresh)]


def _names(node) -> bool:
    return isinstance(node, t.Column) and node.table not in ("NEW", "OLD") or any(_names(c) for c in children(node))


def settles(table: Table, node: t.Statement) -> bool:
    """Whether conflicts are settled in one join: the table has one key, and the assignments leave it alone."""
    keys = keys_of(table)
    return len(keys) == 1 and not {column.name for column, _ in node.duplicate} & set(keys[0])


def settled(engine: Engine, table: Table, node: t.Statement, fresh: DataFrame, parameters: list[Value]) -> tuple[DataFrame, str]:
    """As if row by row: of the rows of one key the first is inserted, if it is not there, and every other one updates it.

    An update sees the row that the one before it left; constraints are checked on the last.
    """
    (key,) = keys_of(table)
    old = engine.storage.read(table)
    own = [F.col(ident(c)) for c in key]
    named = " AND ".join(f"{ident(c)} IS NOT NULL" for c in key)
    asked = folded(table, fresh).where(named).groupBy(*own).agg(F.min(ROWID).alias("first"), F.count("*").alias("times"))
    there = folded(table, old).select(*own, F.col(ROWID).alias("held"))
    hits = engine._save(asked.join(there, [ident(c).strip("`") for c in key], "left").select("first", "times", "held"))
    conflicted = old.join(hits.where("held IS NOT NULL").select(F.col("held").alias(ROWID), "times"), ROWID)
    if conflicted.take(1):
        new, changed = assigned(engine, table, conflicted, node.duplicate, parameters, "times")
        change_rows(engine, table, conflicted.drop("times"), new, changed)
    once = hits.where("held IS NULL").select(F.col("first").alias(ROWID), (F.col("times") - 1).alias("times"))
    rest = fresh.join(once, ROWID).unionByName(fresh.where(f"NOT ({named})").withColumn("times", F.lit(0).cast("bigint")))
    rest, _ = assigned(engine, table, rest, node.duplicate, parameters, "times")
    part = engine.storage.write(table.name, rest.select(*fresh.columns))
    return part_rows(engine, table, part), part


def on_duplicate(engine: Engine, table: Table, node: t.Statement, fresh: DataFrame, part: str, parameters: list[Value]) -> tuple[DataFrame, str]:
    """Updates the rows that fresh conflicts with; what remains of fresh, as a part of its own."""
    if settles(table, node):
        return settled(engine, table, node, fresh, parameters)
    old = engine.storage.read(table)
    hits, asked, there = None, folded(table, fresh), folded(table, old)
    for key in keys_of(table):
        if duplicate_keys(asked, key).take(1):
            raise ConstraintError(f"{table.name}: rows of one INSERT share the key ({', '.join(key)})")
        one = asked.alias("n").join(there.alias("o"), _on(key, "n", "o")).select(F.col(f"n.{ROWID}").alias("fresh"), F.col(f"o.{ROWID}").alias(ROWID))
        hits = one if hits is None else hits.unionAll(one)
    hits = engine._save(hits.distinct())
    if not hits.take(1):
        return fresh, part
    if hits.groupBy("fresh").count().where("count > 1").take(1):
        raise ConstraintError(f"{table.name}: a row conflicts with several rows")
    conflicted = old.join(hits.select(ROWID).distinct(), ROWID, "left_semi")
    new, changed = assigned(engine, table, conflicted, node.duplicate, parameters)
    change_rows(engine, table, conflicted, new, changed)
    rest = engine.storage.write(table.name, fresh.join(hits.select(F.col("fresh").alias(ROWID)), ROWID, "left_anti").select(*fresh.columns))
    return part_rows(engine, table, rest), rest


def assigned(engine: Engine, table: Table, rows: DataFrame, assignments: tuple, parameters: list[Value], times: str | None = None) -> tuple[DataFrame, set[str]]:
    """rows (a DataFrame of the table) with assignments that see the old values; made as many times as the column `times` says."""
    scope = Scope([(table.name, [(c.name, c.type) for c in table.columns], set())])
    renderer = engine.renderer(parameters)
    values = {}
    for column, value in assignments:
        meta = table.column(column.name)
        if meta is None:
            raise ValidationError(f"unknown column {table.name}.{column.name}")
        values[column.name] = stored(renderer.value(value, scope), meta.type)
    view = engine._view(rows)
    if times is not None:
        if any(subqueries(value) for _, value in assignments):
            raise ValidationError("ON DUPLICATE KEY UPDATE takes no subqueries")
        before = ", ".join(f"{quote(c)}, {ident(c)}" for c in [*table.names(), ROWID])
        after = ", ".join(f"{quote(c)}, {values.get(c, f'{ident(table.name)}.{ident(c)}')}" for c in [*table.names(), ROWID])
        steps = f"IF({times} > 0, sequence(1, {times}), CAST(array() AS ARRAY<BIGINT>))"
        return engine.spark.sql(f"SELECT x.* FROM (SELECT aggregate({steps}, named_struct({before}), ({ident(table.name)}, `__step`) -> named_struct({after})) AS x FROM {view})"), set(values)
    own = ", ".join(f"{values.get(c, f'{ident(table.name)}.{ident(c)}')} AS {ident(c)}" for c in [*table.names(), ROWID])
    return engine.spark.sql(f"SELECT {own} FROM {view} AS {ident(table.name)}"), set(values)


def _target(engine: Engine, source, alias: str | None) -> tuple[Table, str]:
    named = [s for s in sources_of(source) if isinstance(s, t.Named)]
    for s in named:
        if alias is None or alias in (s.alias, s.name):
            return target_table(engine, s.name), s.alias
    raise ValidationError(f"unknown target {alias}")


def matched(engine: Engine, source, alias: str, select: list[str], where, parameters: list[Value], rows: dict | None, renderer=None, scope=None, text: str | None = None) -> DataFrame:
    """select over the source's rows that satisfy where; each target row once, its first match."""
    out = f"SELECT {', '.join(select)}"
    others = [s for s in sources_of(source) if getattr(s, "alias", None) != alias]
    if others:
        order = [f"{ident(a)}.{ROWID}" for a, columns, _ in scope.sources if a != alias and any(c == ROWID for c, _ in columns)] or ["1"]
        out += f", row_number() OVER (PARTITION BY {ident(alias)}.{ROWID} ORDER BY {', '.join(order)}) AS __first"
    out += f" FROM {text}"
    if where is not None:
        out += f" WHERE {renderer.condition(where, scope)}"
    df = engine.spark.sql(out)
    return df.where("__first = 1").drop("__first") if others else df


def update(engine: Engine, node: t.Statement, parameters: list[Value], rows: dict | None) -> tuple[int, list[Event]]:
    table, alias = _target(engine, node.source, None)
    renderer, scope = engine.renderer(parameters, rows), Scope()
    text = renderer.source(node.source, scope)
    values = {}
    for column, value in node.assignments:
        if column.table not in (None, alias, table.name):
            raise ValidationError(f"only {alias} is updated")
        meta = table.column(column.name)
        if meta is None:
            raise ValidationError(f"unknown column {table.name}.{column.name}")
        if column.name in values:
            raise ValidationError(f"{column.name} is assigned twice")
        values[column.name] = stored(renderer.value(value, scope), meta.type)
    select = [f"{values.get(c, f'{ident(alias)}.{ident(c)}')} AS {ident(c)}" for c in [*table.names(), ROWID]]
    new = engine._save(matched(engine, node.source, alias, select, node.where, parameters, rows, renderer, scope, text))
    many = new.count()
    if not many:
        return 0, []
    old = engine.storage.read(table).join(new.select(ROWID), ROWID, "left_semi")
    written = change_rows(engine, table, old, new, set(values))
    return many, [Event("UPDATE", table.name, old, written)]


def delete(engine: Engine, node: t.Statement, parameters: list[Value], rows: dict | None) -> tuple[int, list[Event]]:
    table, alias = _target(engine, node.source, node.target)
    renderer, scope = engine.renderer(parameters, rows), Scope()
    text = renderer.source(node.source, scope)
    select = [f"{ident(alias)}.{ident(c)} AS {ident(c)}" for c in [*table.names(), ROWID]]
    gone = engine._save(matched(engine, node.source, alias, select, node.where, parameters, rows, renderer, scope, text))
    many = gone.count()
    if not many:
        return 0, []
    remove_rows(engine, table, gone)
    return many, [Event("DELETE", table.name, gone, None)]


