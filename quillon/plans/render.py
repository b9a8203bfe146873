"""Typed rendering: the syntax tree as Spark SQL text, with every column's logical type.

Catalyst plans the text; nothing is executed here. Columns are always written with their
source's alias, so names resolve as the dialect has it: innermost scope first, ambiguity an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..errors import ValidationError
from ..functions.scalar import Value, arithmetic, call, cast_to, comparable, compare, negate, quote
from . import tree as t
from .types import BIGINT, BOOLEAN, DOUBLE, INT, NULL, Type, common

Columns = list[tuple[str, Type]]


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Scope:
    """The sources of one SELECT: alias -> columns; `hidden` ones are not part of *."""

    sources: list[tuple[str, Columns, set[str]]] = field(default_factory=list)
    parent: Scope | None = None

    def find(self, table: str | None, name: str) -> Value:
        hits = [(alias, ty) for alias, columns, _ in self.sources if table in (None, alias) for column, ty in columns if column == name]
        if len(hits) > 1 and table is None:
            raise ValidationError(f"column {name} is ambiguous")
        if hits:
            return Value(f"{ident(hits[0][0])}.{ident(name)}", hits[0][1])
        if self.parent:
            return self.parent.find(table, name)
        raise ValidationError(f"unknown column {table + '.' if table else ''}{name}")

    def has(self, table: str | None, name: str) -> bool:
        return any(column == name for alias, columns, _ in self.sources if table in (None, alias) for column, _ in columns)

    def star(self) -> list[tuple[str, str, Type]]:
        return [(alias, column, ty) for alias, columns, hidden in self.sources for column, ty in columns if column not in hidden]


@dataclass
class Rendered:
    sql: str
    columns: Columns


#: Resolves a table or view: (SQL relation, columns, hidden columns), or None.
Lookup = Callable[[str], "tuple[str, Columns, set[str]] | None"]


class Renderer:
    def __init__(self, lookup: Lookup, parameters: list[Value] | None = None, rows: dict[str, dict[str, Value]] | None = None, materialize: Callable | None = None):
        self.lookup, self.parameters, self.rows, self.materialize = lookup, parameters or [], rows or {}, materialize
        self.ctes: list[dict[str, tuple[str, Columns, set[str]]]] = []
        self.depth = 0

    # sources

    def relation(self, name: str) -> tuple[str, Columns, set[str]]:
        for level in reversed(self.ctes):
            if name.lower() in level:
                return level[name.lower()]
        found = self.lookup(name)
        if found is None:
            raise ValidationError(f"unknown table {name}")
        return found

    def source(self, node, scope: Scope) -> str:
        if isinstance(node, t.Named):
            sql, columns, hidden = self.relation(node.name)
            self._add(scope, node.alias, columns, hidden)
            return f"{sql} AS {ident(node.alias)}"
        if isinstance(node, t.Derived):
            query = self.select(node.query, None)
            self._add(scope, node.alias, query.columns, set())
            return f"({query.sql}) AS {ident(node.alias)}"
        left = self.source(node.left, scope)
        right = self.source(node.right, scope)
        if node.kind == "CROSS":
            return f"{left} CROSS JOIN {right}"
        return f"{left} {node.kind} JOIN {right} ON {self.condition(node.on, scope)}"

    @staticmethod
    def _add(scope: Scope, alias: str, columns: Columns, hidden: set[str]) -> None:
        if any(a == alias for a, _, _ in scope.sources):
            raise ValidationError(f"duplicate alias {alias}")
        scope.sources.append((alias, columns, hidden))

    # queries

    def select(self, q: t.Select, parent: Scope | None) -> Rendered:
        level: dict[str, tuple[str, Columns, set[str]]] = {}
        heads = []
        self.ctes.append(level)
        for name, body in q.ctes:
            if q.recursive and refers(body, name):
                heads.append(self.recursive(name, body, level))
            else:
                out = self.select(body, None)
                level[name.lower()] = (ident(name), out.columns, set())
                heads.append(f"{ident(name)} AS ({out.sql})")
        heads = [h for h in heads if h]
        body = self.core(q, parent)
        if q.tail:
            op, other = q.tail
            right = self.select(other, parent)
            if len(right.columns) != len(body.columns):
                raise ValidationError("the arms of a set operation must have as many columns")
            columns = [(n, common([a, b])) for (n, a), (_, b) in zip(body.columns, right.columns)]
            body = Rendered(f"({body.sql}) {op} ({right.sql})", columns)
        self.ctes.pop()
        if heads:
            word = "WITH RECURSIVE" if any("/*recursive*/" in h for h in heads) else "WITH"
            body = Rendered(f"{word} {', '.join(heads)} {body.sql}", body.columns)
        return body

    def recursive(self, name: str, body: t.Select, level: dict) -> str:
        if not body.tail or body.tail[0] not in ("UNION", "UNION ALL"):
            raise ValidationError(f"recursive {name} must be a UNION or UNION ALL")
        anchor, step = replace(body, tail=None), body.tail[1]
        if refers(anchor, name):
            raise ValidationError(f"the first arm of {name} must not refer to it")
        if not refers(step, name):
            raise ValidationError(f"the second arm of {name} must refer to it")
        first = self.select(anchor, None)
        # a column's type must hold both arms: it widens until the step no longer changes it
        columns = first.columns
        for _ in range(4):
            level[name.lower()] = (ident(name), columns, set())
            second = self.select(step, None)
            if len(second.columns) != len(columns):
                raise ValidationError("the arms of a set operation must have as many columns")
            wide = [(n, common([a, b])) for (n, a), (_, b) in zip(columns, second.columns)]
            if wide == columns:
                break
            columns = wide

        def typed(out: Rendered) -> str:
            own = ", ".join(f"CAST(x.c{i} AS {ty.spark()}) AS {ident(n)}" for i, (n, ty) in enumerate(columns))
            return f"SELECT {own} FROM ({out.sql}) AS x({', '.join(f'c{i}' for i in range(len(columns)))})"

        if body.tail[0] == "UNION":
            if self.materialize is None:
                raise ValidationError("recursive UNION is not possible here")

            def again(relation: str) -> str:
                level[name.lower()] = (relation, columns, set())
                return typed(self.select(step, None))

            level[name.lower()] = (self.materialize(typed(first), again), columns, set())
            return ""
        return f"/*recursive*/ {ident(name)} AS ({typed(first)} UNION ALL {typed(second)})"

    def core(self, q: t.Select, parent: Scope | None) -> Rendered:
        scope = Scope(parent=parent)
        source = self.source(q.source, scope)
        if q.items is None:
            items = [t.Item(t.Column(alias, name), name) for alias, name, _ in scope.star()]
        else:
            items = list(q.items)
        self.check_shape(q, items)
        names = [item.alias or default_name(item.value, i) for i, item in enumerate(items)]
        aliases = {item.alias: item.value for item in items if item.alias and q.items is not None}
        values = [self.value(item.value, scope) for item in items]
        out = f"SELECT {'DISTINCT ' if q.distinct else ''}" + ", ".join(f"{v.sql} AS {ident(n)}" for v, n in zip(values, names)) + f" FROM {source}"
        if q.where is not None:
            out += f" WHERE {self.condition(self.unalias(q.where, aliases, scope), scope)}"
        if q.group:
            out += " GROUP BY " + ", ".join(self.value(self.unalias(g, aliases, scope), scope).sql for g in q.group)
        if q.having is not None:
            out += f" HAVING {self.condition(self.unalias(q.having, aliases | {n: i.value for n, i in zip(names, items)}, scope, prefer=True), scope)}"
        if q.order:
            keys = []
            for key, down in q.order:
                if isinstance(key, t.Column) and key.table is None and key.name in names and (q.group or q.distinct or not scope.has(None, key.name)):
                    v = Value(ident(key.name), values[names.index(key.name)].type)
                else:
                    v = self.value(self.unalias(key, aliases, scope), scope)
                text = f"({v.sql}) COLLATE {v.type.comparison}" if v.type.comparison else v.sql
                keys.append(f"{text} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}")
            out += " ORDER BY " + ", ".join(keys)
        if q.limit is not None:
            out += f" LIMIT {q.limit}"
        if q.offset is not None:
            out += f" OFFSET {q.offset}"
        return Rendered(out, [(n, v.type) for n, v in zip(names, values)])

    @staticmethod
    def check_shape(q: t.Select, items: list[t.Item]) -> None:
        windows = any(contains(i.value, t.WindowCall) for i in items)
        aggregates = any(contains(i.value, t.Aggregate) for i in items)
        if windows and (q.group or q.having is not None or aggregates):
            raise ValidationError("window functions do not mix with grouping")
        if windows and q.distinct:
            raise ValidationError("DISTINCT does not mix with window functions")
        if q.having is not None and not q.group and not aggregates and not contains(q.having, t.Aggregate):
            raise ValidationError("HAVING needs groups or aggregates")
        if q.where is not None and (contains(q.where, t.Aggregate) or contains(q.where, t.WindowCall)):
            raise ValidationError("WHERE takes no aggregates")

    def unalias(self, node, aliases: dict, scope: Scope, prefer: bool = False, seen: tuple = ()):
        """Select aliases in place of unqualified names; a source's own column wins, unless `prefer`."""
        if isinstance(node, t.Column) and node.table is None and node.name in aliases and (prefer or not scope.has(None, node.name)):
            target = aliases[node.name]
            if target == node or node.name in seen:
                if target == node:
                    return node
                raise ValidationError(f"alias {node.name} refers to itself")
            return self.unalias(target, aliases, scope, False, (*seen, node.name))
        return rebuild(node, lambda child: self.unalias(child, aliases, scope, prefer, seen))

    # expressions

    def condition(self, node, scope: Scope) -> str:
        v = self.value(node, scope)
        if v.type.kind not in ("boolean", "null"):
            raise ValidationError(f"a condition is expected, not {v.type.ddl()}")
        return v.sql if v.type.kind == "boolean" else "CAST(NULL AS BOOLEAN)"

    def value(self, node, scope: Scope) -> Value:
        return getattr(self, "_" + type(node).__name__.lower())(node, scope)

    def _literal(self, node: t.Literal, scope: Scope) -> Value:
        if node.kind == "int":
            n = int(node.value)
            if n < 2**31:
                return Value(str(n), INT)
            if n < 2**63:
                return Value(f"{n}L", BIGINT)
            return Value(f"CAST('{n}' AS DECIMAL(38,0))", Type("int128"))
        if node.kind == "float":
            return Value(f"{node.value}D", DOUBLE)
        if node.kind == "text":
            return Value(quote(node.value), Type("text"))
        if node.kind == "blob":
            return Value(f"X'{node.value}'", Type("blob"))
        if node.kind == "boolean":
            return Value("TRUE" if node.value else "FALSE", BOOLEAN)
        if node.kind == "null":
            return Value("NULL", NULL)
        unit = "YEAR TO MONTH" if node.kind == "interval_ym" else "DAY TO SECOND"
        return Value(f"INTERVAL {quote(node.value)} {unit}", Type(node.kind))

    def _column(self, node: t.Column, scope: Scope) -> Value:
        if node.table in self.rows:
            if node.name not in self.rows[node.table]:
                raise ValidationError(f"unknown column {node.table}.{node.name}")
            return self.rows[node.table][node.name]
        return scope.find(node.table, node.name)

    def _parameter(self, node: t.Parameter, scope: Scope) -> Value:
        if node.index > len(self.parameters) or self.parameters[node.index - 1] is None:
            raise ValidationError(f"parameter {node.index} is not bound")
        return self.parameters[node.index - 1]

    def _unary(self, node: t.Unary, scope: Scope) -> Value:
        if node.op == "NOT":
            return Value(f"(NOT {self.condition(node.arg, scope)})", BOOLEAN)
        return negate(self.value(node.arg, scope))

    def _binary(self, node: t.Binary, scope: Scope) -> Value:
        if node.op in ("AND", "OR"):
            return Value(f"({self.condition(node.left, scope)} {node.op} {self.condition(node.right, scope)})", BOOLEAN)
        a, b = self.value(node.left, scope), self.value(node.right, scope)
        return arithmetic(node.op, a, b) if node.op in "+-*/%" else compare(node.op, a, b)

    def _in(self, node: t.In, scope: Scope) -> Value:
        arg, word = self.value(node.arg, scope), "NOT IN" if node.negated else "IN"
        if node.query is not None:
            query = self.one_column(node.query, scope)
            x, _ = comparable(arg, Value("NULL", query.columns[0][1]))
            return Value(f"({x} {word} ({query.sql}))", BOOLEAN)
        pairs = [comparable(arg, self.value(i, scope)) for i in node.items]
        if len({x for x, _ in pairs}) == 1:
            return Value(f"({pairs[0][0]} {word} ({', '.join(y for _, y in pairs)}))", BOOLEAN)
        return Value(f"({'NOT ' if node.negated else ''}({' OR '.join(f'{x} = {y}' for x, y in pairs)}))", BOOLEAN)

    def _between(self, node: t.Between, scope: Scope) -> Value:
        arg, low, high = (self.value(n, scope) for n in (node.arg, node.low, node.high))
        inside = f"({compare('>=', arg, low).sql} AND {compare('<=', arg, high).sql})"
        return Value(f"(NOT {inside})" if node.negated else inside, BOOLEAN)

    def _like(self, node: t.Like, scope: Scope) -> Value:
        arg, pattern = self.value(node.arg, scope), self.value(node.pattern, scope)
        if not all(v.type.is_text or v.type.kind == "null" for v in (arg, pattern)):
            return Value("CAST(NULL AS BOOLEAN)", BOOLEAN)
        x, y = arg.sql, pattern.sql
        if arg.type.kind == "char":
            x = f"rtrim({x})"
        if arg.type.nocase or pattern.type.nocase:
            x, y = f"lower({x})", f"lower({y})"
        return Value(f"({x} {'NOT ' if node.negated else ''}LIKE {y} ESCAPE '\\u0001')", BOOLEAN)

    def _isnull(self, node: t.IsNull, scope: Scope) -> Value:
        return Value(f"({self.value(node.arg, scope).sql} IS {'NOT ' if node.negated else ''}NULL)", BOOLEAN)

    def _exists(self, node: t.Exists, scope: Scope) -> Value:
        return Value(f"({'NOT ' if node.negated else ''}EXISTS ({self.select(node.query, scope).sql}))", BOOLEAN)

    def one_column(self, query: t.Select, scope: Scope) -> Rendered:
        out = self.select(query, scope)
        if len(out.columns) != 1:
            raise ValidationError("a subquery here must have one column")
        return out

    def _scalar(self, node: t.Scalar, scope: Scope) -> Value:
        out = self.one_column(node.query, scope)
        return Value(f"({out.sql})", out.columns[0][1])

    def _case(self, node: t.Case, scope: Scope) -> Value:
        results = [self.value(r, scope) for _, r in node.branches] + ([self.value(node.otherwise, scope)] if node.otherwise is not None else [])
        ty = common([r.type for r in results])
        sql = [f"CAST({r.sql} AS {ty.spark()})" if r.type.spark() != ty.spark() else r.sql for r in results]
        branches = " ".join(f"WHEN {self.condition(c, scope)} THEN {s}" for (c, _), s in zip(node.branches, sql))
        return Value(f"(CASE {branches}{f' ELSE {sql[-1]}' if node.otherwise is not None else ''} END)", ty)

    def _cast(self, node: t.Cast, scope: Scope) -> Value:
        return cast_to(self.value(node.arg, scope), node.to)

    def _call(self, node: t.Call, scope: Scope) -> Value:
        return call(node.name, [self.value(a, scope) for a in node.args])

    def _aggregate(self, node: t.Aggregate, scope: Scope) -> Value:
        return aggregate(node.name, self.value(node.arg, scope) if node.arg is not None else None)

    def _windowcall(self, node: t.WindowCall, scope: Scope) -> Value:
        partition = ", ".join(self.value(p, scope).sql for p in node.partition)
        keys = []
        for key, down in node.order:
            if not isinstance(key, t.Column):
                raise ValidationError("windows are ordered by columns")
            v = self.value(key, scope)
            keys.append(f"{f'({v.sql}) COLLATE {v.type.comparison}' if v.type.comparison else v.sql} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}")
        if node.name in ("RANK", "DENSE_RANK") and not keys:
            raise ValidationError(f"{node.name} needs ORDER BY")
        parts = [f"PARTITION BY {partition}"] if partition else []
        if node.name in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
            if not keys:  # in the order of the rows themselves, where they have one
                hidden = [f"{ident(alias)}.{ident(c)}" for alias, _, names in scope.sources for c in names if c == "rowid"]
                keys = hidden or ["1"]
            parts.append(f"ORDER BY {', '.join(keys)}")
            return Value(f"CAST({node.name.lower()}() OVER ({' '.join(parts)}) AS BIGINT)", BIGINT)
        # aggregates always see the whole partition, so an order changes nothing
        return aggregate(node.name, self.value(node.arg, scope) if node.arg is not None else None, over=f" OVER ({' '.join(parts)})")


def aggregate(name: str, arg: Value | None, over: str = "") -> Value:
    if name == "COUNT":
        return Value(f"count({arg.sql if arg else '*'}){over}", BIGINT)
    if name in ("MIN", "MAX"):
        return Value(f"{name.lower()}({arg.sql}){over}", arg.type)
    if not (arg.type.is_numeric or arg.type.kind == "null"):
        raise ValidationError(f"{name} takes numbers, not {arg.type.ddl()}")
    if name == "AVG":
        return Value(f"avg(CAST({arg.sql} AS DOUBLE)){over}", DOUBLE)
    if arg.type.kind in ("float32", "float64"):
        return Value(f"sum(CAST({arg.sql} AS DOUBLE)){over}", DOUBLE)
    if arg.type.kind == "decimal":
        scale = (arg.type.scale or 0) if arg.type.size else 18
        return Value(f"CAST(sum({arg.sql}){over} AS DECIMAL(38,{scale}))", Type("decimal", 38, scale))
    if arg.type.spark().startswith("decimal"):
        return Value(f"CAST(sum({arg.sql}){over} AS DECIMAL(38,0))", Type("int128"))
    return Value(f"sum(CAST({arg.sql} AS BIGINT)){over}", BIGINT)


def default_name(node, index: int) -> str:
    if isinstance(node, t.Column):
        return node.name
    if isinstance(node, t.Aggregate):
        return f"{node.name}({'*' if node.arg is None else node.arg.name if isinstance(node.arg, t.Column) else 'expr'})"
    if isinstance(node, t.WindowCall):
        return node.text
    return f"expr{index + 1}"


def children(node) -> list:
    """The direct subtrees of an expression, subqueries not among them."""
    if isinstance(node, t.Unary | t.Cast):
        return [node.arg]
    if isinstance(node, t.Binary):
        return [node.left, node.right]
    if isinstance(node, t.In):
        return [node.arg, *node.items]
    if isinstance(node, t.Between):
        return [node.arg, node.low, node.high]
    if isinstance(node, t.Like):
        return [node.arg, node.pattern]
    if isinstance(node, t.IsNull):
        return [node.arg]
    if isinstance(node, t.Case):
        return [x for pair in node.branches for x in pair] + ([node.otherwise] if node.otherwise is not None else [])
    if isinstance(node, t.Call):
        return list(node.args)
    if isinstance(node, t.Aggregate):
        return [node.arg] if node.arg is not None else []
    return []


def contains(node, kind) -> bool:
    return isinstance(node, kind) or any(contains(c, kind) for c in children(node))


def rebuild(node, change):
    """The node with its direct subtrees changed."""
    if isinstance(node, t.Unary | t.Cast | t.IsNull):
        return replace(node, arg=change(node.arg))
    if isinstance(node, t.Binary):
        return replace(node, left=change(node.left), right=change(node.right))
    if isinstance(node, t.In):
        return replace(node, arg=change(node.arg), items=tuple(change(i) for i in node.items))
    if isinstance(node, t.Between):
        return replace(node, arg=change(node.arg), low=change(node.low), high=change(node.high))
    if isinstance(node, t.Like):
        return replace(node, arg=change(node.arg), pattern=change(node.pattern))
    if isinstance(node, t.Case):
        return replace(node, branches=tuple((change(c), change(r)) for c, r in node.branches), otherwise=change(node.otherwise) if node.otherwise is not None else None)
    if isinstance(node, t.Call):
        return replace(node, args=tuple(change(a) for a in node.args))
    if isinstance(node, t.Aggregate) and node.arg is not None:
        # an aggregate's argument names source columns
        return node
    return node


def sources_of(node) -> list:
    if isinstance(node, t.Join):
        return sources_of(node.left) + sources_of(node.right)
    return [node]


def subqueries(node) -> list:
    own = [getattr(node, "query", None)] if isinstance(node, t.In | t.Exists | t.Scalar) else []
    return [q for q in own if q is not None] + [q for c in children(node) for q in subqueries(c)]


def tables(q: t.Select) -> set[str]:
    """Every table or view name that a query mentions, common table expressions among them."""
    out: set[str] = set()

    def source(node) -> None:
        for s in sources_of(node):
            out.update({s.name} if isinstance(s, t.Named) else tables(s.query))

    def joins(node) -> None:
        if isinstance(node, t.Join):
            joins(node.left), joins(node.right)
            if node.on is not None:
                for sub in subqueries(node.on):
                    out.update(tables(sub))

    source(q.source)
    joins(q.source)
    values = [i.value for i in q.items or ()] + [x for x in (q.where, q.having) if x is not None] + list(q.group)
    for v in values:
        for sub in subqueries(v):
            out.update(tables(sub))
    for _, body in q.ctes:
        out.update(tables(body))
    if q.tail:
        out.update(tables(q.tail[1]))
    return out


def refers(q: t.Select, name: str) -> bool:
    return name.lower() in {x.lower() for x in tables(q)}
