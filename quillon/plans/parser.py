"""Recursive descent over the dialect's grammar. Set operations associate to the right."""

from __future__ import annotations

from ..errors import ParseError
from .lexer import KEYWORDS, SOFT, Token, tokenize
from .tree import (
    Aggregate, Between, Binary, Call, Case, Cast, Column, ColumnDef, Constraint, Derived, Exists, In, IsNull, Item, Join, Like, Literal, Named, Parameter, Scalar, Select, Statement, Unary, WindowCall,
)
from .types import Type

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
RANKINGS = ("ROW_NUMBER", "RANK", "DENSE_RANK")
SIZED = {"CHAR": "char", "VARCHAR": "varchar", "BINARY": "binary", "VARBINARY": "varbinary"}
PLAIN = {
    "INT8": "int8", "INT16": "int16", "INT": "int32", "INT32": "int32", "INT64": "int64", "INT128": "int128", "UINT8": "uint8", "UINT16": "uint16", "UINT": "uint32", "UINT32": "uint32", "UINT64": "uint64", "UINT128": "uint128",
    "FLOAT32": "float32", "FLOAT": "float64", "FLOAT64": "float64", "TEXT": "text", "BLOB": "blob", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "DATETIME": "datetime",
}


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at, self.parameters = sql, tokenize(sql), 0, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def is_(self, *words: str) -> bool:
        """Whether the next tokens are these keywords or marks."""
        return all(self.ahead(i).kind in ("keyword", "mark") and self.ahead(i).value == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                self.fail(f"expected {w}")

    def fail(self, what: str):
        t = self.now
        hint = f"; keywords must be capitalized: {t.value.upper()}" if t.kind == "name" and t.value.upper() in KEYWORDS else ""
        raise ParseError(f"{what} at {t.start}, found {t.value or 'the end'!r}{hint}")

    def name(self) -> str:
        t = self.now
        if t.kind == "name" or t.kind == "keyword" and t.value in SOFT:
            self.at += 1
            return t.value
        self.fail("expected a name")

    def word(self, value: str) -> bool:
        """A name with a fixed spelling, such as a type or INTERVAL's unit."""
        if self.now.kind in ("name", "keyword") and self.now.value == value:
            self.at += 1
            return True
        return False

    def integer(self) -> int:
        if self.now.kind != "number" or "." in self.now.value:
            self.fail("expected a non-negative integer")
        self.at += 1
        return int(self.tokens[self.at - 1].value)

    def many(self, one, closed: bool = True) -> tuple:
        if closed:
            self.need("(")
        out = [one()]
        while self.take(","):
            out.append(one())
        if closed:
            self.need(")")
        return tuple(out)

    # statements

    def statement(self):
        start = self.now.start
        out = self._statement()
        stop = self.now.start
        self.need(";")
        if self.now.kind != "end":
            self.fail("expected the end of the statement")
        if isinstance(out, Statement):
            return Statement(out.kind, out.parts, self.sql[start:stop].strip())
        return out

    def _statement(self):
        if self.is_("SELECT") or self.is_("WITH") or self.is_("("):
            return self.select()
        for word, rule in (("INSERT", self.insert), ("UPDATE", self.update), ("DELETE", self.delete), ("CREATE", self.create), ("DROP", self.drop), ("ALTER", self.alter), ("SHOW", self.show)):
            if self.take(word):
                return rule()
        if self.take("BEGIN"):
            self.take("TRANSACTION")
            return Statement("begin")
        if self.take("COMMIT"):
            self.take("TRANSACTION")
            return Statement("commit")
        if self.take("ROLLBACK"):
            if self.take("TO"):
                self.take("SAVEPOINT")
                return Statement("rollback_to", {"name": self.name()})
            self.take("TRANSACTION")
            return Statement("rollback")
        if self.take("SAVEPOINT"):
            return Statement("savepoint", {"name": self.name()})
        if self.take("RELEASE"):
            self.take("SAVEPOINT")
            return Statement("release", {"name": self.name()})
        if self.take("EXPLAIN"):
            return Statement("explain", {"query": self._statement()})
        if self.take("DESCRIBE"):
            return Statement("describe", {"table": self.name()})
        self.fail("expected a statement")

    def select(self) -> Select:
        start = self.now.start
        ctes, recursive = (), False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")

            def cte():
                name = self.name()
                self.need("AS", "(")
                query = self.select()
                self.need(")")
                return name, query

            ctes = self.many(cte, closed=False)
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items = None if self.take("*") else self.many(self.item, closed=False)
        into = self.name() if self.take("INTO") else None
        self.need("FROM")
        source = self.sources()
        where = self.expression() if self.take("WHERE") else None
        group = self.many(self.expression, closed=False) if self.take("GROUP", "BY") else ()
        having = self.expression() if self.take("HAVING") else None
        order = self.many(self.order_key, closed=False) if self.take("ORDER", "BY") else ()
        limit = offset = None
        if self.take("LIMIT"):
            limit = self.integer()
            if self.take(","):
                offset, limit = limit, self.integer()
        if self.take("OFFSET"):
            offset = self.integer()
        tail = None
        for op in ("UNION", "INTERSECT", "EXCEPT"):
            if self.take(op):
                tail = ("UNION ALL" if op == "UNION" and self.take("ALL") else op), self.select()
                break
        return Select(items, source, distinct, where, group, having, order, limit, offset, into, ctes, recursive, tail, self.sql[start : self.now.start].strip())

    def item(self) -> Item:
        value = self.expression()
        if self.take("AS"):
            return Item(value, self.name())
        if self.now.kind == "name":
            return Item(value, self.name())
        return Item(value)

    def order_key(self) -> tuple:
        value = self.expression()
        if self.take("DESC"):
            return value, True
        self.take("ASC")
        return value, False

    def sources(self):
        out = self.source()
        while True:
            if self.take(","):
                out = Join("CROSS", out, self.source())
                continue
            for kind, words in (("INNER", ("JOIN",)), ("INNER", ("INNER", "JOIN")), *((k, (k, *o, "JOIN")) for k in ("LEFT", "RIGHT", "FULL") for o in ((), ("OUTER",)))):
                if self.take(*words):
                    right = self.source()
                    self.need("ON")
                    out = Join(kind, out, right, self.expression())
                    break
            else:
                return out

    def source(self):
        if self.take("("):
            query = self.select()
            self.need(")")
            self.take("AS")
            return Derived(query, self.name())
        name = self.name()
        alias = self.name() if self.take("AS") or self.now.kind == "name" else name
        return Named(name, alias)

    # mutations

    def insert(self) -> Statement:
        self.need("INTO")
        parts = {"table": self.name(), "query": None, "rows": None, "duplicate": ()}
        if self.take("SET"):
            pairs = self.many(self.assignment, closed=False)
            parts |= {"columns": tuple(c.name for c, _ in pairs), "rows": (tuple(v for _, v in pairs),)}
        else:
            parts["columns"] = self.many(self.name)
            if self.take("VALUES"):
                parts["rows"] = self.many(lambda: self.many(self.expression), closed=False)
            else:
                parts["query"] = self.select()
        if self.take("ON"):
            self.need("DUPLICATE", "KEY", "UPDATE")
            parts["duplicate"] = self.many(self.assignment, closed=False)
        return Statement("insert", parts)

    def assignment(self) -> tuple:
        name = self.name()
        column = Column(name, self.name()) if self.take(".") else Column(None, name)
        self.need("=")
        return column, self.expression()

    def update(self) -> Statement:
        source = self.sources()
        self.need("SET")
        return Statement("update", {"source": source, "assignments": self.many(self.assignment, closed=False), "where": self.expression() if self.take("WHERE") else None})

    def delete(self) -> Statement:
        target = None if self.is_("FROM") else self.name()
        self.need("FROM")
        return Statement("delete", {"target": target, "source": self.sources(), "where": self.expression() if self.take("WHERE") else None})

    # definitions

    def exists(self, *, negated: bool) -> bool:
        return self.take("IF", "NOT", "EXISTS") if negated else self.take("IF", "EXISTS")

    def create(self) -> Statement:
        if self.take("TABLE"):
            lenient, name, columns, constraints = self.exists(negated=True), self.name(), [], []

            def element():
                if self.now.value in ("CONSTRAINT", "UNIQUE", "CHECK", "FOREIGN", "PRIMARY") and self.now.kind == "keyword":
                    constraints.append(self.constraint())
                else:
                    columns.append(self.column())

            self.many(element)
            return Statement("create_table", {"name": name, "lenient": lenient, "columns": tuple(columns), "constraints": tuple(constraints)})
        if self.take("VIEW"):
            lenient, name = self.exists(negated=True), self.name()
            self.need("AS")
            query = self.select()
            return Statement("create_view", {"name": name, "lenient": lenient, "query": query})
        if self.take("TRIGGER"):
            name = self.name()
            self.need("AFTER")
            event = next((e for e in ("INSERT", "UPDATE", "DELETE") if self.take(e)), None) or self.fail("expected INSERT, UPDATE or DELETE")
            self.need("ON")
            table = self.name()
            self.need("AS")
            start = self.now.start
            body = self._statement()
            return Statement("create_trigger", {"name": name, "event": event, "table": table, "body": body, "body_text": self.sql[start : self.now.start].strip()})
        unique = self.take("UNIQUE")
        if not (self.take("INDEX") or self.take("KEY")):
            self.fail("expected TABLE, VIEW, TRIGGER or INDEX")
        lenient, name = self.exists(negated=True), self.name()
        if self.take("USING"):
            self.need("BTREE")
        self.need("ON")
        return Statement("create_index", {"name": name, "lenient": lenient, "unique": unique, "table": self.name(), "columns": self.many(self.name)})

    def column(self) -> ColumnDef:
        parts = {"name": self.name(), "type": self.type()}
        while True:
            named = self.name() if self.take("CONSTRAINT") else None
            if self.take("PRIMARY", "KEY"):
                parts |= {"primary": True, "nullable": False}
            elif self.take("AUTO_INCREMENT"):
                parts["auto"] = True
            elif self.take("NOT", "NULL"):
                parts["nullable"] = False
            elif self.take("NULL"):
                pass
            elif self.take("UNIQUE"):
                self.take("KEY")
                parts["unique"] = True
            elif self.take("DEFAULT"):
                start = self.now.start
                parts["default"] = self.expression(8)
                parts["default_text"] = self.sql[start : self.now.start].strip()
            elif self.is_("CHECK"):
                parts["check"] = self.check()
            elif self.take("REFERENCES"):
                parts["references"] = self.references()
            elif named:
                self.fail("expected a constraint")
            else:
                return ColumnDef(**parts)

    def check(self) -> str:
        self.need("CHECK", "(")
        start = self.now.start
        self.expression()
        text = self.sql[start : self.now.start].strip()
        self.need(")")
        return text

    def references(self) -> tuple:
        table, columns = self.name(), self.many(self.name)
        actions = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while self.take("ON"):
            event = "DELETE" if self.take("DELETE") else "UPDATE" if self.take("UPDATE") else self.fail("expected DELETE or UPDATE")
            actions[event] = "CASCADE" if self.take("CASCADE") else "SET NULL" if self.take("SET", "NULL") else "RESTRICT" if self.take("RESTRICT") else self.fail("expected an action")
        return table, columns, actions["DELETE"], actions["UPDATE"]

    def constraint(self) -> Constraint:
        name = self.name() if self.take("CONSTRAINT") else None
        if self.take("PRIMARY", "KEY"):
            return Constraint("PRIMARY", name, self.many(self.name))
        if self.take("UNIQUE"):
            if not self.is_("("):
                self.take("KEY") or self.take("INDEX")
                if not self.is_("("):
                    name = self.name()
            return Constraint("UNIQUE", name, self.many(self.name))
        if self.is_("CHECK"):
            return Constraint("CHECK", name, check=self.check())
        self.need("FOREIGN", "KEY")
        columns = self.many(self.name)
        self.need("REFERENCES")
        target, target_columns, on_delete, on_update = self.references()
        return Constraint("FOREIGN", name, columns, None, target, target_columns, on_delete, on_update)

    def drop(self) -> Statement:
        for kind in ("TABLE", "VIEW", "TRIGGER"):
            if self.take(kind):
                return Statement(f"drop_{kind.lower()}", {"lenient": self.exists(negated=False), "name": self.name()})
        if not (self.take("INDEX") or self.take("KEY")):
            self.fail("expected TABLE, VIEW, TRIGGER or INDEX")
        lenient, name = self.exists(negated=False), self.name()
        self.need("ON")
        return Statement("drop_index", {"lenient": lenient, "name": name, "table": self.name()})

    def alter(self) -> Statement:
        self.need("TABLE")
        parts = {"table": self.name()}
        if self.take("RENAME", "TO"):
            return Statement("alter", parts | {"action": "rename", "to": self.name()})
        if self.take("RENAME", "COLUMN"):
            old = self.name()
            self.need("TO")
            return Statement("alter", parts | {"action": "rename_column", "column": old, "to": self.name()})
        if self.take("ADD", "COLUMN"):
            return Statement("alter", parts | {"action": "add_column", "definition": self.column()})
        if self.take("ADD"):
            return Statement("alter", parts | {"action": "add_constraint", "constraint": self.constraint()})
        if self.take("DROP", "COLUMN"):
            return Statement("alter", parts | {"action": "drop_column", "column": self.name()})
        if self.take("DROP", "CONSTRAINT"):
            return Statement("alter", parts | {"action": "drop_constraint", "name": self.name()})
        self.need("ALTER", "COLUMN")
        parts["column"] = self.name()
        if self.take("SET", "DEFAULT"):
            start = self.now.start
            self.expression()
            return Statement("alter", parts | {"action": "set_default", "default_text": self.sql[start : self.now.start].strip()})
        if self.take("DROP", "DEFAULT"):
            return Statement("alter", parts | {"action": "drop_default"})
        if self.take("SET", "NOT", "NULL"):
            return Statement("alter", parts | {"action": "set_not_null"})
        self.need("DROP", "NOT", "NULL")
        return Statement("alter", parts | {"action": "drop_not_null"})

    def show(self) -> Statement:
        if self.take("CREATE"):
            kind = "view" if self.take("VIEW") else "table"
            if kind == "table":
                self.need("TABLE")
            return Statement("show_create", {"of": kind, "name": self.name()})
        for kind in ("TABLES", "VIEWS"):
            if self.take(kind):
                return Statement("show", {"what": kind.lower(), "table": None})
        for kind in ("INDEXES", "TRIGGERS"):
            if self.take(kind):
                return Statement("show", {"what": kind.lower(), "table": self.name() if self.take("FROM") else None})
        self.fail("expected what to show")

    # types

    def type(self) -> Type:
        t = self.now
        if self.word("INTERVAL"):
            if self.word("YEAR"):
                self.need("TO", "MONTH")
                return Type("interval_ym")
            self.need("DAY", "TO", "SECOND")
            return Type("interval_ds")
        self.at += 1
        size = scale = None
        if t.value == "ENUM" and t.kind == "name":
            def text():
                if self.now.kind != "text":
                    self.fail("expected a text")
                self.at += 1
                return self.tokens[self.at - 1].value

            out = Type("enum", values=self.many(text))
        elif t.value in SIZED and t.kind == "name":
            self.need("(")
            size = self.integer()
            self.need(")")
            out = Type(SIZED[t.value], size)
        elif t.value == "DECIMAL" and t.kind == "name":
            if self.take("("):
                size, scale = self.integer(), 0
                if self.take(","):
                    scale = self.integer()
                self.need(")")
            out = Type("decimal", size, scale)
        elif t.value == "TIME" and t.kind == "name":
            out = Type("timetz" if self.take("WITH") and self._zone() else "time")
        elif t.value in PLAIN and t.kind == "name":
            out = Type(PLAIN[t.value])
        else:
            self.at -= 1
            self.fail("expected a type (types must be capitalized)")
        charset = collation = None
        while True:
            if self.take("CHARACTER", "SET"):
                charset = self.name()
            elif self.take("COLLATE"):
                collation = self.name()
            else:
                return Type(out.kind, out.size, out.scale, out.values, charset, collation) if charset or collation else out

    def _zone(self) -> bool:
        if not (self.word("TIME") and self.word("ZONE")):
            self.fail("expected TIME ZONE")
        return True

    # expressions, by binding strength: OR 1, AND 2, NOT 3, comparison 4, + - 5, * / % 6, unary - 7, primary 8

    def expression(self, strength: int = 1):
        if strength == 3:
            return Unary("NOT", self.expression(3)) if self.take("NOT") else self.comparison()
        if strength == 7:
            return Unary("-", self.expression(7)) if self.take("-") else self.primary()
        if strength == 8:
            return self.expression(7)
        ops = {1: ("OR",), 2: ("AND",), 5: ("+", "-"), 6: ("*", "/", "%")}[strength]
        following = {1: 2, 2: 3, 5: 6, 6: 7}[strength]
        out = self.expression(following)
        while True:
            op = next((o for o in ops if self.take(o)), None)
            if op is None:
                return out
            out = Binary(op, out, self.expression(following))

    def comparison(self):
        out = self.expression(5)
        while True:
            op = next((o for o in ("=", "<>", "!=", "<=", ">=", "<", ">") if self.take(o)), None)
            if op:
                out = Binary("<>" if op == "!=" else op, out, self.expression(5))
                continue
            if self.take("IS"):
                negated = self.take("NOT")
                self.need("NULL")
                out = IsNull(out, negated)
                continue
            mark = self.at
            negated = self.take("NOT")
            if self.take("IN"):
                if self.is_("(", "SELECT") or self.is_("(", "WITH"):
                    self.need("(")
                    out = In(out, query=self.select(), negated=negated)
                    self.need(")")
                else:
                    out = In(out, self.many(self.expression), negated=negated)
            elif self.take("BETWEEN"):
                low = self.expression(5)
                self.need("AND")
                out = Between(out, low, self.expression(5), negated)
            elif self.take("LIKE"):
                out = Like(out, self.expression(5), negated)
            else:
                self.at = mark
                return out

    def primary(self):
        t = self.now
        if t.kind == "number":
            self.at += 1
            return Literal("float" if "." in t.value else "int", t.value)
        if t.kind in ("text", "blob"):
            self.at += 1
            return Literal(t.kind, t.value)
        if self.take("?"):
            self.parameters += 1
            return Parameter(self.parameters)
        for word, value in (("TRUE", True), ("FALSE", False)):
            if self.take(word):
                return Literal("boolean", value)
        if self.take("NULL"):
            return Literal("null")
        if self.take("CASE"):
            branches = []
            while self.take("WHEN"):
                condition = self.expression()
                self.need("THEN")
                branches.append((condition, self.expression()))
            if not branches:
                self.fail("expected WHEN")
            otherwise = self.expression() if self.take("ELSE") else None
            self.need("END")
            return Case(tuple(branches), otherwise)
        if self.take("CAST"):
            self.need("(")
            value = self.expression()
            self.need("AS")
            out = Cast(value, self.type())
            self.need(")")
            return out
        if self.take("INTERVAL"):
            if self.now.kind != "text":
                self.fail("expected an interval text")
            text = self.now.value
            self.at += 1
            if self.take("YEAR"):
                self.need("TO", "MONTH")
                return Literal("interval_ym", text)
            self.need("DAY", "TO", "SECOND")
            return Literal("interval_ds", text)
        if self.take("EXISTS"):
            self.need("(")
            out = Exists(self.select())
            self.need(")")
            return out
        if self.take("("):
            if self.is_("SELECT") or self.is_("WITH"):
                out = Scalar(self.select())
            else:
                out = self.expression()
            self.need(")")
            return out
        start = t.start
        name = self.name()
        if self.take("("):
            return self.call(name, start)
        if self.take("."):
            return Column(name, self.name())
        return Column(None, name)

    def call(self, name: str, start: int):
        upper = name.upper()
        if upper in AGGREGATES or upper in RANKINGS:
            arg = None
            if upper in RANKINGS:
                pass
            elif upper == "COUNT" and self.take("*"):
                pass
            else:
                arg = self.expression()
            self.need(")")
            if self.take("OVER"):
                self.need("(")
                partition = self.many(self.expression, closed=False) if self.take("PARTITION", "BY") else ()
                order = self.many(self.order_key, closed=False) if self.take("ORDER", "BY") else ()
                self.need(")")
                return WindowCall(upper, arg, partition, order, self.sql[start : self.tokens[self.at - 1].stop])
            if upper in RANKINGS:
                self.fail("expected OVER")
            return Aggregate(upper, arg)
        args = ()
        if not self.take(")"):
            args = self.many(self.expression, closed=False)
            self.need(")")
        return Call(upper, args)


def parse(sql: str):
    """(tree, number of parameters)."""
    parser = Parser(sql)
    return parser.statement(), parser.parameters


def parse_expression(text: str):
    parser = Parser(text)
    out = parser.expression()
    if parser.now.kind != "end":
        parser.fail("expected the end of the expression")
    return out
