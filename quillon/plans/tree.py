"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from .types import Type


@dataclass(frozen=True)
class Literal:
    kind: str  # int, float, text, blob, boolean, null, interval_ym, interval_ds
    value: object = None


@dataclass(frozen=True)
class Column:
    table: str | None
    name: str


@dataclass(frozen=True)
class Parameter:
    index: int


@dataclass(frozen=True)
class Unary:
    op: str  # -, NOT
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str  # arithmetic, comparison, AND, OR
    left: object
    right: object


@dataclass(frozen=True)
class In:
    arg: object
    items: tuple = ()
    query: Select | None = None
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool = False


@dataclass(frozen=True)
class Like:
    arg: object
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Scalar:
    query: Select


@dataclass(frozen=True)
class Case:
    branches: tuple
    otherwise: object = None


@dataclass(frozen=True)
class Cast:
    arg: object
    to: Type


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None: *


@dataclass(frozen=True)
class WindowCall:
    name: str
    arg: object
    partition: tuple
    order: tuple  # (Column, descending)
    text: str = ""


@dataclass(frozen=True)
class Named:
    """A table, view or common table expression in FROM."""

    name: str
    alias: str


@dataclass(frozen=True)
class Derived:
    query: Select
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # CROSS, INNER, LEFT, RIGHT, FULL
    left: object
    right: object
    on: object = None


@dataclass(frozen=True)
class Item:
    value: object
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple | None  # None: *
    source: object
    distinct: bool = False
    where: object = None
    group: tuple = ()
    having: object = None
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    into: str | None = None
    ctes: tuple = ()  # (name, Select)
    recursive: bool = False
    tail: tuple | None = None  # (UNION / UNION ALL / INTERSECT / EXCEPT, Select)
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: Type
    nullable: bool = True
    primary: bool = False
    auto: bool = False
    unique: bool = False
    default: object = None
    default_text: str | None = None
    check: str | None = None
    references: tuple | None = None


@dataclass(frozen=True)
class Constraint:
    kind: str  # UNIQUE, CHECK, FOREIGN, PRIMARY
    name: str | None
    columns: tuple = ()
    check: str | None = None
    target: str | None = None
    target_columns: tuple = ()
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class Statement:
    """Any statement but SELECT: its kind and named parts."""

    kind: str
    parts: dict = field(default_factory=dict, hash=False)
    text: str = ""

    def __getattr__(self, name):
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None
