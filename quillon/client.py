"""What a client holds of a result: typed values of a row, and a cursor over a table's rows."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .errors import ValidationError
from .sources.storage import ROWID

#: Python types that each getter takes; a bool is no number.
KINDS: dict[str, tuple[type, ...]] = {
    "string": (str,), "bool": (bool,), "float": (float,), "decimal": (decimal.Decimal,), "blob": (bytes, bytearray), "date": (datetime.date,), "datetime": (datetime.datetime,), "interval": (datetime.timedelta, str),
}
BOUNDS = {"int": (-(2**31), 2**31), "bigint": (-(2**63), 2**63), "int128": (-(2**127), 2**127), "uint": (0, 2**32), "uint64": (0, 2**64), "uint128": (0, 2**128)}


class Cells:
    """A row's values, by place (from 0) or column name; a getter refuses a value of another type, and NULL."""

    def __init__(self, row: Row):
        self.row = row

    def __len__(self) -> int:
        return len(self.row)

    def get(self, at: int | str) -> Any:
        try:
            return self.row[at]
        except (IndexError, KeyError, ValueError):
            raise ValidationError(f"no column {at}") from None

    def is_null(self, at: int | str) -> bool:
        return self.get(at) is None

    def typed(self, kind: str, at: int | str) -> Any:
        value = self.get(at)
        if kind in BOUNDS:
            whole = not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, decimal.Decimal) and value == value.to_integral_value())
            low, high = BOUNDS[kind]
            if whole and low <= value < high:
                return int(value)
        elif kind == "date" and isinstance(value, datetime.datetime):
            pass
        elif isinstance(value, KINDS[kind]):
            return bytes(value) if kind == "blob" else value
        elif kind == "float" and isinstance(value, int | decimal.Decimal) and not isinstance(value, bool):
            return float(value)
        raise ValidationError(f"column {at} holds {type(value).__name__}, not {kind}")

    def __getattr__(self, name: str):
        kind = name.removeprefix("get_")
        if name.startswith("get_") and (kind in KINDS or kind in BOUNDS):
            return lambda at: self.typed(kind, at)
        raise AttributeError(name)


class Cursor:
    """Rows one by one in the order of a column; only a partition's rows are held. It stands before the first at first."""

    def __init__(self, rows: DataFrame, key: str = ROWID):
        self.rows, self.key = rows, key
        self._row: Row | None = None
        self._left: Iterator[Row] = iter(())
        self._begun = False

    def _from(self, rows: DataFrame) -> bool:
        self._left, self._begun = rows.orderBy(F.col(f"`{self.key}`")).toLocalIterator(), True
        return self.next()

    def first(self) -> bool:
        return self._from(self.rows)

    def next(self) -> bool:
        if not self._begun:
            return self.first()
        self._row = next(self._left, None)
        return self._row is not None

    def seek(self, value: Any) -> bool:
        """To the first row of that key; where there is none, the cursor is not valid."""
        if self._from(self.rows.where(F.col(f"`{self.key}`") >= F.lit(value))) and self._row[self.key] != value:
            self._row = None
        return self.is_valid()

    def current(self) -> Row | None:
        return self._row

    def is_valid(self) -> bool:
        return self._row is not None
