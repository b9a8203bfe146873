"""Logical column types and the Spark types that carry them."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ValidationError

#: DDL spelling -> (kind, bits or None). Kinds name the logical type everywhere else.
INTEGERS = {"int8": ("tinyint", -(2**7), 2**7 - 1), "int16": ("smallint", -(2**15), 2**15 - 1), "int32": ("int", -(2**31), 2**31 - 1), "int64": ("bigint", -(2**63), 2**63 - 1), "int128": ("decimal(38,0)", -(10**38) + 1, 10**38 - 1)}
UNSIGNED = {"uint8": ("smallint", 0, 2**8 - 1), "uint16": ("int", 0, 2**16 - 1), "uint32": ("bigint", 0, 2**32 - 1), "uint64": ("decimal(20,0)", 0, 2**64 - 1), "uint128": ("decimal(38,0)", 0, 10**38 - 1)}
EXACT = {**INTEGERS, **UNSIGNED}
FLOATS = ("float32", "float64")
TEXTS = ("text", "char", "varchar", "enum")
BLOBS = ("blob", "binary", "varbinary")


@dataclass(frozen=True)
class Type:
    kind: str
    size: int | None = None
    scale: int | None = None
    values: tuple[str, ...] = ()
    charset: str | None = None
    collation: str | None = None

    @property
    def is_integer(self) -> bool:
        return self.kind in EXACT

    @property
    def is_numeric(self) -> bool:
        return self.kind in EXACT or self.kind in FLOATS or self.kind == "decimal"

    @property
    def is_text(self) -> bool:
        return self.kind in TEXTS

    @property
    def is_blob(self) -> bool:
        return self.kind in BLOBS

    @property
    def nocase(self) -> bool:
        return bool(self.collation) and self.collation.lower().endswith("nocase")

    @property
    def comparison(self) -> str | None:
        """The Spark collation that comparisons use, if not the binary one."""
        if self.kind == "char":
            return "UTF8_LCASE_RTRIM" if self.nocase else "UTF8_BINARY_RTRIM"
        return "UTF8_LCASE" if self.is_text and self.nocase else None

    def spark(self) -> str:
        if self.kind in EXACT:
            return EXACT[self.kind][0]
        if self.kind == "decimal":
            return f"decimal({self.size or 38},{self.scale if self.scale is not None else (0 if self.size else 18)})"
        return {
            "float32": "float", "float64": "double", "boolean": "boolean", "date": "date", "time": "int", "datetime": "timestamp_ntz", "timetz": "struct<secs:int,offset_min:smallint>",
            "interval_ym": "interval year to month", "interval_ds": "interval day to second", "null": "void",
        }.get(self.kind) or ("binary" if self.is_blob else "string")

    def ddl(self) -> str:
        """The dialect's spelling."""
        if self.kind == "enum":
            own = "ENUM(" + ", ".join("'" + v.replace("'", "''") + "'" for v in self.values) + ")"
        elif self.kind == "decimal":
            own = "DECIMAL" + (f"({self.size}" + (f", {self.scale}" if self.scale is not None else "") + ")" if self.size else "")
        else:
            own = {"timetz": "TIME WITH TIME ZONE", "interval_ym": "INTERVAL YEAR TO MONTH", "interval_ds": "INTERVAL DAY TO SECOND", "int32": "INT", "uint32": "UINT", "float64": "FLOAT"}.get(self.kind, self.kind.upper())
            own += f"({self.size})" if self.size else ""
        return own + (f" CHARACTER SET {self.charset}" if self.charset else "") + (f" COLLATE {self.collation}" if self.collation else "")


INT, BIGINT, DOUBLE, TEXT, BOOLEAN, DATE, TIME, DATETIME, BLOB, NULL = (Type(k) for k in ("int32", "int64", "float64", "text", "boolean", "date", "time", "datetime", "blob", "null"))


def from_spark(name: str) -> Type:
    """The logical type of a Spark column of an external table."""
    known = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "text", "boolean": "boolean", "date": "date", "timestamp_ntz": "datetime", "timestamp": "datetime", "binary": "blob", "void": "null"}
    if name in known:
        return Type(known[name])
    if name.startswith("decimal"):
        size, scale = name[8:-1].split(",")
        return Type("decimal", int(size), int(scale))
    if name.startswith("interval"):
        return Type("interval_ym" if "month" in name or "year" in name else "interval_ds")
    return Type("other:" + name)


def common(types: list[Type]) -> Type:
    """The type that values of several types share, numeric kinds promoted."""
    real = [t for t in types if t.kind != "null"]
    if not real:
        return NULL
    if all(t.is_numeric for t in real):
        if any(t.kind in FLOATS for t in real):
            return DOUBLE
        if any(t.kind == "decimal" for t in real):
            scales = max(t.scale or 0 if t.size else 18 for t in real if t.kind == "decimal")
            return Type("decimal", 38, scales)
        if len({t.kind for t in real}) == 1:
            return real[0]
        wide = max(EXACT[t.kind][2] for t in real)
        return Type(next(k for k in ("int32", "int64", "int128") if INTEGERS[k][2] >= min(wide, INTEGERS["int128"][2])))
    if all(t.is_text for t in real):
        return next((t for t in real if t.comparison), TEXT)
    if len({t.kind for t in real}) > 1 and not all(t.is_blob for t in real):
        raise ValidationError(f"values of types {', '.join(t.ddl() for t in real)} do not mix")
    return real[0]
