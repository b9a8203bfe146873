"""Scalar functions: each takes rendered arguments and gives a rendered result with its type.

A rendered value is (sql, type). NULL arguments give NULL unless noted. Where Spark differs from
the dialect, the text carries a guard, so that the result stays inside whole-stage code.
"""

from __future__ import annotations

from typing import NamedTuple

from ..errors import ValidationError
from ..plans.types import BIGINT, BLOB, BOOLEAN, DATE, DATETIME, DOUBLE, EXACT, FLOATS, INT, TEXT, TIME, Type, common


class Value(NamedTuple):
    sql: str
    type: Type


def quote(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fail(message: str) -> str:
    return f"raise_error({quote(message)})"


def cast(v: Value, to: Type) -> str:
    return v.sql if v.type.spark() == to.spark() else f"CAST({v.sql} AS {to.spark()})"


TIME_TEXT = "^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
DATE_TEXT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_TEXT = "^[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
ZONE_TEXT = "^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9][+-][0-9]{2}:[0-9]{2}$"


def guarded(sql: str, pattern: str, result: str, what: str) -> str:
    """result, if the text fits the pattern; an error else."""
    return f"(CASE WHEN {sql} IS NULL THEN NULL WHEN {sql} RLIKE {quote(pattern)} THEN {result} ELSE {fail(f'invalid {what}')} END)"


def seconds_of(sql: str) -> str:
    return f"(CAST(substring({sql}, 1, 2) AS INT) * 3600 + CAST(substring({sql}, 4, 2) AS INT) * 60 + CAST(substring({sql}, 7, 2) AS INT))"


def clock(sql: str) -> str:
    """HH:MM:SS of seconds since midnight."""
    return f"concat(lpad(CAST({sql} div 3600 AS STRING), 2, '0'), ':', lpad(CAST({sql} div 60 % 60 AS STRING), 2, '0'), ':', lpad(CAST({sql} % 60 AS STRING), 2, '0'))"


def zone(sql: str) -> str:
    minutes = f"abs(CAST({sql}.offset_min AS INT))"
    return f"concat({clock(f'{sql}.secs')}, CASE WHEN {sql}.offset_min < 0 THEN '-' ELSE '+' END, lpad(CAST({minutes} div 60 AS STRING), 2, '0'), ':', lpad(CAST({minutes} % 60 AS STRING), 2, '0'))"


def to_text(v: Value) -> str:
    t = v.type
    if t.is_text:
        return v.sql
    if t.kind == "boolean":
        return f"upper(CAST({v.sql} AS STRING))"
    if t.kind == "time":
        return clock(v.sql)
    if t.kind == "timetz":
        return f"(CASE WHEN {v.sql} IS NULL THEN NULL ELSE {zone(v.sql)} END)"
    if t.is_blob:
        return f"decode({v.sql}, 'UTF-8')"
    if t.kind == "datetime":
        return f"date_format({v.sql}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({v.sql} AS STRING)"


def to_date(v: Value) -> str:
    if v.type.kind == "date":
        return v.sql
    if v.type.kind == "datetime":
        return f"CAST({v.sql} AS DATE)"
    if v.type.is_text:
        return guarded(v.sql, "^[0-9]{4}-[0-9]{2}-[0-9]{2}( .*)?$", f"CAST(left({v.sql}, 10) AS DATE)", "DATE")
    if v.type.kind == "null":
        return f"CAST({v.sql} AS DATE)"
    raise ValidationError(f"a date is expected, not {v.type.ddl()}")


def to_datetime(v: Value) -> str:
    if v.type.kind == "datetime":
        return v.sql
    if v.type.is_text:
        return guarded(v.sql, DATETIME_TEXT, f"CAST({v.sql} AS TIMESTAMP_NTZ)", "DATETIME")
    return f"CAST({v.sql} AS TIMESTAMP_NTZ)"


def to_time(v: Value) -> str:
    """Seconds since midnight."""
    if v.type.kind == "time":
        return v.sql
    if v.type.kind == "timetz":
        return f"{v.sql}.secs"
    if v.type.kind == "datetime":
        return f"(hour({v.sql}) * 3600 + minute({v.sql}) * 60 + second({v.sql}))"
    if v.type.is_text:
        return guarded(v.sql, TIME_TEXT, seconds_of(v.sql), "TIME")
    if v.type.kind == "null":
        return f"CAST({v.sql} AS INT)"
    raise ValidationError(f"a time is expected, not {v.type.ddl()}")


def _text(name: str, v: Value) -> str:
    if not (v.type.is_text or v.type.kind == "null"):
        raise ValidationError(f"{name} takes a text, not {v.type.ddl()}")
    return v.sql if v.type.is_text else f"CAST({v.sql} AS STRING)"


def _count(name: str, v: Value) -> str:
    if not (v.type.is_integer or v.type.kind == "null"):
        raise ValidationError(f"{name} takes an integer, not {v.type.ddl()}")
    return f"CAST({v.sql} AS INT)"


def _number(name: str, v: Value) -> str:
    if not (v.type.is_numeric or v.type.kind == "null"):
        raise ValidationError(f"{name} takes a number, not {v.type.ddl()}")
    return v.sql


def _shared(args: list[Value]) -> tuple[list[str], Type]:
    t = common([a.type for a in args])
    return [cast(a, t) if a.type.kind != "null" else f"CAST(NULL AS {t.spark()})" if t.kind != "null" else a.sql for a in args], t


def _coalesce(*args: Value) -> Value:
    sql, t = _shared(list(args))
    return Value(f"coalesce({', '.join(sql)})", t)


def _nullif(a: Value, b: Value) -> Value:
    return Value(f"nullif({a.sql}, {b.sql})", a.type)


def _extreme(function: str):
    def make(*args: Value) -> Value:
        sql, t = _shared(list(args))
        missing = " OR ".join(f"{s} IS NULL" for s in sql)
        return Value(f"(CASE WHEN {missing} THEN NULL ELSE {function}({', '.join(sql)}) END)", t)

    return make


def _of_text(function: str):
    return lambda v: Value(f"{function}({_text(function.upper(), v)})", TEXT)


def _trim(v: Value) -> Value:
    return Value(f"regexp_replace({_text('TRIM', v)}, '(?U)^\\\\s+|\\\\s+$', '')", TEXT)


def _length(v: Value) -> Value:
    if not (v.type.is_text or v.type.is_blob or v.type.kind == "null"):
        raise ValidationError(f"LENGTH takes a text or blob, not {v.type.ddl()}")
    return Value(f"length({v.sql})", INT)


def _octets(function: str):
    return lambda v: Value(f"{function}({v.sql if v.type.is_blob else _text(function.upper(), v)})", INT)


def _concat(*args: Value) -> Value:
    return Value(f"concat({', '.join(to_text(a) for a in args)})", TEXT)


def _concat_ws(separator: Value, *args: Value) -> Value:
    return Value(f"concat_ws({', '.join([_text('CONCAT_WS', separator), *[to_text(a) for a in args]])})", TEXT)


def _substring(s: Value, start: Value, length: Value | None = None) -> Value:
    text, at = _text("SUBSTRING", s), _count("SUBSTRING", start)
    begin = f"(CASE WHEN {at} = 0 THEN 1 WHEN {at} < 0 THEN greatest(length({text}) + {at} + 1, 1) ELSE {at} END)"
    if length is None:
        sql = f"substring({text}, {begin})"
    else:
        sql = f"substring({text}, {begin}, greatest({_count('SUBSTRING', length)}, 0))"
    guard = f"{at} IS NULL" + (f" OR {length.sql} IS NULL" if length else "")
    return Value(f"(CASE WHEN {guard} THEN NULL ELSE {sql} END)", TEXT)


def _side(function: str):
    return lambda s, n: Value(f"{function}({_text(function.upper(), s)}, {_count(function.upper(), n)})", TEXT)


def _replace(s: Value, old: Value, new: Value) -> Value:
    a, b, c = (_text("REPLACE", v) for v in (s, old, new))
    # an empty pattern stands before every character and at the end
    everywhere = f"concat({c}, regexp_replace({a}, '(?s)(.)', concat('$1', replace(replace({c}, '\\\\', '\\\\\\\\'), '$', '\\\\$'))))"
    return Value(f"(CASE WHEN {b} = '' THEN {everywhere} ELSE replace({a}, {b}, {c}) END)", TEXT)


def _repeat(s: Value, n: Value) -> Value:
    return Value(f"repeat({_text('REPEAT', s)}, {_count('REPEAT', n)})", TEXT)


def _locate(part: Value, s: Value, at: Value | None = None) -> Value:
    a, b = _text("LOCATE", part), _text("LOCATE", s)
    start = f"greatest({_count('LOCATE', at)}, 1)" if at else "1"
    missing = f"{a} IS NULL OR {b} IS NULL" + (f" OR {at.sql} IS NULL" if at else "")
    return Value(f"(CASE WHEN {missing} THEN NULL WHEN {a} = '' THEN least({start}, length({b}) + 1) ELSE locate({a}, {b}, {start}) END)", INT)


def _hex(v: Value) -> Value:
    if not (v.type.is_text or v.type.is_blob or v.type.kind == "null"):
        raise ValidationError("HEX takes a text or blob")
    return Value(f"hex(CAST({v.sql} AS BINARY))", TEXT)


def _unhex(v: Value) -> Value:
    text = _text("UNHEX", v)
    return Value(guarded(text, "^([0-9A-Fa-f]{2})*$", f"unhex({text})", "hexadecimal text"), BLOB)


def _abs(v: Value) -> Value:
    number = _number("ABS", v)
    return Value(f"(CASE WHEN {number} < 0 THEN {_opposite(number, v.type)} ELSE {number} END)" if _wide(v.type) else f"abs({number})", v.type)


def _wide(t: Type) -> bool:
    """Whether values may have more than 34 digits, beyond which Spark's unary minus rounds."""
    return (t.is_integer or t.kind == "decimal") and t.spark().startswith("decimal") and _digits(t) > 34


def _opposite(sql: str, t: Type) -> str:
    if not _wide(t):
        return f"(-{sql})"
    text = f"CAST({sql} AS STRING)"
    return f"CAST(CASE WHEN {sql} < 0 THEN substring({text}, 2) WHEN {sql} > 0 THEN concat('-', {text}) ELSE {text} END AS {t.spark()})"


def _round(v: Value, places: Value | None = None) -> Value:
    number = _number("ROUND", v)
    if v.type.kind not in FLOATS:
        return Value(f"round({number}, {places.sql if places else 0})", v.type)
    # the double itself is scaled: 1.005 lies below the tie, and so does its product with 100
    x, n = f"CAST({number} AS DOUBLE)", f"CAST({places.sql if places else 0} AS INT)"
    scale = f"pow(10D, abs({n}))"
    sql = f"(CASE WHEN {n} >= 0 THEN round({x} * {scale}, 0) / {scale} ELSE round({x} / {scale}, 0) * {scale} END)"
    return Value(f"CAST({sql} AS {v.type.spark()})", v.type)


def _whole(function: str):
    def make(v: Value) -> Value:
        sql = _number(function.upper(), v)
        return Value(f"CAST({function}({sql}) AS {v.type.spark()})" if v.type.kind in FLOATS or v.type.kind == "decimal" else sql, v.type)

    return make


def _power(a: Value, b: Value) -> Value:
    result = f"pow(CAST({_number('POWER', a)} AS DOUBLE), CAST({_number('POWER', b)} AS DOUBLE))"
    return Value(f"(CASE WHEN isnan({result}) OR abs({result}) = double('infinity') THEN {fail('POWER is not finite')} ELSE {result} END)", DOUBLE)


def _date(v: Value) -> Value:
    return Value(to_date(v), DATE)


def _time(v: Value) -> Value:
    return Value(to_time(v), TIME)


def _date_part(function: str):
    return lambda v: Value(f"{function}({to_date(v)})", INT)


def _time_part(divisor: int, modulus: int):
    return lambda v: Value(f"CAST({to_time(v)} div {divisor} % {modulus} AS INT)", INT)


def _sec_to_time(v: Value) -> Value:
    return Value(f"CAST(pmod(CAST({_number('SEC_TO_TIME', v)} AS BIGINT), 86400) AS INT)", TIME)


def _unix_timestamp(v: Value) -> Value:
    at = to_datetime(v) if v.type.kind != "date" else f"CAST({v.sql} AS TIMESTAMP_NTZ)"
    return Value(epoch(at), BIGINT)


def epoch(sql: str) -> str:
    """Seconds since 1970 of a datetime, independent of the session's zone."""
    return f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {sql}) AS BIGINT)"


#: name -> (least arguments, most arguments or None, maker)
FUNCTIONS = {
    "COALESCE": (1, None, _coalesce), "IFNULL": (2, 2, _coalesce), "NULLIF": (2, 2, _nullif), "GREATEST": (2, None, _extreme("greatest")), "LEAST": (2, None, _extreme("least")),
    "LOWER": (1, 1, _of_text("lower")), "UPPER": (1, 1, _of_text("upper")), "TRIM": (1, 1, _trim), "LENGTH": (1, 1, _length), "OCTET_LENGTH": (1, 1, _octets("octet_length")), "BIT_LENGTH": (1, 1, _octets("bit_length")),
    "CONCAT": (1, None, _concat), "CONCAT_WS": (2, None, _concat_ws), "SUBSTRING": (2, 3, _substring), "SUBSTR": (2, 3, _substring), "LEFT": (2, 2, _side("left")), "RIGHT": (2, 2, _side("right")),
    "REPLACE": (3, 3, _replace), "REPEAT": (2, 2, _repeat), "REVERSE": (1, 1, _of_text("reverse")), "LOCATE": (2, 3, _locate), "HEX": (1, 1, _hex), "UNHEX": (1, 1, _unhex),
    "ABS": (1, 1, _abs), "ROUND": (1, 2, _round), "CEIL": (1, 1, _whole("ceil")), "CEILING": (1, 1, _whole("ceil")), "FLOOR": (1, 1, _whole("floor")), "POWER": (2, 2, _power), "POW": (2, 2, _power),
    "DATE": (1, 1, _date), "TIME": (1, 1, _time), "YEAR": (1, 1, _date_part("year")), "MONTH": (1, 1, _date_part("month")), "DAY": (1, 1, _date_part("dayofmonth")),
    "HOUR": (1, 1, _time_part(3600, 24)), "MINUTE": (1, 1, _time_part(60, 60)), "SECOND": (1, 1, _time_part(1, 60)),
    "TIME_TO_SEC": (1, 1, lambda v: Value(f"CAST({to_time(v)} AS BIGINT)", BIGINT)), "SEC_TO_TIME": (1, 1, _sec_to_time), "UNIX_TIMESTAMP": (1, 1, _unix_timestamp),
}


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise ValidationError(f"unknown function {name}")
    least, most, make = FUNCTIONS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise ValidationError(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments")
    return make(*args)


# casts


def cast_to(v: Value, to: Type) -> Value:
    """CAST with the dialect's strictness: no trimming, no rounding, no extra boolean words."""
    sql, t = v.sql, v.type
    if t.kind == "null":
        return Value(f"CAST(NULL AS {to.spark()})", to)
    if to.kind in EXACT:
        spark, low, high = EXACT[to.kind]
        if t.is_text:
            number = guarded(sql, "^[+-]?[0-9]+$", f"CAST({sql} AS DECIMAL(38,0))", "integer text")
        elif t.kind == "boolean":
            number = f"CAST(CAST({sql} AS INT) AS DECIMAL(38,0))"
        elif t.is_blob:
            number = f"CAST(conv(hex(reverse({sql})), 16, 10) AS DECIMAL(38,0))"
        elif t.kind in FLOATS:
            number = f"CAST(CASE WHEN {sql} < 0 THEN ceil({sql}) ELSE floor({sql}) END AS DECIMAL(38,0))"
        elif t.kind == "decimal":
            number = f"CAST(CASE WHEN {sql} < 0 THEN ceil({sql}) ELSE floor({sql}) END AS DECIMAL(38,0))"
        elif t.is_integer:
            if EXACT[t.kind][1] >= low and EXACT[t.kind][2] <= high:
                return Value(f"CAST({sql} AS {spark})", to)
            number = f"CAST({sql} AS DECIMAL(38,0))"
        else:
            raise ValidationError(f"cannot cast {t.ddl()} to {to.ddl()}")
        return Value(f"CAST((CASE WHEN {number} < {low} OR {number} > {high} THEN {fail(to.ddl() + ' out of range')} ELSE {number} END) AS {spark})", to)
    if to.kind in FLOATS:
        if t.is_text:
            sql = guarded(sql, "^[+-]?[0-9]+(\\\\.[0-9]+)?([eE][+-]?[0-9]+)?$".replace("\\\\", "\\"), f"CAST({sql} AS DOUBLE)", "number text")
        elif not (t.is_numeric or t.kind == "boolean"):
            raise ValidationError(f"cannot cast {t.ddl()} to {to.ddl()}")
        return Value(f"CAST({sql} AS {to.spark()})", to)
    if to.kind == "decimal":
        if t.is_text:
            sql = guarded(sql, "^[+-]?[0-9]+(\\.[0-9]+)?$", sql, "decimal text")
        elif not (t.is_numeric or t.kind == "boolean"):
            raise ValidationError(f"cannot cast {t.ddl()} to {to.ddl()}")
        if t.kind == "boolean":
            sql = f"CAST({sql} AS INT)"
        exact = f"CAST({sql} AS STRING)" if t.kind in FLOATS else sql
        if not to.size:
            return Value(f"CAST({exact} AS {to.spark()})", to)
        fitted = f"CAST({exact} AS {to.spark()})"
        scale = to.scale or 0
        wide = f"CAST({exact} AS DECIMAL(38,{min(18, max(scale + 6, 12))}))"
        return Value(f"(CASE WHEN {wide} IS NULL THEN NULL WHEN abs({wide}) >= {'1' + '0' * (to.size - scale)} OR round({wide}, {scale}) <> {wide} THEN {fail(f'value does not fit {to.ddl()}')} ELSE {fitted} END)", to)
    if to.kind == "boolean":
        if t.is_text:
            return Value(f"(CASE upper({sql}) WHEN 'TRUE' THEN TRUE WHEN '1' THEN TRUE WHEN 'FALSE' THEN FALSE WHEN '0' THEN FALSE ELSE CASE WHEN {sql} IS NULL THEN NULL ELSE {fail('invalid BOOLEAN')} END END)", to)
        if t.is_numeric:
            return Value(f"({sql} <> 0)", to)
        if t.kind == "boolean":
            return Value(sql, to)
        raise ValidationError(f"cannot cast {t.ddl()} to BOOLEAN")
    if to.kind in ("text", "char", "varchar", "enum"):
        text = to_text(v)
        if to.kind in ("char", "varchar"):
            padded = f"rpad({text}, {to.size}, ' ')" if to.kind == "char" else text
            return Value(f"(CASE WHEN length({text}) > {to.size} THEN {fail(f'text too long for {to.ddl()}')} ELSE {padded} END)", to)
        if to.kind == "enum":
            listed = ", ".join(quote(x) for x in to.values)
            return Value(f"(CASE WHEN {text} IS NULL OR {text} IN ({listed}) THEN {text} ELSE {fail('unknown ENUM value')} END)", to)
        return Value(text, to)
    if to.is_blob:
        if t.is_text:
            data = f"CAST({sql} AS BINARY)"
        elif t.is_blob:
            data = sql
        elif t.is_integer:
            width = {"tinyint": 2, "smallint": 4, "int": 8, "bigint": 16}.get(t.spark())
            if not width:
                raise ValidationError(f"cannot cast {t.ddl()} to {to.ddl()}")
            data = f"reverse(unhex(right(lpad(hex({sql}), 16, '0'), {width})))"
            data = f"unhex(array_join(reverse(filter(split(regexp_replace(right(lpad(hex(CAST({sql} AS BIGINT)), 16, '0'), {width}), '(..)', '$1,'), ','), x -> x <> '')), ''))"
        else:
            raise ValidationError(f"cannot cast {t.ddl()} to {to.ddl()}")
        if to.kind == "blob":
            return Value(data, to)
        long = f"length({data}) > {to.size}"
        fitted = f"unhex(rpad(hex({data}), {2 * (to.size or 0)}, '0'))" if to.kind == "binary" else data
        return Value(f"(CASE WHEN {long} THEN {fail(f'bytes too long for {to.ddl()}')} ELSE {fitted} END)", to)
    if to.kind == "date" and (t.is_text or t.kind in ("date", "datetime")):
        return Value(guarded(sql, DATE_TEXT, f"CAST({sql} AS DATE)", "DATE") if t.is_text else to_date(v), to)
    if to.kind == "time" and (t.is_text or t.kind in ("time", "timetz", "datetime")):
        return Value(to_time(v), to)
    if to.kind == "datetime" and (t.is_text or t.kind in ("date", "datetime")):
        return Value(to_datetime(v), to)
    if to.kind == "timetz" and t.kind == "timetz":
        return v
    if to.kind == "timetz" and t.is_text:
        minutes = f"(CAST(substring({sql}, 10, 2) AS INT) * 60 + CAST(substring({sql}, 13, 2) AS INT))"
        offset = f"CAST(CASE substring({sql}, 9, 1) WHEN '-' THEN -{minutes} ELSE {minutes} END AS SMALLINT)"
        return Value(guarded(sql, ZONE_TEXT, f"named_struct('secs', {seconds_of(sql)}, 'offset_min', {offset})", "TIME WITH TIME ZONE"), to)
    if to.kind == t.kind:
        return v
    if to.kind == "interval_ym" and t.is_text:
        return Value(guarded(sql, "^-?[0-9]+-[0-9]{1,2}$", f"CAST({sql} AS INTERVAL YEAR TO MONTH)", "INTERVAL"), to)
    if to.kind == "interval_ds" and t.is_text:
        return Value(guarded(sql, "^-?[0-9]+ [0-9]{2}:[0-9]{2}:[0-9]{2}$", f"CAST({sql} AS INTERVAL DAY TO SECOND)", "INTERVAL"), to)
    raise ValidationError(f"cannot cast {t.ddl()} to {to.ddl()}")


# operators


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = a.type, b.type
    if "null" in (x.kind, y.kind):
        other = y if x.kind == "null" else x
        if other.kind == "null":
            return Value("CAST(NULL AS BIGINT)", BIGINT)
        if other.is_numeric:
            a, b = (Value(f"CAST({v.sql} AS {other.spark()})", other) for v in (a, b))
            x = y = other
        else:
            return Value(f"CAST(NULL AS {other.spark()})", other)
    if x.is_numeric and y.is_numeric:
        if x.kind in FLOATS or y.kind in FLOATS:
            return Value(f"(CAST({a.sql} AS DOUBLE) {op} CAST({b.sql} AS DOUBLE))", DOUBLE)
        scales = [0 if t.is_integer else (t.scale or 0) if t.size else 18 for t in (x, y)]
        if op == "/":
            return Value(_quotient(a, b, *scales), Type("decimal", 38, 18))
        if x.is_integer and y.is_integer:
            # two 64-bit sides may need more; with a smaller side the result stays 64 bits, and overflow is an error
            kinds = [t.spark() for t in (x, y)]
            small = all(k in ("tinyint", "smallint", "int", "bigint") for k in kinds) and kinds != ["bigint", "bigint"]
            if op == "%":
                wide = Type("int128") if any(k.startswith("decimal") for k in kinds) else BIGINT
                return Value(f"(CAST({a.sql} AS {wide.spark()}) % CAST({b.sql} AS {wide.spark()}))", wide)
            if small:
                return Value(f"(CAST({a.sql} AS BIGINT) {op} CAST({b.sql} AS BIGINT))", BIGINT)
            return Value(f"CAST(CAST({a.sql} AS DECIMAL(38,0)) {op} CAST({b.sql} AS DECIMAL(38,0)) AS DECIMAL(38,0))", Type("int128"))
        # a product is exact if its operands have 37 digits together
        out = max(scales) if op in "+-%" else sum(scales) if _digits(x) + _digits(y) < 38 else min(sum(scales), 18)
        return Value(f"CAST({a.sql} {op} {b.sql} AS DECIMAL(38,{out}))", Type("decimal", 38, out))
    out = _temporal(op, a, b)
    if out is None:
        raise ValidationError(f"no operator {x.ddl()} {op} {y.ddl()}")
    return out


def _digits(t: Type) -> int:
    """Decimal digits that a value of an exact type may have."""
    name = t.spark()
    return {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}.get(name) or int(name[8:].split(",")[0])


def _quotient(a: Value, b: Value, s: int, r: int) -> str:
    """a / b with 18 digits after the point; a has s of them, b r. No operand loses a digit.

    Spark keeps 18 digits if a's digits before the point and b's after it are 20 together. A wide
    divisor is taken by the digits that it really has after the point; what still has more is an error.
    """

    p = _digits(a.type)
    if p - s + r <= 20:
        return f"CAST(CAST({a.sql} AS DECIMAL({p},{s})) / CAST({b.sql} AS DECIMAL(38,{r})) AS DECIMAL(38,18))"

    def by(scale: int) -> str:
        most = min(p, 20 - scale + s)
        if most <= s:
            return "NULL"
        return f"try_cast(try_divide(try_cast({a.sql} AS DECIMAL({most},{s})), CAST({b.sql} AS DECIMAL(38,{scale}))) AS DECIMAL(38,18))"

    # no branch fails by itself: the optimizer folds those that are not taken too
    cases = "".join(f"WHEN try_cast(CAST({b.sql} AS DECIMAL(38,{scale})) AS {b.type.spark()}) = {b.sql} THEN {by(scale)} " for scale in (0, 6, 12) if scale < r)
    result = f"CASE {cases}ELSE {by(r)} END" if cases else by(r)
    return f"coalesce({result}, CASE WHEN {a.sql} IS NULL OR {b.sql} IS NULL THEN NULL ELSE {fail('a division by zero, or of more than 38 digits')} END)"


def _temporal(op: str, a: Value, b: Value) -> Value | None:
    x, y = a.type.kind, b.type.kind
    if op not in "+-":
        return None
    if op == "+" and y in ("date", "datetime", "time", "timetz") and x not in ("date", "datetime", "time", "timetz"):
        return _temporal(op, b, a)
    whole = b.type.is_integer
    days = f"CAST(extract(DAY FROM {b.sql}) AS INT)"
    if x == "date":
        if y == "date" and op == "-":
            return Value(f"CAST(datediff({a.sql}, {b.sql}) AS BIGINT)", BIGINT)
        if whole:
            return Value(f"date_add({a.sql}, CAST({op}({b.sql}) AS INT))", DATE)
        if y == "interval_ym":
            return Value(f"CAST({a.sql} {op} {b.sql} AS DATE)", DATE)
        if y == "interval_ds":
            rest = f"(extract(HOUR FROM {b.sql}) <> 0 OR extract(MINUTE FROM {b.sql}) <> 0 OR extract(SECOND FROM {b.sql}) <> 0)"
            return Value(f"(CASE WHEN {rest} THEN {fail('DATE takes whole days')} ELSE date_add({a.sql}, {op}{days}) END)", DATE)
    if x == "datetime":
        if y == "datetime" and op == "-":
            return Value(f"({epoch(a.sql)} - {epoch(b.sql)})", BIGINT)
        if whole:
            return Value(f"({a.sql} {op} make_dt_interval(0, 0, 0, CAST({b.sql} AS DECIMAL(18,6))))", DATETIME)
        if y in ("interval_ym", "interval_ds"):
            return Value(f"({a.sql} {op} {b.sql})", DATETIME)
    if x in ("time", "timetz"):
        seconds = f"{a.sql}.secs" if x == "timetz" else a.sql
        if x == y == "time" and op == "-":
            return Value(f"({a.sql} - {b.sql})", INT)
        if y == "interval_ds":
            step = f"({days} * 86400 + CAST(extract(HOUR FROM {b.sql}) AS INT) * 3600 + CAST(extract(MINUTE FROM {b.sql}) AS INT) * 60 + CAST(extract(SECOND FROM {b.sql}) AS INT))"
        elif whole:
            step = f"CAST({b.sql} AS BIGINT)"
        else:
            return None
        moved = f"CAST(pmod({seconds} {op} {step}, 86400) AS INT)"
        return Value(moved, TIME) if x == "time" else Value(f"(CASE WHEN {a.sql} IS NULL THEN NULL ELSE named_struct('secs', {moved}, 'offset_min', {a.sql}.offset_min) END)", a.type)
    if x == y and x in ("interval_ym", "interval_ds"):
        return Value(f"({a.sql} {op} {b.sql})", a.type)
    return None


def negate(v: Value) -> Value:
    if v.type.is_numeric or v.type.kind in ("interval_ym", "interval_ds", "null"):
        wide = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "uint64": "int128", "uint128": "int128"}.get(v.type.kind)
        return Value(_opposite(v.sql, v.type), Type(wide) if wide else v.type)
    raise ValidationError(f"no operator -{v.type.ddl()}")


def comparable(a: Value, b: Value) -> tuple[str, str]:
    """Both sides as Spark should compare them: collated texts, stripped binaries."""
    rule = a.type.comparison or b.type.comparison
    if rule and (a.type.is_text or a.type.kind == "null") and (b.type.is_text or b.type.kind == "null"):
        return f"({a.sql}) COLLATE {rule}", f"({b.sql}) COLLATE {rule}"
    if a.type.is_blob and b.type.is_blob and "binary" in (a.type.kind, b.type.kind):
        return tuple(f"regexp_replace(hex({v.sql}), '(00)+$', '')" for v in (a, b))
    if a.type.is_blob and b.type.is_text:
        return a.sql, f"CAST({b.sql} AS BINARY)"
    if b.type.is_blob and a.type.is_text:
        return f"CAST({a.sql} AS BINARY)", b.sql
    for v, w in ((a, b), (b, a)):
        if v.type.kind == "time" and w.type.is_text:
            return (a.sql, to_time(b)) if v is a else (to_time(a), b.sql)
        if v.type.kind == "timetz" and w.type.is_text:
            return (a.sql, cast_to(b, a.type).sql) if v is a else (cast_to(a, b.type).sql, b.sql)
    return a.sql, b.sql


def compare(op: str, a: Value, b: Value) -> Value:
    x, y = comparable(a, b)
    return Value(f"({x} {op} {y})", BOOLEAN)
