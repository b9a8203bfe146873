"""Tokens of the dialect: upper-case keywords, backtick names, no comments and no exponents."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

KEYWORDS = frozenset(
    """ADD AFTER ALL ALTER AND AS ASC AUTO_INCREMENT BEGIN BETWEEN BTREE BY CASCADE CASE CAST CHARACTER CHECK COLLATE COLUMN COMMIT CONSTRAINT CREATE DAY DEFAULT DELETE DESC DESCRIBE DISTINCT DROP
    DUPLICATE ELSE END EXCEPT EXISTS EXPLAIN FALSE FOREIGN FROM FULL GROUP HAVING IF IN INDEX INDEXES INNER INSERT INTERSECT INTERVAL INTO IS JOIN KEY LEFT LIKE LIMIT MONTH NOT NULL OFFSET ON OR ORDER
    OUTER OVER PARTITION PRIMARY RECURSIVE REFERENCES RELEASE RENAME RESTRICT RIGHT ROLLBACK SAVEPOINT SECOND SELECT SET SHOW TABLE TABLES THEN TO TRANSACTION TRIGGER TRIGGERS TRUE UNION UNIQUE UPDATE
    USING VALUES VIEW VIEWS WHEN WHERE WITH YEAR""".split()
)
#: Keywords that are ordinary names (of functions or columns) where no clause begins.
SOFT = frozenset("BTREE DAY INDEX KEY LEFT MONTH RIGHT SECOND SET TABLES TRIGGERS VIEWS YEAR INDEXES TRANSACTION IF ADD TO END BEGIN".split())

_TOKEN = re.compile(
    r"""\s+|(?P<blob>[Xx]'(?P<hex>[^']*)')|(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<quoted>`[^`]*`)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark><=|>=|!=|<>|[-+*/%=<>(),.;?])""",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, text, blob, number, mark, end
    value: str
    start: int
    stop: int


def _unescape(body: str) -> str:
    return re.sub(r"''|\\(.)", lambda m: m[1] if m[1] else "'", body, flags=re.S)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}" if sql[at] not in "'`" else f"unterminated quote at {at}")
        if m["blob"]:
            if len(m["hex"]) % 2 or not re.fullmatch("[0-9A-Fa-f]*", m["hex"]):
                raise ParseError(f"bad hexadecimal literal at {at}")
            out.append(Token("blob", m["hex"].upper(), at, m.end()))
        elif m["text"]:
            out.append(Token("text", _unescape(m["text"][1:-1]), at, m.end()))
        elif m["quoted"]:
            out.append(Token("name", m["quoted"][1:-1], at, m.end()))
        elif m["number"]:
            out.append(Token("number", m["number"], at, m.end()))
        elif m["name"]:
            word = m["name"]
            if word in KEYWORDS:
                out.append(Token("keyword", word, at, m.end()))
            else:
                out.append(Token("name", word, at, m.end()))
        elif m["mark"]:
            out.append(Token("mark", m["mark"], at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(sql), len(sql)))
    return out


def split_script(script: str) -> list[str]:
    """The statements of a script, each with its semicolon; a text's semicolons do not count."""
    out, start = [], 0
    for token in tokenize(script):
        if token.kind == "mark" and token.value == ";":
            out.append(script[start : token.stop].strip())
            start = token.stop
    if script[start:].strip():
        out.append(script[start:].strip())
    return out


def script_is_complete(script: str) -> bool:
    """Whether a shell may run what was typed: quotes closed, and the last statement ended."""
    try:
        tokens = tokenize(script)
    except ParseError:
        return False
    return len(tokens) == 1 or tokens[-2].value == ";" and tokens[-2].kind == "mark"
