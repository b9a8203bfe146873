"""Results as text."""

from __future__ import annotations


def cell(value) -> str:
    """One value: booleans in lower case, bytes as 0x and lower hex, line breaks escaped."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, bytes | bytearray):
        return f"0x{value.hex()}"
    return str(value).replace("\n", "\\n").replace("\r", "\\r")


def ascii_table(columns: list[str], rows: list[tuple]) -> str:
    """A framed table and its row count, as a shell shows results."""
    cells = [[cell(v) for v in row] for row in rows]
    widths = [max([len(name), *(len(row[i]) for row in cells)]) for i, name in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda values: "| " + " | ".join(v.ljust(w) for v, w in zip(values, widths)) + " |"
    return "\n".join([rule, line(columns), rule, *map(line, cells), *([rule] if cells else []), f"{len(cells)} row(s)"])
