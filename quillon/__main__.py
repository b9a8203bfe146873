"""A shell: `python -m quillon [--sources DIR] [PATH] [STATEMENTS]`; without statements, they are read line by line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, script_is_complete
from .operators.render import ascii_table


def show(engine: Engine, text: str) -> None:
    for out in engine.script(text):
        if isinstance(out, DataFrame):
            print(ascii_table(out.columns, [tuple(r) for r in out.collect()]))
        else:
            print(f"{out} row(s) affected")


def main(argv: list[str]) -> int:
    options = argparse.ArgumentParser(prog="quillon")
    options.add_argument("--sources", help="directory of read-only Parquet tables")
    options.add_argument("path", nargs="?", help="directory of the engine's own tables; in memory if left out")
    options.add_argument("statements", nargs="?")
    given = options.parse_args(argv)
    spark = SparkSession.builder.appName("quillon").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, given.path, given.sources)
    if given.statements:
        show(engine, given.statements)
        return 0
    held = ""
    while True:
        try:
            held += input("... " if held else "quillon> ") + "\n"
        except EOFError:
            return 0
        if held.strip() and script_is_complete(held):
            try:
                show(engine, held)
            except Exception as error:  # the shell goes on after any statement's error
                print(f"{type(error).__name__}: {error}", file=sys.stderr)
            held = ""


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
