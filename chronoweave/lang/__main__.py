"""``python -m chronoweave.lang [FILE [ARG...]]``: run a program, or read one line by line."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from ..errors import QueryError
from .interpreter import Session


def prompt(session: Session) -> None:
    """A read-eval-print loop: \\t times an expression, \\l lists names, \\help says so, \\multiline reads up to an empty line."""
    while True:
        try:
            line = input(">>> ")
        except EOFError:
            return
        if line.startswith("\\help"):
            print(prompt.__doc__)
            continue
        if line.startswith("\\l"):
            print("\n".join(sorted(n for n, v in session.top.names.items() if not hasattr(v, "run"))))
            continue
        if line.startswith("\\multiline"):
            lines = []
            while s := input("... "):
                lines.append(s)
            line = "\n".join(lines)
        timed = line.startswith("\\t ")
        began = time.perf_counter()
        try:
            session.run(line[3:] if timed else line, echo=True)
        except QueryError as e:
            print(f"Error: {e}")
        if timed:
            print(f"{(time.perf_counter() - began) * 1000:.0f}ms")


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("chronoweave").getOrCreate()
    session = Session(spark, args)
    if args:
        with open(args[0], encoding="utf-8") as f:
            session.run(f.read())
    else:
        prompt(session)


if __name__ == "__main__":
    main(sys.argv[1:])
