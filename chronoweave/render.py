"""Text of values and tables, as the language front end shows them."""

from __future__ import annotations

import datetime as dt
import math
import shutil
from typing import TYPE_CHECKING

from .functions.expr import nanos
from .types import BOOL, CHAR, DATE, FLOAT, TIME, TIMEDELTA, TIMESTAMP, Type

if TYPE_CHECKING:
    from .operators.frame import Frame

#: Items that an array shows.
ARRAY_ITEMS = 25


def float_digits(x: float) -> str:
    """Six decimals without the zeros at the end; one stays."""
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    whole, _, part = f"{x:.6f}".partition(".")
    return f"{whole}.{part.rstrip('0') or '0'}"


def _clock(us: int, ns: int = 0) -> str:
    s, us = divmod(us, 1_000_000)
    out = f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    return f"{out}.{us:06d}{ns:03d}" if ns else f"{out}.{us:06d}" if us else out


def _delta(x: dt.timedelta | int) -> str:
    x = nanos(x)
    days, rest = divmod(abs(x), 86_400_000_000_000)
    clock = _clock(*divmod(rest, 1000))
    out = clock if not days else f"{days} days" if not rest else f"{days} days {clock}"
    return f"-{out}" if x < 0 else out


def text(x: object, t: Type) -> str:
    """A value as ``print`` shows it; a missing one is empty, but for nan."""
    if x is None:
        return ""
    if t is FLOAT:
        return float_digits(x)
    if t is BOOL:
        return "true" if x else "false"
    if t is TIMESTAMP:
        return f"{x:%Y-%m-%d} {_clock((x - dt.datetime.combine(x, dt.time())) // dt.timedelta(microseconds=1))}"
    return {TIMEDELTA: _delta, TIME: _clock, DATE: str}.get(t, str)(x)


def shown(x: object, t: Type) -> str:
    """A value as the prompt shows it."""
    if x is None:
        return "nil"
    if t.name == "String":
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if t is CHAR:
        return f"'{x}'"
    if t in (TIMESTAMP, TIMEDELTA, TIME, DATE):
        return f'{t}("{text(x, t)}")'
    return text(x, t)


def array_text(xs: list, t: Type, quoted: bool = True) -> str:
    one = shown if quoted else text
    more = ", ..." if len(xs) > ARRAY_ITEMS else ""
    return "[" + ", ".join(one(x, t) for x in xs[:ARRAY_ITEMS]) + more + "]"


def _column(xs: list, t: Type) -> list[str]:
    if t is not FLOAT:
        return [text(x, t) for x in xs]
    out = [float_digits(x) if x is not None and not math.isnan(x) else "" for x in xs]
    places = max([1, *(len(s.partition(".")[2]) for s in out if "." in s)])
    return [s + "0" * (places - len(s.partition(".")[2])) if "." in s else s for s in out]


def table_text(row: dict[str, Type], rows: list[tuple], more: bool = False) -> str:
    """Columns aligned right under their names; decimals of a column share their places."""
    cells = [[n, *_column([r[i] for r in rows], t)] for i, (n, t) in enumerate(row.items())]
    if more:
        for c in cells:
            c.append("...")
    width = [max(map(len, c)) for c in cells]
    return "\n".join(" " + " ".join(x.rjust(w) for x, w in zip(line, width)) for line in zip(*cells))


def frame_text(frame: Frame, limit: int | None = None) -> str:
    """The head of a frame that fits the terminal; reads no more rows than it shows, and one."""
    limit = limit or max(4, shutil.get_terminal_size((80, 40)).lines - 4)
    rows = [tuple(r) for r in frame.kept(ordered=True).limit(limit + 1).collect()]
    return table_text(frame.row, rows[:limit], len(rows) > limit)
