"""Typed expression nodes, compiled to Columns when a query needs them.

A node knows its type, whether it stands for a whole column (an array) or one value, and
the name that a column made of it takes: that of its first argument.  Aggregates inside
the argument of another aggregate become window values over the same keys.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..types import BOOL, CHAR, DATE, FLOAT, INT, STRING, TIMEDELTA, TIMESTAMP, Type
from .nil import NAN


@dataclass(eq=False)
class Expr:
    type: Type
    build: Callable[..., Column]
    args: tuple[Expr, ...] = ()
    array: bool = False
    name: str | None = None
    aggregate: bool = False
    ordered: bool = False  # an aggregate that needs the rows' order: build(col, order)
    value: object = field(default=None, repr=False)  # of a literal

    def __post_init__(self):
        if self.name is None and self.args:
            self.name = self.args[0].name

    # arithmetic and comparison go through the overload table
    def __add__(self, o): return call("+", self, o)
    def __radd__(self, o): return call("+", o, self)
    def __sub__(self, o): return call("-", self, o)
    def __rsub__(self, o): return call("-", o, self)
    def __mul__(self, o): return call("*", self, o)
    def __rmul__(self, o): return call("*", o, self)
    def __truediv__(self, o): return call("/", self, o)
    def __rtruediv__(self, o): return call("/", o, self)
    def __mod__(self, o): return call("%", self, o)
    def __rmod__(self, o): return call("%", o, self)
    def __lshift__(self, o): return call("<<", self, o)
    def __rshift__(self, o): return call(">>", self, o)
    def __and__(self, o): return call("&", self, o)
    def __rand__(self, o): return call("&", o, self)
    def __or__(self, o): return call("|", self, o)
    def __ror__(self, o): return call("|", o, self)
    def __invert__(self): return call("not", self)
    def __neg__(self): return call("-", self)
    def __pos__(self): return call("+", self)
    def __lt__(self, o): return call("<", self, o)
    def __gt__(self, o): return call(">", self, o)
    def __le__(self, o): return call("<=", self, o)
    def __ge__(self, o): return call(">=", self, o)
    def __eq__(self, o): return call("==", self, o)
    def __ne__(self, o): return call("!=", self, o)
    __hash__ = object.__hash__


def column(name: str, t: Type) -> Expr:
    quoted = "`" + name.replace("`", "``") + "`"
    return Expr(t, lambda: F.col(quoted), (), True, name)


#: Overloads: name to a list of (argument types, result type, builder, flags).
_TABLE: dict[str, list[tuple[tuple[Type, ...], Type, Callable, dict]]] = {}


def overload(name: str, args: tuple[Type, ...], result: Type, build: Callable, **flags) -> None:
    _TABLE.setdefault(name, []).append((args, result, build, flags))


def overloads(name: str) -> list[tuple[tuple[Type, ...], Type]]:
    return [(a, r) for a, r, _, _ in _TABLE.get(name, [])]


def functions() -> list[str]:
    return sorted(_TABLE)


def nanos(value: object) -> object:
    """A Python duration in nanoseconds, the form in which a Timedelta is kept."""
    return value // dt.timedelta(microseconds=1) * 1000 if isinstance(value, dt.timedelta) else value


def literal(value: object, t: Type | None = None) -> Expr:
    """A Python value as a typed scalar."""
    if isinstance(value, Expr):
        return value
    if t is None:
        if isinstance(value, bool):
            t = BOOL
        elif isinstance(value, int):
            t = INT
        elif isinstance(value, float):
            t = FLOAT
        elif isinstance(value, str):
            t = STRING
        elif isinstance(value, dt.datetime):
            t = TIMESTAMP
        elif isinstance(value, dt.timedelta):
            t = TIMEDELTA
        elif isinstance(value, dt.date):
            t = DATE
        else:
            raise QueryError(f"no type for a {type(value).__name__}")
    if t is CHAR and value is not None and len(value) > 1:
        raise QueryError(f"a Char holds one character, not {value!r}")

    def build() -> Column:
        if value is None:
            return F.lit(NAN if t is FLOAT else None).cast(t.spark)
        return F.lit(nanos(value) if t is TIMEDELTA else value).cast(t.spark)

    return Expr(t, build, value=value)


def nil(t: Type) -> Expr:
    """The missing value of a type."""
    return literal({FLOAT: math.nan, STRING: "", BOOL: False}.get(t), t)


def call(name: str, *args: object, **named: object) -> Expr:
    """Apply the overload of ``name`` that fits the argument types."""
    nodes = tuple(literal(a) for a in (*args, *named.values()))
    types = tuple(n.type for n in nodes)
    for want, result, build, flags in _TABLE.get(name, []):
        if want == types:
            if flags.get("aggregate") and not nodes[0].array:
                continue
            array = not flags.get("aggregate") and any(n.array for n in nodes)
            return Expr(result, build, nodes, array, aggregate=flags.get("aggregate", False), ordered=flags.get("ordered", False))
    if name not in _TABLE:
        raise QueryError(f"no function is named {name}")
    shown = ", ".join(str(t) if not n.array else f"[{t}]" for t, n in zip(types, nodes))
    known = "; ".join("(" + ", ".join(map(str, a)) + f") -> {r}" for a, r in overloads(name)[:3])
    more = len(_TABLE[name]) - 3
    raise QueryError(f"{name} takes no ({shown}); it takes {known}" + (f" and {more} others" if more > 0 else ""))


def has_aggregate(e: Expr) -> bool:
    return e.aggregate or any(map(has_aggregate, e.args))


def compiled(e: Expr, order: Column | None = None, nested: Callable[[Expr], Column] | None = None) -> Column:
    """The Column of a node.

    ``order`` sorts rows for ordered aggregates; ``nested`` gives a Column for an
    aggregate that stands inside the argument of another.
    """
    if e.aggregate:
        inner = tuple(_inner(a, nested) for a in e.args)
        if e.ordered:
            if order is None:
                raise QueryError("this aggregate needs rows with an order")
            return e.build(*inner, order)
        return e.build(*inner)
    return e.build(*(compiled(a, order, nested) for a in e.args))


def _inner(e: Expr, nested) -> Column:
    if e.aggregate:
        if nested is None:
            raise QueryError("an aggregate inside another needs a query with by")
        return nested(e)
    return e.build(*(_inner(a, nested) for a in e.args))
