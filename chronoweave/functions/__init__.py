"""Typed expressions and the functions over them."""

from __future__ import annotations

from . import aggregates, scalar, temporal  # noqa: F401  they fill the overload table
from .aggregates import wavg
from .expr import Expr, call, column, compiled, functions, has_aggregate, literal, nil, overloads


def _named(name: str):
    def f(*args: object) -> Expr:
        return call(name, *args)

    f.__name__ = name
    f.__doc__ = f"The overload of ``{name}`` for the arguments' types."
    return f


sin, cos, tan, asin, acos, atan = map(_named, ("sin", "cos", "tan", "asin", "acos", "atan"))
sinh, cosh, tanh, asinh, acosh, atanh = map(_named, ("sinh", "cosh", "tanh", "asinh", "acosh", "atanh"))
sum_, prod, count, len_, mean, variance, stddev = map(_named, ("sum", "prod", "count", "len", "mean", "variance", "stddev"))
bar, reverse, and_, or_, not_ = map(_named, ("bar", "reverse", "and", "or", "not"))
to_string, to_int, to_float, to_char, to_bool = map(_named, ("String", "Int64", "Float64", "Char", "Bool"))
to_timestamp, to_timedelta, to_time, to_date = map(_named, ("Timestamp", "Timedelta", "Time", "Date"))


def duration(n: int, unit: str) -> Expr:
    """A Timedelta of ``n`` units: ns, us, ms, s, m, h or d."""
    return call(f"suffix_{unit}", n)


def now() -> Expr:
    """The current UTC time."""
    import datetime as dt

    return literal(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
