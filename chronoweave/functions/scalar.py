"""Arithmetic, comparison, text, mathematics and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, CHAR, DATE, FLOAT, INT, STRING, TIME, TIMEDELTA, TIMESTAMP, TYPES
from .expr import overload
from .nil import NAN, compared
from .temporal import DAY_US, date_text, exact_us, from_micros, micros, parse_date, parse_time, parse_timedelta, parse_timestamp, time_text, timedelta_text, timestamp_text


def _real(c: Column, t) -> Column:
    """Float64 of a number; a missing Int64 is NaN."""
    return F.coalesce(c.cast("double"), F.lit(NAN)) if t is INT else c


def _divided(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN instead of an error."""
    sign = F.signum(a) * F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(sign * float("inf"))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


for _op, _f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b)):
    overload(_op, (INT, INT), INT, _f)
    for _x, _y in ((FLOAT, FLOAT), (INT, FLOAT), (FLOAT, INT)):
        overload(_op, (_x, _y), FLOAT, lambda a, b, f=_f, x=_x, y=_y: f(_real(a, x), _real(b, y)))


def _whole(a: Column, b: Column) -> Column:
    """Quotient of integers, toward zero."""
    return F.call_function("div", a, b)


overload("/", (INT, INT), INT, _whole)
for _x, _y in ((FLOAT, FLOAT), (INT, FLOAT), (FLOAT, INT)):
    overload("/", (_x, _y), FLOAT, lambda a, b, x=_x, y=_y: _divided(_real(a, x), _real(b, y)))
overload("%", (INT, INT), INT, lambda a, b: a % b)
overload("&", (INT, INT), INT, lambda a, b: a.bitwiseAND(b))
overload("|", (INT, INT), INT, lambda a, b: a.bitwiseOR(b))
overload("<<", (INT, INT), INT, lambda a, b: F.call_function("shiftleft", a, b.cast("int")))
overload(">>", (INT, INT), INT, lambda a, b: F.call_function("shiftright", a, b.cast("int")))
for _t in (INT, FLOAT):
    overload("-", (_t,), _t, lambda a: -a)
    overload("+", (_t,), _t, lambda a: a)
overload("and", (BOOL, BOOL), BOOL, lambda a, b: a & b)
overload("or", (BOOL, BOOL), BOOL, lambda a, b: a | b)
overload("&", (BOOL, BOOL), BOOL, lambda a, b: a & b)
overload("|", (BOOL, BOOL), BOOL, lambda a, b: a | b)
overload("not", (BOOL,), BOOL, lambda a: ~a)
for _t in TYPES.values():
    for _op in ("<", ">", "==", "!=", "<=", ">="):
        overload(_op, (_t, _t), BOOL, lambda a, b, op=_op, t=_t: compared(op, a, b, t))

for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"):
    overload(_name, (FLOAT,), FLOAT, getattr(F, _name))

overload("+", (STRING, STRING), STRING, lambda a, b: F.concat(a, b))
overload("len", (STRING,), INT, lambda a: F.octet_length(a).cast("long"))
overload("reverse", (STRING,), STRING, F.reverse)


def float_text(c: Column) -> Column:
    """Six decimals without the zeros at the end; at least one stays."""
    shown = F.regexp_replace(F.format_string("%.6f", c), r"(\.\d+?)0+$", "$1")
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(shown)


def int_of(text: Column) -> Column:
    """Whole text as an integer, else missing."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def float_of(text: Column) -> Column:
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    named = F.when(F.lower(text).rlike(r"^[+-]?inf(inity)?$"), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    return F.coalesce(number, named, F.lit(NAN))


def text_of(c: Column, t) -> Column:
    """Text of a value; a missing one is empty."""
    made = {
        INT: lambda: c.cast("string"),
        FLOAT: lambda: F.when(F.isnan(c), "").otherwise(float_text(c)),
        BOOL: lambda: c.cast("string"),
        STRING: lambda: c,
        CHAR: lambda: c,
        TIMESTAMP: lambda: timestamp_text(c),
        TIMEDELTA: lambda: timedelta_text(c),
        TIME: lambda: time_text(c),
        DATE: lambda: date_text(c),
    }[t]()
    return F.coalesce(made, F.lit(""))


def parsed(text: Column, t) -> Column:
    """A cell of text as a value of any type; what does not parse is missing."""
    return {
        INT: int_of,
        FLOAT: float_of,
        BOOL: lambda c: F.coalesce(c == "true", F.lit(False)),
        STRING: lambda c: F.coalesce(c, F.lit("")),
        CHAR: lambda c: F.when(F.length(c) == 1, c),
        TIMESTAMP: parse_timestamp,
        TIMEDELTA: parse_timedelta,
        TIME: parse_time,
        DATE: parse_date,
    }[t](text)


for _t in TYPES.values():
    overload("String", (_t,), STRING, lambda c, t=_t: text_of(c, t))
overload("Int64", (STRING,), INT, int_of)
overload("Int64", (INT,), INT, lambda c: c)
overload("Int64", (FLOAT,), INT, lambda c: F.when(~F.isnan(c), c.try_cast("long")))
overload("Int64", (BOOL,), INT, lambda c: c.cast("long"))
overload("Int64", (CHAR,), INT, lambda c: F.ascii(c).cast("long"))
for _t in (TIMESTAMP, TIME, DATE):
    overload("Int64", (_t,), INT, lambda c, t=_t: micros(c, t) * 1000)
    overload("Timestamp", (_t,), TIMESTAMP, lambda c, t=_t: from_micros(micros(c, t), TIMESTAMP))
overload("Int64", (TIMEDELTA,), INT, lambda c: c)
overload("Float64", (FLOAT,), FLOAT, lambda c: c)
overload("Float64", (INT,), FLOAT, lambda c: _real(c, INT))
overload("Float64", (STRING,), FLOAT, float_of)
overload("Char", (CHAR,), CHAR, lambda c: c)
overload("Char", (INT,), CHAR, lambda c: F.char(c))
overload("Bool", (BOOL,), BOOL, lambda c: c)
overload("Timestamp", (INT,), TIMESTAMP, lambda c: from_micros(exact_us(c), TIMESTAMP))
overload("Timestamp", (STRING,), TIMESTAMP, parse_timestamp)
overload("Timedelta", (TIMEDELTA,), TIMEDELTA, lambda c: c)
overload("Timedelta", (INT,), TIMEDELTA, lambda c: c)
overload("Timedelta", (STRING,), TIMEDELTA, parse_timedelta)
overload("Time", (TIMESTAMP,), TIME, lambda c: micros(c, TIMESTAMP) % DAY_US)
overload("Time", (TIME,), TIME, lambda c: c)
overload("Time", (INT,), TIME, exact_us)
overload("Time", (STRING,), TIME, parse_time)
overload("Date", (TIMESTAMP,), DATE, lambda c: from_micros(micros(c, TIMESTAMP), DATE))
overload("Date", (DATE,), DATE, lambda c: c)
overload("Date", (INT,), DATE, lambda c: from_micros(_whole(c, F.lit(1000)), DATE))
overload("Date", (STRING,), DATE, parse_date)
