"""Missing values: the one place where they are guarded.

A missing Float64 is NaN; a missing String is empty, a missing Bool false; others are
NULL.  A comparison with a missing value is false.  Aggregates skip missing values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DayTimeIntervalType

from ..types import BOOL, FLOAT, STRING, Type

NAN = float("nan")


def stored(col: Column, t: Type, source: DataType | None = None) -> Column:
    """A source column in the form that the facade keeps: cast, NULL as the type's missing value."""
    return interval_nanos(col) if isinstance(source, DayTimeIntervalType) else filled(col.cast(t.spark), t)


def interval_nanos(col: Column) -> Column:
    """Nanoseconds of a day-time interval, the form in which a Timedelta is kept."""
    part = lambda unit: F.date_part(F.lit(unit), col)
    seconds = (part("DAY").cast("long") * 24 + part("HOUR").cast("long")) * 3600 + part("MINUTE").cast("long") * 60
    return seconds * 1_000_000_000 + (part("SECOND") * 1_000_000).cast("long") * 1000


def nanos_interval(col: Column) -> Column:
    """The interval of so many nanoseconds; one below a microsecond has none, which is an error and not a truncation."""
    us = F.call_function("div", col, F.lit(1000))
    us = F.when(col % 1000 != 0, F.raise_error(F.lit("a duration below one microsecond has no interval")).cast("long")).otherwise(us)
    day = F.lit(86_400_000_000)
    return F.make_dt_interval(F.call_function("div", us, day).cast("int"), F.lit(0), F.lit(0), ((us % day).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def filled(col: Column, t: Type) -> Column:
    blank = {FLOAT: NAN, STRING: "", BOOL: False}
    return F.coalesce(col, F.lit(blank[t])) if t in blank else col


def skipped(col: Column, t: Type) -> Column:
    """NULL for a missing value, as aggregates want it."""
    return F.nanvl(col, F.lit(None).cast("double")) if t is FLOAT else col


def compared(op: str, a: Column, b: Column, t: Type) -> Column:
    out = {"<": a < b, ">": a > b, "==": a == b, "<=": a <= b, ">=": a >= b, "!=": a != b}[op]
    if t is FLOAT:  # IEEE order: NaN is unequal to all
        out = F.when(F.isnan(a) | F.isnan(b), F.lit(op == "!=")).otherwise(out)
    return F.coalesce(out, F.lit(False))
