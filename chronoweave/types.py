"""The nine value types and row types of the typed facade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    name: str
    spark: T.DataType

    def __str__(self) -> str:
        return self.name


INT = Type("Int64", T.LongType())
FLOAT = Type("Float64", T.DoubleType())
BOOL = Type("Bool", T.BooleanType())
STRING = Type("String", T.StringType())
CHAR = Type("Char", T.StringType())
TIMESTAMP = Type("Timestamp", T.TimestampNTZType())
TIMEDELTA = Type("Timedelta", T.LongType())  # nanoseconds; an interval where a table is given out
TIME = Type("Time", T.LongType())  # microseconds of the day
DATE = Type("Date", T.DateType())

TYPES = {t.name: t for t in (INT, FLOAT, BOOL, STRING, CHAR, TIMESTAMP, TIMEDELTA, TIME, DATE)}
NUMERIC, TIMELIKE = (INT, FLOAT), (TIMESTAMP, TIME, DATE)
TEMPORAL = (*TIMELIKE, TIMEDELTA)
#: Types whose values can be subtracted from each other.
SUBTRACTABLE = (*NUMERIC, *TEMPORAL)

#: A row type: member names with their types, in order.
Row = dict[str, Type]


def difference(t: Type) -> Type:
    """Type of the difference of two values."""
    return t if t in NUMERIC else TIMEDELTA


def from_spark(t: T.DataType) -> Type | None:
    """Facade type of a Spark column; None for one that only passes through."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return TIMESTAMP
    for own in (BOOL, STRING, DATE):
        if isinstance(t, type(own.spark)):
            return own
    return TIMEDELTA if isinstance(t, T.DayTimeIntervalType) else None


def row_text(row: Row) -> str:
    return "{" + ", ".join(f"{n}: {t}" for n, t in row.items()) + "}"
