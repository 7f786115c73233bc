"""Timestamps, dates, times of day in microseconds; durations in nanoseconds.

Arithmetic goes through counts, so that quotients truncate toward zero on both sides of
1970.  A moment has no part of a microsecond: a result that would need one raises, as does
a Date moved by less than a day.  Products and quotients with a duration are those of the
raw nanoseconds, and keep the temporal type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DATE, INT, TEMPORAL, TIME, TIMEDELTA, TIMELIKE, TIMESTAMP, Type
from .expr import overload

DAY_US = 86_400_000_000
#: Nanoseconds of a duration suffix.
UNITS = {"ns": 1, "us": 1000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def exact_us(ns: Column) -> Column:
    """Microseconds of nanoseconds that are whole ones."""
    return F.when(ns % 1000 != 0, F.raise_error(F.lit("a moment has no part of a microsecond")).cast("long")).otherwise(_div(ns, F.lit(1000)))


def micros(c: Column, t: Type) -> Column:
    """Microseconds since the epoch or of the day."""
    if t is TIME:
        return c
    return F.unix_date(c).cast("long") * DAY_US if t is DATE else F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c)


def from_micros(us: Column, t: Type) -> Column:
    """The moment of a type for so many microseconds."""
    if t is TIME:
        return us
    if t is DATE:
        return F.date_from_unix_date(_div(us, F.lit(DAY_US)).cast("int"))
    return F.expr(_EPOCH) + F.make_dt_interval(_div(us, F.lit(DAY_US)).cast("int"), F.lit(0), F.lit(0), ((us % DAY_US).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def _date_only(us: Column, t: Type) -> Column:
    if t is DATE:
        return F.when(us % DAY_US != 0, F.raise_error(F.lit("a Date moved by part of a day has no value; use a Timestamp")).cast("long")).otherwise(us)
    return us


def _moved(sign: int, t: Type, first: bool = True):
    def build(a: Column, b: Column) -> Column:
        x, d = (a, b) if first else (b, a)
        return from_micros(_date_only(micros(x, t) + exact_us(d) * sign, t), t)

    return build


for _t in TIMELIKE:
    overload("-", (_t, _t), TIMEDELTA, lambda a, b, t=_t: (micros(a, t) - micros(b, t)) * 1000)
    overload("+", (TIMEDELTA, _t), _t, _moved(1, _t, False))
    overload("+", (_t, TIMEDELTA), _t, _moved(1, _t))
    overload("-", (_t, TIMEDELTA), _t, _moved(-1, _t))
    overload("bar", (_t, TIMEDELTA), _t, lambda a, b, t=_t: from_micros(_date_only(_div(micros(a, t), exact_us(b)) * exact_us(b), t), t))
    overload("*", (_t, TIMEDELTA), _t, lambda a, b, t=_t: from_micros(micros(a, t) * b, t))
    overload("*", (TIMEDELTA, _t), _t, lambda a, b, t=_t: from_micros(micros(b, t) * a, t))
    overload("/", (_t, TIMEDELTA), _t, lambda a, b, t=_t: from_micros(exact_us(_div(micros(a, t) * 1000, b)), t))
for _op, _f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("/", _div), ("bar", lambda a, b: _div(a, b) * b)):
    overload(_op, (TIMEDELTA, TIMEDELTA), TIMEDELTA, _f)
overload("+", (DATE, TIME), TIMESTAMP, lambda a, b: from_micros(micros(a, DATE) + b, TIMESTAMP))
overload("-", (TIMEDELTA,), TIMEDELTA, lambda a: -a)
for _unit, _ns in UNITS.items():
    overload(f"suffix_{_unit}", (INT,), TIMEDELTA, lambda a, n=_ns: a * n)

#: Accepted layouts of dates, times, and both; a fraction of up to nine digits may follow.
_DATE_RE = r"(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8})"
_TIME_RE = r"(\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)"
#: The layout in which moments are stored, which a cast reads alike.
_STORED_RE = r"^(?!0000)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?\z"


def _day(text: Column) -> Column:
    """Date of the leading date of a text."""
    plain = F.regexp_replace(F.regexp_extract(text, f"^{_DATE_RE}", 1), "[-/]", "")
    return F.try_to_timestamp(F.when(plain != "", plain), F.lit("yyyyMMdd")).cast("date")


def _of_day(clock: Column) -> Column:
    """Nanoseconds of the day of ``HH:MM[:SS[.f]]``."""
    part = lambda k: F.try_element_at(F.split(clock, "[:.]"), F.lit(k))
    fraction = F.rpad(F.coalesce(part(4), F.lit("")), 9, "0").try_cast("long")
    h, m, s = part(1).try_cast("long"), part(2).try_cast("long"), F.coalesce(part(3), F.lit("0")).try_cast("long")
    return F.when((h < 24) & (m < 60) & (s < 60), h * UNITS["h"] + m * UNITS["m"] + s * UNITS["s"] + F.coalesce(fraction, F.lit(0)))


def parse_time(text: Column) -> Column:
    stamp = F.when(text.rlike(f"^{_TIME_RE}$"), text).when(text.rlike(f"^{_DATE_RE}[ T]{_TIME_RE}$") & _day(text).isNotNull(), F.regexp_extract(text, f"{_TIME_RE}$", 1))
    return exact_us(_of_day(stamp))


def parse_date(text: Column) -> Column:
    return F.when(text.rlike(f"^{_DATE_RE}([ T]{_TIME_RE})?$"), _day(text))


def parse_timestamp(text: Column) -> Column:
    """Date, time (of 1970-01-01) or both."""
    both = text.rlike(f"^{_DATE_RE}[ T]{_TIME_RE}$")
    clock = F.when(both | text.rlike(f"^{_TIME_RE}$"), _of_day(F.regexp_extract(text, f"{_TIME_RE}$", 1))).when(text.rlike(f"^{_DATE_RE}$"), F.lit(0))
    day = F.when(text.rlike(f"^{_TIME_RE}$"), F.lit(0)).otherwise(F.unix_date(_day(text)))
    found = from_micros(day.cast("long") * DAY_US + exact_us(clock), TIMESTAMP)
    return F.when(text.rlike(_STORED_RE), text.try_cast("timestamp_ntz")).otherwise(found)


def parse_timedelta(text: Column) -> Column:
    """``[-][N day[s] ]HH:MM:SS[.f]`` or ``N day[s]``."""
    days = F.coalesce(F.regexp_extract(text, r"^-?(\d+) days?", 1).try_cast("long"), F.lit(0))
    clock = F.regexp_extract(text, f"{_TIME_RE}$", 1)
    ns = days * UNITS["d"] + F.coalesce(_of_day(F.when(clock != "", clock)), F.lit(0))
    shape = rf"^-?(\d+ days?|(\d+ days? )?{_TIME_RE})$"
    return F.when(text.rlike(shape), F.when(text.startswith("-"), -ns).otherwise(ns))


def _clock(ns: Column) -> Column:
    """HH:MM:SS of 0 to a day, with six digits of a fraction where there is one, or nine."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hms = F.concat(two(_div(ns, F.lit(UNITS["h"]))), F.lit(":"), two(_div(ns, F.lit(UNITS["m"])) % 60), F.lit(":"), two(_div(ns, F.lit(UNITS["s"])) % 60))
    part = ns % UNITS["s"]
    digits = F.when(part % 1000 == 0, F.lpad(_div(part, F.lit(1000)).cast("string"), 6, "0")).otherwise(F.lpad(part.cast("string"), 9, "0"))
    return F.when(part == 0, hms).otherwise(F.concat(hms, F.lit("."), digits))


def time_text(c: Column) -> Column:
    return _clock(c * 1000)


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def timestamp_text(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(" "), _clock(F.pmod(micros(c, TIMESTAMP), F.lit(DAY_US)) * 1000))


def timedelta_text(ns: Column) -> Column:
    days = _div(F.abs(ns), F.lit(UNITS["d"]))
    rest = F.abs(ns) % UNITS["d"]
    shown = F.when(days == 0, _clock(rest)).when(rest == 0, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.concat(days.cast("string"), F.lit(" days "), _clock(rest)))
    return F.concat(F.when(ns < 0, "-").otherwise(""), shown)
