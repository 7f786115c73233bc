"""Queries, order and missing values on small tables."""

import datetime as dt
import math

import pytest

from chronoweave.errors import QueryError
from chronoweave.functions import bar, call, count, duration, len_, mean, prod, stddev, sum_, to_date, variance
from chronoweave.functions.expr import column
from chronoweave.operators import Frame
from chronoweave.types import BOOL, FLOAT, INT, STRING, TIMEDELTA, TIMESTAMP

NAN = float("nan")


@pytest.fixture(scope="module")
def t(spark):
    rows = [("b", 3, 1.5), ("a", None, 2.5), ("b", 1, NAN), ("c", 3, 0.5), ("a", 2, NAN)]
    return Frame.rows(spark, {"s": STRING, "n": INT, "f": FLOAT}, rows)


def test_groups_come_in_order_of_appearance(t):
    assert t.query({"n": len_(t.s)}, by=["s"]).collect() == [("b", 2), ("a", 2), ("c", 1)]
    assert t.reverse().query({"n": len_(t.s)}, by=["s"]).collect() == [("a", 2), ("c", 1), ("b", 2)]


def test_aggregates_skip_missing_values(t):
    got = t.query({"s1": sum_(t.f), "c": count(t.f), "l": len_(t.f), "m": mean(t.f), "v": variance(t.f), "p": prod(t.n), "all": sum_(t.s)}, by=["s"]).collect()
    assert got == [("b", 1.5, 1, 2, 1.5, 0.0, 3, "bb"), ("a", 2.5, 1, 2, 2.5, 0.0, 2, "aa"), ("c", 0.5, 1, 1, 0.5, 0.0, 3, "c")]


def test_aggregates_of_nothing(spark):
    t = Frame.rows(spark, {"f": FLOAT, "n": INT, "s": STRING}, [])
    assert t.evaluate(sum_(t.f)) == 0 and t.evaluate(prod(t.n)) == 1 and t.evaluate(sum_(t.s)) == ""
    assert all(math.isnan(t.evaluate(f(t.f))) for f in (mean, variance, stddev))


def test_sort_is_stable_with_missing_last(t):
    assert [r[1] for r in t.sort("n").collect()] == [1, 2, 3, 3, None]
    assert [r[0] for r in t.sort("n").collect()] == ["b", "a", "b", "c", "a"]
    assert [r[0] for r in t.sort("n").reverse().collect()] == ["a", "c", "b", "a", "b"]


def test_comparisons_with_missing_values_are_false(t):
    out = t.query({"lt": t.n < 3, "ne": t.n != 3, "not_": ~(t.n == 3), "fne": t.f != 1.5, "feq": t.f == t.f})
    assert out.collect()[1] == (False, False, True, True, True)
    assert out.collect()[2][3:] == (True, False)


def test_query_names_follow_the_first_argument(t):
    assert t.query([t.n + 1, t.f * 2.0]).columns == ["n", "f"]


def test_columns_named_like_methods(spark):
    t = Frame.rows(spark, {"count": INT, "order": INT}, [(1, 2)])
    assert t.query({"x": t["count"] + t["order"]}).collect() == [(3,)]


@pytest.mark.parametrize(
    "make,message",
    [
        (lambda t: t.query({"x": sum_(t.n)}), "must be an array"),
        (lambda t: t.query({"x": t.n}, by=["s"]), "must be a scalar"),
        (lambda t: t.query(by=["s"]), "needs columns"),
        (lambda t: t.where(t.n), "takes a Bool"),
        (lambda t: t.n + t.s, "takes no"),
        (lambda t: t.query([t.n, t.n]), "named n"),
        (lambda t: t["zz"], "no column"),
        (lambda t: call("nothing", t.n), "no function"),
    ],
)
def test_static_errors(t, make, message):
    with pytest.raises(QueryError, match=message):
        make(t)


def test_division(spark):
    t = Frame.rows(spark, {"a": INT, "b": INT, "x": FLOAT, "z": FLOAT}, [(-7, 2, 1.0, 0.0), (7, -2, -1.0, 0.0), (6, 3, 0.0, 0.0)])
    rows = t.query({"q": t.a / t.b, "r": t.a % t.b, "y": t.x / t.z}).collect()
    assert [r[:2] for r in rows] == [(-3, -1), (-3, 1), (2, 0)]
    assert rows[0][2] == math.inf and rows[1][2] == -math.inf and math.isnan(rows[2][2])


def test_bar_truncates_toward_zero(spark):
    ts = [dt.datetime(2020, 1, 1, 10, 7), dt.datetime(1969, 12, 31, 23, 57), None]
    t = Frame.rows(spark, {"t": TIMESTAMP}, [(x,) for x in ts])
    got = [r[0] for r in t.query({"b": bar(t.t, duration(5, "m"))}).collect()]
    assert got == [dt.datetime(2020, 1, 1, 10, 5), dt.datetime(1970, 1, 1), None]


def test_temporal_round_trips(spark):
    ts = dt.datetime(1965, 3, 4, 5, 6, 7, 89)
    t = Frame.rows(spark, {"t": TIMESTAMP, "s": STRING}, [(ts, "1 days 01:00:05")])
    out = t.query({"i": call("Timestamp", call("Int64", t.t)), "d": to_date(t.t), "td": call("Timedelta", t.s), "back": t.t + duration(3, "d") - duration(3, "d"), "txt": call("Timestamp", call("String", t.t))}).collect()[0]
    assert out[0] == ts and out[2] == dt.timedelta(days=1, hours=1, seconds=5) and out[3] == ts and out[4] == ts


def test_sub_microsecond_durations_raise(spark):
    t = Frame.rows(spark, {"n": INT}, [(1,)])
    assert t.query({"d": call("suffix_ns", t.n * 2000)}).collect() == [(dt.timedelta(microseconds=2),)]
    with pytest.raises(Exception, match="microsecond"):
        t.query({"d": call("suffix_ns", t.n)}).collect()


def test_bad_casts_are_missing(spark):
    t = Frame.rows(spark, {"s": STRING}, [("12",), ("12 ",), ("x",), ("",), ("99999999999999999999",)])
    assert [r[0] for r in t.query({"i": call("Int64", t.s)}).collect()] == [12, None, None, None, None]
    assert t.query({"b": t.s == "12"}).row == {"b": BOOL}


def test_filter_reaches_the_scan(spark, sf_dir):
    from chronoweave.sources import parquet

    t = parquet(spark, f"{sf_dir}/lineitem.parquet")
    df = t.query({"p": t.l_extendedprice}, where=t.l_quantity > 30.0).to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[1]
    assert "PushedFilters" in plan


def test_durations_are_nanoseconds(spark):
    t = Frame.rows(spark, {"n": INT, "d": TIMEDELTA}, [(3000, dt.timedelta(seconds=2)), (None, None)])
    got = t.query({"a": t.d * call("Timedelta", t.n), "b": call("Int64", t.d / call("Timedelta", t.n)), "c": call("String", call("Timedelta", t.n + 1)), "e": call("Timestamp", t.n)}).collect()
    assert got == [(dt.timedelta(microseconds=6_000_000_000), 666_666, "00:00:00.000003001", dt.datetime(1970, 1, 1, 0, 0, 0, 3)), (None, None, "", None)]
    for bad in (call("Timedelta", t.n + 1), call("Timestamp", t.n + 1), call("Time", t.n + 1)):  # none is cut without an error
        with pytest.raises(Exception, match="microsecond"):
            t.query({"x": bad}).collect()
    with pytest.raises(Exception, match="microsecond"):
        Frame.rows(spark, {"s": STRING}, [("2020-01-01 10:00:00.123456789",)]).query({"x": call("Timestamp", column("s", STRING))}).collect()
    assert Frame.of(t.to_df()).collect() == t.collect()  # out as intervals, and in again
