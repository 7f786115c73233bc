"""Joins against brute force, with ties, missing keys and times, and unsorted input."""

import itertools
import random

import pytest

from chronoweave.errors import QueryError
from chronoweave.operators import Frame
from chronoweave.operators import joins
from chronoweave.types import CHAR, FLOAT, INT, STRING


def brute(left, right, strict, direction, within, keyed=True):
    """Rows (k, t, i) with the matched right row's value, by looking at every pair."""
    out = []
    for k, t, i in left:
        same = [r for r in right if (not keyed or r[0] == k) and r[1] is not None] if t is not None else []
        back = [r for r in same if r[1] < t or (r[1] == t and not strict)]
        ahead = [r for r in same if r[1] > t or (r[1] == t and not strict and direction == "forward")]
        b = max(enumerate(back), key=lambda x: (x[1][1], x[0]), default=(0, None))[1]
        a = min(enumerate(ahead), key=lambda x: (x[1][1], x[0]), default=(0, None))[1]
        r = {"backward": b, "forward": a}.get(direction)
        if direction == "nearest":
            r = b if a is None or (b is not None and t - b[1] <= a[1] - t) else a
        if r is not None and within is not None and abs(t - r[1]) > within:
            r = None
        out.append((k, t, i, r[2] if r else None))
    return out


def sides(spark, seed, keys=3, n=40):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, *range(keys)])
    time = lambda: rng.choice([None, *[rng.randint(0, 15)] * 6])
    left = [(key(), time(), i) for i in range(n)]
    right = [(key(), time(), 100 + i) for i in range(n)]
    return left, right, Frame.rows(spark, {"k": INT, "t": INT, "i": INT}, left), Frame.rows(spark, {"k": INT, "t": INT, "v": INT}, right)


@pytest.mark.parametrize("direction,strict,within", [c for c in itertools.product(("backward", "forward", "nearest"), (False, True), (None, 2)) if not (c[0] == "nearest" and c[1])])
@pytest.mark.parametrize("span", (2_000_000, 4))
def test_asof_with_keys(spark, monkeypatch, direction, strict, within, span):
    """Windows by key, and keys cut in time spans."""
    monkeypatch.setattr(joins, "SPAN_ROWS", span)
    left, right, lf, rf = sides(spark, 7)
    out = lf.join(rf, on=["k"], asof="t", strict=strict, direction=direction, within=within)
    assert out.columns == ["k", "t", "i", "v"]
    assert out.collect() == brute(left, right, strict, direction, within)


@pytest.mark.parametrize("direction", ("backward", "forward", "nearest"))
@pytest.mark.parametrize("span", (2_000_000, 9))
def test_asof_without_keys(spark, monkeypatch, direction, span):
    """One window, and several spans with rows carried between them."""
    monkeypatch.setattr(joins, "SPAN_ROWS", span)
    left, right, lf, rf = sides(spark, 3)
    right = [(k, t, v) for k, t, v in right if t is not None]
    out = lf.join(rf.query(["t", "v"]), asof="t", direction=direction).collect()
    assert out == brute(left, right, False, direction, None, keyed=False)


@pytest.mark.parametrize("direction,strict", (("forward", False), ("forward", True), ("nearest", False)))
def test_looking_ahead_is_one_running_pass(spark, direction, strict):
    """A frame that ends with the last row is gone over anew for each row: quadratic in a window's rows."""
    rng = random.Random(5)
    left = [(None, rng.randint(0, 900), i) for i in range(2000)]
    right = [(None, rng.randint(0, 900), 10_000 + i) for i in range(1000)]  # with ties
    lf = Frame.rows(spark, {"k": INT, "t": INT, "i": INT}, left)
    out = lf.join(Frame.rows(spark, {"t": INT, "v": INT}, [r[1:] for r in right]), asof="t", strict=strict, direction=direction)
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert out.collect() == brute(left, right, strict, direction, None, keyed=False)


def test_true_nearest_with_keys(spark):
    left = Frame.rows(spark, {"k": STRING, "t": INT}, [("A", 2), ("A", 10)])
    right = Frame.rows(spark, {"k": STRING, "t": INT, "v": INT}, [("B", 3, 1), ("A", 4, 2)])
    assert left.join(right, on=["k"], asof="t", direction="nearest").collect() == [("A", 2, 2), ("A", 10, 2)]


def test_lookup_fills_missing(spark):
    left = Frame.rows(spark, {"k": STRING, "n": INT}, [("b", 1), ("x", 2), ("a", 3)])
    right = Frame.rows(spark, {"k": STRING, "f": FLOAT, "s": STRING, "c": CHAR}, [("a", 1.5, "one", "q"), ("b", 2.5, "two", "r")])
    rows = left.join(right, on=["k"]).collect()
    assert rows[0] == ("b", 1, 2.5, "two", "r") and rows[2] == ("a", 3, 1.5, "one", "q")
    assert rows[1][:2] == ("x", 2) and rows[1][2] != rows[1][2] and rows[1][3:] == ("", None)


def test_lookup_missing_keys_match(spark):
    left = Frame.rows(spark, {"k": INT, "j": INT}, [(None, 1), (1, None), (2, 2)])
    right = Frame.rows(spark, {"k": INT, "j": INT, "v": INT}, [(None, 1, 10), (1, None, 20)])
    assert [r[2] for r in left.join(right, on=["k", "j"]).collect()] == [10, 20, None]


def test_lookup_needs_unique_keys(spark):
    left = Frame.rows(spark, {"k": INT}, [(1,)])
    right = Frame.rows(spark, {"k": INT, "v": INT}, [(1, 2), (1, 3)])
    with pytest.raises(Exception, match="more than once"):
        left.join(right, on=["k"]).collect()


def test_empty_tables(spark):
    left = Frame.rows(spark, {"k": INT, "t": INT}, [])
    right = Frame.rows(spark, {"k": INT, "t": INT, "v": INT}, [])
    one = Frame.rows(spark, {"k": INT, "t": INT}, [(1, 1)])
    assert left.join(right, on=["k"], asof="t").collect() == []
    assert one.join(right.query(["t", "v"]), asof="t").collect() == [(1, 1, None)]
    assert one.join(right, on=["k", "t"]).collect() == [(1, 1, None)]


def test_right_without_other_columns_gives_the_left(spark):
    left = Frame.rows(spark, {"k": INT, "n": INT}, [(1, 5), (2, 6)])
    assert left.join(Frame.rows(spark, {"k": INT}, [(1,)]), on=["k"]).collect() == [(1, 5), (2, 6)]


@pytest.mark.parametrize(
    "options,message",
    [
        ({}, "needs on or asof"),
        ({"on": ["k"], "strict": True}, "need asof"),
        ({"asof": "t", "direction": "nearest", "strict": True}, "can't be strict"),
        ({"asof": "t", "within": 1.0}, "within must be Int64"),
        ({"asof": "s", "direction": "nearest"}, "no distance"),
        ({"asof": ["t", "k"]}, "one expression"),
        ({"on": ["t"]}, "both tables have"),
    ],
)
def test_errors(spark, options, message):
    a = Frame.rows(spark, {"k": INT, "t": INT, "s": STRING}, [])
    b = Frame.rows(spark, {"k": INT, "t": INT, "s": STRING}, [])
    with pytest.raises(QueryError, match=message):
        a.join(b, **options)
