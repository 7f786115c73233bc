"""Aggregates.  All skip missing values but ``len``; they partially aggregate before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOAT, INT, NUMERIC, STRING, TYPES
from .expr import Expr, call, overload
from .nil import NAN, skipped


def _joined(c: Column, order: Column) -> Column:
    """Texts in row order; a group's texts meet in one place, as the result is one value."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("s"))))
    return F.array_join(F.transform(rows, lambda r: r["s"]), "")


def _int_product(c: Column) -> Column:
    """Integral product: zeros and signs are counted, and only factors beyond one are gathered.

    More than 63 of those overflow, which is an error; a group of valid result holds no more.
    """
    size = F.aggregate(F.collect_list(F.when(F.abs(c) > 1, F.abs(c))), F.lit(1).cast("long"), lambda a, b: a * b)
    sign = F.when(F.count_if(c < 0) % 2 == 1, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return F.when(F.count_if(c == 0) > 0, F.lit(0).cast("long")).otherwise(size * sign)


for _t in NUMERIC:
    overload("sum", (_t,), _t, lambda c, t=_t: F.coalesce(F.sum(skipped(c, t)), F.lit(0).cast(t.spark)), aggregate=True)
    for _n, _f in (("mean", F.avg), ("variance", F.var_pop), ("stddev", F.stddev_pop)):
        overload(_n, (_t,), FLOAT, lambda c, t=_t, f=_f: F.coalesce(f(skipped(c, t)), F.lit(NAN)), aggregate=True)
overload("prod", (FLOAT,), FLOAT, lambda c: F.coalesce(F.product(skipped(c, FLOAT)), F.lit(1.0)), aggregate=True)
overload("prod", (INT,), INT, _int_product, aggregate=True)
overload("sum", (STRING,), STRING, _joined, aggregate=True, ordered=True)
for _t in TYPES.values():
    overload("count", (_t,), INT, lambda c, t=_t: F.count(skipped(c, t)), aggregate=True)
    overload("len", (_t,), INT, lambda c: F.count(F.lit(1)), aggregate=True)


def wavg(weights: Expr, values: Expr) -> Expr:
    """Weighted mean: a prelude function, composed of others."""
    return call("sum", weights * values) / call("sum", weights)
