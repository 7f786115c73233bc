"""Lookup and as-of joins: one output row per left row, in left order."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expr import Expr, call, compiled, has_aggregate, literal
from ..functions.nil import filled
from ..shared import save
from ..types import FLOAT, SUBTRACTABLE, difference

if TYPE_CHECKING:
    from .frame import Frame, Item, Items

DIRECTIONS = ("backward", "forward", "nearest")
#: Rows of one key, or of a join without keys, that one window sorts.
SPAN_ROWS = 2_000_000
ROW_BYTES = 16


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _sides(item: Item, left: Frame, right: Frame) -> tuple[Expr, Expr]:
    """A key on both sides: a column name, or a function of a frame."""
    if isinstance(item, str):
        return left[item], right[item]
    if callable(item) and not isinstance(item, Expr):
        return literal(item(left)), literal(item(right))
    return item, item


def join(left: Frame, right: Frame, on: Items, asof: Item | None, strict: bool, direction: str | None, within: object) -> Frame:
    from .frame import Frame, hidden

    if not on and asof is None:
        raise QueryError("a join needs on or asof")
    if asof is None and (strict or direction or within is not None):
        raise QueryError("strict, direction and within need asof")
    if direction not in (None, *DIRECTIONS):
        raise QueryError(f"no direction is named {direction}")
    if direction == "nearest" and strict:
        raise QueryError("nearest can't be strict")
    if isinstance(asof, (list, tuple)):
        if len(asof) != 1:
            raise QueryError("asof takes one expression")
        asof = asof[0]
    on = [on] if isinstance(on, (str, Expr)) or callable(on) else list(on or ())
    keys = [_sides(k, left, right) for k in on]
    time = _sides(asof, left, right) if asof is not None else None
    for a, b in [*keys, *([time] if time else [])]:
        if a.type is not b.type:
            raise QueryError(f"key types differ: {a.type} and {b.type}")
        if not (a.array and b.array) or has_aggregate(a) or has_aggregate(b):
            raise QueryError("a key must be an array")
    gap = None
    if time and (direction == "nearest" or within is not None):
        if time[0].type not in SUBTRACTABLE:
            raise QueryError(f"{time[0].type} values have no distance")
        if within is not None:
            gap = literal(within)
            want = difference(time[0].type)
            if gap.type is not want:
                raise QueryError(f"within must be {want}, not {gap.type}")

    dropped = {b.name for _, b in keys} | ({time[1].name} if time else set())
    rest = [n for n in right.row if n not in dropped]
    both = [n for n in rest if n in left.row]
    if both:
        raise QueryError(f"both tables have a column {', '.join(both)}")
    kl, kr = [hidden() for _ in keys], [hidden() for _ in keys]
    found = hidden()
    l_df = left.df.select("*", *(compiled(a).alias(h) for (a, _), h in zip(keys, kl)))
    r_df = right.df.select("*", *(compiled(b).alias(h) for (_, b), h in zip(keys, kr)))
    payload = F.struct(F.lit(1).alias("_hit"), *(_quoted(n) for n in rest))
    if time is None:
        out = _lookup(l_df, r_df, kl, kr, payload, found)
    else:
        out = _asof(left, right, l_df, r_df, kl, kr, time, payload, found, strict, direction or "backward", gap)
    cols = [_quoted(n) for n in left.row] + [filled(F.col(found).getField(n), right.row[n]).alias(n) for n in rest]
    return Frame(out.select(*cols, *(_quoted(n) for n, _ in left.order)), left.row | {n: right.row[n] for n in rest}, left.order)


def _lookup(left: DataFrame, right: DataFrame, kl: list[str], kr: list[str], payload: Column, found: str) -> DataFrame:
    """Left outer join on keys that must be unique on the right; missing keys match each other.

    The right side is reduced to a row per key, which also counts; a count above one
    raises in a filter, so that pruning the payload can't hide it.
    """
    one = right.groupBy(*kr).agg(F.count(F.lit(1)).alias("_n"), F.first(payload).alias(found))
    message = F.concat(F.lit("the right table has a key more than once: "), F.to_json(F.struct(*kr)))
    one = one.where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    match = F.lit(True)
    for a, b in zip(kl, kr):
        match = match & F.col(a).eqNullSafe(F.col(b))
    return left.join(one, match, "left").drop("_n", *kr)


def _asof(left: Frame, right: Frame, l_df: DataFrame, r_df: DataFrame, kl, kr, time, payload: Column, found: str, strict: bool, direction: str, gap: Expr | None) -> DataFrame:
    """Tag and unite both sides, and carry right rows along one ordered window.

    Backward takes the last right row at or before a left row, forward the first at or
    after; ties on the right go to the last and the first in right order.  Only left rows
    come out.  A missing time matches nothing.
    """
    t = time[0].type
    r_order = right.order_by()
    tie = F.struct(*(F.when(F.lit(up), _quoted(n)).alias(f"o{i}") for i, (n, up) in enumerate(right.order))) if right.order and all(up for _, up in right.order) else None
    if right.order and tie is None:
        right_rows = r_df.orderBy(*r_order).withColumn("_tie", F.monotonically_increasing_id())
    else:
        right_rows = r_df.withColumn("_tie", tie if tie is not None else F.lit(0))
    tie_type = right_rows.schema["_tie"].dataType
    l_time, r_time = compiled(time[0]), compiled(time[1])
    if t is FLOAT:  # NaN is the missing value
        l_time, r_time = F.nanvl(l_time, F.lit(None)), F.nanvl(r_time, F.lit(None))
    keys = [f"_k{i}" for i in range(len(kl))]
    l_cols = [c for c in l_df.columns]
    lefts = l_df.select(F.struct(*map(_quoted, l_cols)).alias("_l"), *(F.col(a).alias(k) for a, k in zip(kl, keys)), l_time.alias("_t"), F.lit(None).cast(tie_type).alias("_tie"))
    rights = right_rows.select(*(F.col(b).alias(k) for b, k in zip(kr, keys)), r_time.alias("_t"), "_tie", F.struct(r_time.alias("_rt"), payload.alias("_p")).alias("_r")).where("_t is not null")
    rows = lefts.withColumn("_r", F.lit(None).cast(rights.schema["_r"].dataType)).withColumn("_side", F.lit(1)).unionByName(
        rights.withColumn("_l", F.lit(None).cast(lefts.schema["_l"].dataType)).withColumn("_side", F.lit(0))
    )
    spanned = _spanned(rows, keys)
    rows, keys_in = (rows, keys) if spanned is None else (spanned, [*keys, "_span"])

    def seen(back: bool, right_first: bool) -> Column:
        """The right row that a left row sees, looking back or ahead within its span.

        Ahead looks back through the rows in reverse: Spark keeps a value running from the
        first row on, but goes over all rows that follow anew for each row.
        """
        side = F.col("_side") if right_first else -F.col("_side")
        up = (F.col("_t").asc_nulls_first(), side.asc(), F.col("_tie").asc_nulls_first())
        down = (F.col("_t").desc_nulls_last(), side.desc(), F.col("_tie").desc_nulls_last())
        w = W.partitionBy(*keys_in).orderBy(*(up if back else down))
        return F.last("_r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))

    back = ahead = None
    if direction in ("backward", "nearest"):
        back = ("_back", seen(True, not strict))
    if direction in ("forward", "nearest"):
        # strictly after, so that equal times are the backward match
        ahead = ("_ahead", seen(False, strict or direction == "nearest"))
    whole = rows.select("*", *(c.alias(n) for n, c in filter(None, (back, ahead)))).where("_side = 1")
    if spanned is not None:
        whole = _carried(rows, whole, keys, bool(back), bool(ahead))
    at = lambda n: F.when(F.col("_t").isNotNull(), F.col(n))
    ex = lambda c: Expr(t, lambda: c, (), True, "_t")
    distance = lambda a, b: compiled(call("-", ex(a), ex(b)))
    if direction == "nearest":
        b, a = at("_back"), at("_ahead")
        choice = F.when(a.isNull() | (b.isNotNull() & (distance(F.col("_t"), b["_rt"]) <= distance(a["_rt"], F.col("_t")))), b).otherwise(a)
    else:
        choice = at("_back" if back else "_ahead")
    if gap is not None:
        far = F.when(choice["_rt"] <= F.col("_t"), distance(F.col("_t"), choice["_rt"])).otherwise(distance(choice["_rt"], F.col("_t")))
        choice = F.when(far <= compiled(gap), choice)
    whole = whole.withColumn("_m", choice)
    return whole.select(*(F.col("_l").getField(c).alias(c) for c in l_cols), F.col("_m._p").alias(found))


def _spanned(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The rows written by ranges of key and time, whose number is ``_span``; None where one window can sort each key.

    Ranges split a key, or a join without keys, at any times of any type, but never between
    equal times.  Only tables whose estimated size says that a key could be too large are counted.
    """
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPAN_ROWS * ROW_BYTES:
        return None
    found = rows.groupBy(*keys).count().agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    if (found["largest"] or 0) <= SPAN_ROWS:
        return None
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), found["all"] // SPAN_ROWS + 1)
    return save(rows.repartitionByRange(n, *keys, "_t").withColumn("_span", F.spark_partition_id()))


def _carried(rows: DataFrame, whole: DataFrame, keys: list[str], back: bool, ahead: bool) -> DataFrame:
    """Right rows from other spans, where a left row's own span has none.

    Only keys that go over the border of a range need any: at most one for each range.
    """

    def on(names: list[str], mark: str) -> Column:
        match = F.lit(True)
        for k in names:
            match = match & F.col(k).eqNullSafe(F.col(f"{k}{mark}"))
        return match

    split = rows
    if keys:
        over = rows.groupBy(*keys).agg(F.min("_span").alias("_low"), F.max("_span").alias("_high")).where("_low < _high")
        split = rows.join(over.select(*(F.col(k).alias(f"{k}o") for k in keys)), on(keys, "o"), "left_semi")
    ends = F.when(F.col("_side") == 0, F.struct("_t", "_tie", "_r"))
    spans = split.groupBy(*keys, "_span").agg(F.max(ends).getField("_r").alias("_last"), F.min(ends).getField("_r").alias("_first"))
    up, down = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_span"), F.desc("_span")))
    spans = spans.select(*keys, "_span", F.last("_last", ignorenulls=True).over(up).alias("_before"), F.last("_first", ignorenulls=True).over(down).alias("_after"))
    spans = spans.select(*(F.col(k).alias(f"{k}s") for k in [*keys, "_span"]), "_before", "_after")
    whole = whole.join(spans, on([*keys, "_span"], "s"), "left")
    if back:
        whole = whole.withColumn("_back", F.coalesce("_back", "_before"))
    if ahead:
        whole = whole.withColumn("_ahead", F.coalesce("_ahead", "_after"))
    return whole
