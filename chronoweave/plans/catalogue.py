"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import and_, bar, call, count, duration, len_, mean, not_, prod, stddev, sum_, to_date, to_float, to_int, to_string, to_time, to_timestamp, variance, wavg
from ..functions.expr import Expr
from ..functions.nil import interval_nanos
from ..operators import Frame
from ..shared import new_folder, save
from ..sources import csv_load, csv_store, load, parquet
from ..streaming import stream_csv_load, stream_parquet
from ..types import CHAR, DATE, FLOAT, INT, STRING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return parquet(spark, f"{sf_dir}/{name}.parquet")


def _round(c: Column, digits: int) -> Column:
    """Digits of a Float64 as the SQL's ``round`` gives them: the scaled double is rounded, where Spark rounds its decimal text."""
    scale = F.lit(10.0**digits)
    out = F.round(c * scale) / scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), c).otherwise(out)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: _round(F.col(c), n) for c, n in digits.items()})


def _us(df: DataFrame, *durations: str) -> DataFrame:
    """Durations as microseconds, for engines without the type."""
    return df.withColumns({c: F.call_function("div", interval_nanos(F.col(c)), F.lit(1000)) for c in durations})


BAR7 = "make_timestamp((epoch_us(l_shipdate) // 604800000000) * 604800000000)"


@query(f"SELECT l_returnflag, {BAR7} AS l_shipdate, round(sum(l_quantity * l_extendedprice) / sum(l_quantity) + 1e-8::DOUBLE, 6) AS vwap FROM lineitem GROUP BY 1, 2")
def vwap_bar(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    out = t.query({"vwap": wavg(t.l_quantity, t.l_extendedprice)}, by=[t.l_returnflag, bar(t.l_shipdate, duration(7, "d"))])
    return _rounded(out.to_df().withColumn("vwap", F.col("vwap") + 1e-8), vwap=6)  # off exact ties, which engines round differently


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 30.0 AND l_returnflag = 'R'")
def filter_project(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    out = t.query({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "net": t.l_extendedprice * (1 - t.l_discount)}, where=and_(t.l_quantity > 30.0, t.l_returnflag == "R"))
    return _rounded(out.to_df(), net=4)


@query(
    "WITH x AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS u, CASE WHEN user_id % 2 = 0 THEN value ELSE 'nan'::DOUBLE END AS v FROM events) "
    "SELECT event_id, coalesce(u > 50, false) AS gt, coalesce(u != 50, false) AS ne, NOT coalesce(u = 50, false) AS not_eq, (NOT isnan(v) AND v < 50) AS v_lt, (isnan(v) OR v <> 50) AS v_ne FROM x"
)
def filter_nil_cmp(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    df = t.df.withColumn("u", F.when(F.col("user_id") % 3 != 0, F.col("user_id"))).withColumn("v", F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(F.lit(float("nan"))))
    x = Frame(df, {"event_id": INT, "u": INT, "v": FLOAT}, t.order)
    return x.query({"event_id": "event_id", "gt": x.u > 50, "ne": x.u != 50, "not_eq": not_(x.u == 50), "v_lt": x.v < 50.0, "v_ne": x.v != 50.0}).to_df()


@query("SELECT l_quantity > 25 AS big, l_linestatus, sum(l_extendedprice)::DECIMAL(30, 2)::DOUBLE AS total FROM lineitem GROUP BY 1, 2")
def group_expr_key(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    return _rounded(t.query({"total": sum_(t.l_extendedprice)}, by={"big": t.l_quantity > 25.0, "l_linestatus": t.l_linestatus}).to_df(), total=2)


@query(
    "SELECT l_returnflag, sum(l_orderkey)::BIGINT AS s_int, round(sum(l_tax), 4) AS s_float, count(*)::BIGINT AS n, count(*)::BIGINT AS len, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS var, round(stddev_pop(l_quantity), 6) AS sd, round(exp(sum(ln(1 + l_tax / 10000))), 6) AS prod FROM lineitem GROUP BY 1"
)
def agg_all(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    out = t.query(
        {"s_int": sum_(t.l_orderkey), "s_float": sum_(t.l_tax), "n": count(t.l_tax), "len": len_(t.l_tax), "mean": mean(t.l_quantity), "var": variance(t.l_quantity), "sd": stddev(t.l_quantity), "prod": prod(1 + t.l_tax / 10000)},
        by=["l_returnflag"],
    )
    return _rounded(out.to_df(), s_float=4, mean=6, var=4, sd=6, prod=6)


@query(
    "WITH x AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events) "
    "SELECT user_id, round(coalesce(sum(v), 0), 4) AS s, count(v)::BIGINT AS n, count(*)::BIGINT AS len, round(avg(v), 6) AS m FROM x GROUP BY 1 HAVING count(v) > 0"
)
def agg_nil(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    x = Frame(t.df.withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")).otherwise(F.lit(float("nan")))), {"user_id": INT, "v": FLOAT})
    out = x.query({"s": sum_(x.v), "n": count(x.v), "len": len_(x.v), "m": mean(x.v)}, by=["user_id"])
    out = out.where(out.n > 0)
    return _rounded(out.to_df(), s=4, m=6)


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS types, coalesce(product(CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END), 1)::BIGINT AS p FROM events GROUP BY 1")
def agg_string_sum(spark, sf_dir):
    t = Frame.of(spark.read.parquet(f"{sf_dir}/events.parquet"), order_by=["event_id"])
    two = Expr(INT, lambda c: F.when(c % 50 == 0, 2).otherwise(1).cast("long"), (t.event_id,), True)
    return t.query({"types": sum_(t.event_type), "p": prod(two)}, by=["user_id"]).to_df()


@query("WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT user_id, round(sum((value - m) * (value - m)) / count(*), 4) AS v FROM events JOIN m USING (user_id) GROUP BY 1")
def agg_nested(spark, sf_dir):
    """An aggregate of an expression over another aggregate of the group."""
    t = _t(spark, sf_dir, "events")
    off = t.value - mean(t.value)
    return _rounded(t.query({"v": sum_(off * off) / len_(t.value)}, by=["user_id"]).to_df(), v=4)


@query("SELECT event_id, round(value / (SELECT avg(value) FROM events), 6) AS share FROM events")
def agg_whole(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    return _rounded(t.query({"event_id": "event_id", "share": t.value / mean(t.value)}).to_df(), share=6)


def _numbered(t: Frame) -> DataFrame:
    """Visible columns with the row's place in order; dense numbers from per-partition counts.

    The sorted rows are written once with their partition, so that counts and numbers see one sort.
    """
    df = save(t.df.orderBy(*t.order_by()).select(*t.row, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    from pyspark.sql import Window as W

    base = df.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_0"))
    base = base.select("_p", "_0", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    return df.join(F.broadcast(base), "_p").select(*t.row, (F.col("_i") - F.col("_0") + F.col("_before") + 1).alias("place"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS place FROM orders")
def sort_multi(spark, sf_dir):
    t = Frame.of(spark.read.parquet(f"{sf_dir}/orders.parquet"), order_by=["o_orderkey"])
    s = t.sort("o_orderpriority", "o_orderstatus")
    return _numbered(Frame(s.df, {n: s.row[n] for n in ("o_orderkey", "o_orderpriority")}, s.order))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice - o_custkey, o_orderkey) AS place FROM orders")
def sort_expr(spark, sf_dir):
    t = Frame.of(spark.read.parquet(f"{sf_dir}/orders.parquet"), order_by=["o_orderkey"])
    s = t.sort(t.o_totalprice - t.o_custkey)
    return _numbered(Frame(s.df, {"o_orderkey": INT}, s.order))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey DESC) AS place FROM orders")
def reverse(spark, sf_dir):
    s = Frame.of(spark.read.parquet(f"{sf_dir}/orders.parquet"), order_by=["o_orderkey"]).sort("o_orderpriority").reverse()
    return _numbered(Frame(s.df, {"o_orderkey": INT}, s.order))


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    out = o.join(c, on=[lambda t: t["o_custkey"] if "o_custkey" in t.row else t["c_custkey"]])
    return out.query(["o_orderkey", "c_name", "c_acctbal"]).to_df()


@query("SELECT o_orderkey, coalesce(c_mktsegment, '') AS c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def lookup_join_miss(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    out = o.join(c.where(c.c_mktsegment == "BUILDING"), on=[lambda t: t["o_custkey"] if "o_custkey" in t.row else t["c_custkey"]])
    return out.query(["o_orderkey", "c_mktsegment", "c_nationkey"]).to_df()


def _purchases_views(spark, sf_dir) -> tuple[Frame, Frame]:
    t = Frame.of(spark.read.parquet(f"{sf_dir}/events.parquet"), order_by=["event_id"])
    left = t.where(t.event_type == "purchase").query(["event_id", "user_id", "ts"])
    right = t.where(t.event_type == "view")
    return left, right.query({"user_id": right.user_id, "ts": right.ts, "view_id": right.event_id, "value": right.value})


_SIDES = (
    "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), "
    "v AS (SELECT user_id, ts, {pick}(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2), "
    "r AS (SELECT v.*, e.value FROM v JOIN events e ON e.event_id = v.view_id) "
)


def _asof(name: str, op: str, **options) -> None:
    pick = "max" if op[0] == ">" else "min"

    def run(spark, sf_dir):
        left, right = _purchases_views(spark, sf_dir)
        return left.join(right, on=["user_id"], asof="ts", **options).query(["event_id", "view_id"]).to_df()

    run.__name__ = name
    query(_SIDES.format(pick=pick) + f"SELECT l.event_id, r.view_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {op} r.ts")(run)


_asof("asof_backward", ">=")
_asof("asof_backward_strict", ">", strict=True)
_asof("asof_forward", "<=", direction="forward")
_asof("asof_forward_strict", "<", direction="forward", strict=True)

_BOTH = (
    _SIDES.format(pick="max")
    + ", f AS (SELECT user_id, ts, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2), "
    + "b AS (SELECT l.event_id, l.ts, r.view_id AS bid, r.ts AS bts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts), "
    + "a AS (SELECT l.event_id, f.view_id AS aid, f.ts AS ats FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.ts < f.ts) "
)
_NEAR = "CASE WHEN ats IS NULL OR bts IS NOT NULL AND ts - bts <= ats - ts THEN {b} ELSE {a} END"


@query(_BOTH + f"SELECT event_id, {_NEAR.format(b='bid', a='aid')} AS view_id FROM b JOIN a USING (event_id)")
def asof_nearest(spark, sf_dir):
    left, right = _purchases_views(spark, sf_dir)
    return left.join(right, on=["user_id"], asof="ts", direction="nearest").query(["event_id", "view_id"]).to_df()


@query(_BOTH + "SELECT event_id, CASE WHEN ts - bts <= INTERVAL 6 HOUR THEN bid END AS view_id FROM b JOIN a USING (event_id)")
def asof_within(spark, sf_dir):
    left, right = _purchases_views(spark, sf_dir)
    return left.join(right, on=["user_id"], asof="ts", within=duration(6, "h")).query(["event_id", "view_id"]).to_df()


@query(
    _BOTH
    + f"SELECT event_id, CASE WHEN abs(epoch_us(ts) - epoch_us({_NEAR.format(b='bts', a='ats')})) <= 3600000000 THEN {_NEAR.format(b='bid', a='aid')} END AS view_id FROM b JOIN a USING (event_id)"
)
def asof_nearest_within(spark, sf_dir):
    left, right = _purchases_views(spark, sf_dir)
    return left.join(right, on=["user_id"], asof="ts", direction="nearest", within=duration(1, "h")).query(["event_id", "view_id"]).to_df()


@query(
    "WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1) "
    "SELECT l.event_id, r.view_id FROM l ASOF LEFT JOIN r ON l.ts >= r.ts"
)
def asof_no_key(spark, sf_dir):
    left, right = _purchases_views(spark, sf_dir)
    return left.query(["event_id", "ts"]).join(right.query(["ts", "view_id"]), asof="ts").query(["event_id", "view_id"]).to_df()


@query("SELECT event_id, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS ts, epoch_us(ts) - (epoch_us(ts) // 3600000000) * 3600000000 AS past FROM events")
def bar_timestamp(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    return _us(t.query({"event_id": t.event_id, "ts": bar(t.ts, duration(5, "m")), "past": t.ts - bar(t.ts, duration(1, "h"))}).to_df(), "past")


@query("SELECT (DATE '1970-01-01' + ((l_shipdate::DATE - DATE '1970-01-01') // 30 * 30)::INTEGER)::DATE AS day, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def bar_date(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    return t.query({"n": len_(t.l_orderkey)}, by={"day": bar(to_date(t.l_shipdate), duration(30, "d"))}).to_df()


@query(
    "SELECT event_id, ts::DATE AS day, epoch_us(ts) % 86400000000 AS clock, ts::DATE + to_microseconds(epoch_us(ts) % 86400000000) AS whole, ts + INTERVAL 90 MINUTE AS later, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS age, strftime(ts, '%Y-%m-%d') AS shown FROM events"
)
def date_part_ops(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    day, clock = to_date(t.ts), to_time(t.ts)
    cols = {"event_id": t.event_id, "day": day, "clock": clock, "whole": day + clock, "later": t.ts + duration(90, "m"), "age": t.ts - to_timestamp("2024-01-01"), "shown": to_string(day)}
    return _us(t.query(cols).to_df(), "age")


@query(
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey + l_linenumber AS a, l_orderkey - l_partkey AS s, l_orderkey * l_linenumber AS m, (l_orderkey - l_partkey) // 7 AS d, (l_orderkey - l_partkey) % 7 AS r, -l_partkey AS n FROM lineitem"
)
def int_ops(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    gap = t.l_orderkey - t.l_partkey
    return t.query({"l_orderkey": t.l_orderkey, "l_linenumber": t.l_linenumber, "a": t.l_orderkey + t.l_linenumber, "s": gap, "m": t.l_orderkey * t.l_linenumber, "d": gap / 7, "r": gap % 7, "n": -t.l_partkey}).to_df()


@query(
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice + l_quantity, 4) AS a, round(l_extendedprice / l_quantity, 8) AS d, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE round(l_quantity / l_discount, 8) END AS z, round(l_extendedprice * l_linenumber, 4) AS m FROM lineitem"
)
def float_ops(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    out = t.query({"l_orderkey": t.l_orderkey, "l_linenumber": t.l_linenumber, "a": t.l_extendedprice + t.l_quantity, "d": t.l_extendedprice / t.l_quantity, "z": t.l_quantity / t.l_discount, "m": t.l_extendedprice * t.l_linenumber})
    return _rounded(out.to_df(), a=4, d=8, z=8, m=4)


@query("SELECT event_id, event_id & 255 AS a, event_id | 15 AS o, event_id << 3 AS l, event_id >> 2 AS r FROM events")
def bitwise(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    return t.query({"event_id": t.event_id, "a": t.event_id & 255, "o": t.event_id | 15, "l": t.event_id << 3, "r": t.event_id >> 2}).to_df()


_TRIG = ("sin", "cos", "tan", "sinh", "cosh", "tanh", "asinh", "atan", "asin", "acos", "atanh", "acosh")


@query("WITH x AS (SELECT event_id, (event_id % 100) / 101.0::DOUBLE AS u FROM events) SELECT event_id, " + ", ".join(f"round({f}(u{' + 1' if f == 'acosh' else ''}), 8) AS {f}" for f in _TRIG) + " FROM x")
def trig(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    u = (t.event_id % 100) / 101.0
    out = t.query({"event_id": t.event_id} | {f: call(f, u + 1 if f == "acosh" else u) for f in _TRIG})
    return _rounded(out.to_df(), **dict.fromkeys(_TRIG, 8))


@query(
    "SELECT event_id, trunc(value)::BIGINT AS i, event_id::DOUBLE AS f, event_id::VARCHAR AS s, user_id::VARCHAR::BIGINT AS back, epoch_us(ts) * 1000 AS ns, (event_id % 2 = 0)::BIGINT AS b, TRY_CAST(event_type AS BIGINT) AS bad FROM events"
)
def casts(spark, sf_dir):
    t = _t(spark, sf_dir, "events")
    return t.query({"event_id": t.event_id, "i": to_int(t.value), "f": to_float(t.event_id), "s": to_string(t.event_id), "back": to_int(to_string(t.user_id)), "ns": to_int(t.ts), "b": to_int(t.event_id % 2 == 0), "bad": to_int(t.event_type)}).to_df()


@query("SELECT c_name || '-' || c_mktsegment AS tag, length(c_name)::BIGINT AS n, reverse(c_name) AS back, c_name < c_mktsegment AS less FROM customer")
def string_ops(spark, sf_dir):
    t = _t(spark, sf_dir, "customer")
    return t.query({"tag": t.c_name + "-" + t.c_mktsegment, "n": _length(t.c_name), "back": call("reverse", t.c_name), "less": t.c_name < t.c_mktsegment}).to_df()


def _length(e: Expr) -> Expr:
    """Bytes of each text, where ``len`` of a column would count rows."""
    return Expr(INT, lambda c: F.octet_length(c).cast("long"), (e,), True)


@query("SELECT l_suppkey, n FROM (SELECT l_suppkey, count(*)::BIGINT AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.02 GROUP BY 1) WHERE q > 100")
def nested_query(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    inner = t.sort("l_shipdate").query({"n": len_(t.l_orderkey), "q": sum_(t.l_quantity)}, by=["l_suppkey"], where=t.l_discount > 0.02)
    return inner.query(["l_suppkey", "n"], where=inner.q > 100.0).to_df()


def _charge(t: Frame) -> Expr:
    return t.l_extendedprice * (1 - t.l_discount) * (1 + t.l_tax)


@query("SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem WHERE l_extendedprice * (1 - l_discount) * (1 + l_tax) > 1000 GROUP BY 1")
def udf_inline(spark, sf_dir):
    """A user function in where, select and by."""
    t = _t(spark, sf_dir, "lineitem")
    return _rounded(t.query({"charge": sum_(_charge(t))}, by={"day": to_date(t.l_shipdate)}, where=_charge(t) > 1000.0).to_df(), charge=2)


def _spread(x: Expr) -> Expr:
    return sum_(x * x) / sum_(x)


@query("SELECT l_returnflag, sum(l_linenumber * l_linenumber)::BIGINT // sum(l_linenumber)::BIGINT AS i, round(sum(l_quantity * l_quantity) / sum(l_quantity), 6) AS f FROM lineitem GROUP BY 1")
def udf_generic(spark, sf_dir):
    """One function for integers and floats."""
    t = _t(spark, sf_dir, "lineitem")
    return _rounded(t.query({"i": _spread(t.l_linenumber), "f": _spread(t.l_quantity)}, by=["l_returnflag"]).to_df(), f=6)


@query("SELECT event_type, round(sum(value), 2) AS s, count(*)::BIGINT AS n, round(avg(value), 6) AS m, round(var_pop(value), 4) AS v FROM events GROUP BY 1")
def stream_running(spark, sf_dir):
    t = stream_parquet(spark, f"{sf_dir}/events.parquet")
    out = t.query({"s": sum_(t.value), "n": count(t.value), "m": mean(t.value), "v": variance(t.value)}, by=["event_type"])
    return _rounded(out.so_far().to_df(), s=2, m=6, v=4)


@query("SELECT event_type, make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS ts, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_bar(spark, sf_dir):
    t = stream_parquet(spark, f"{sf_dir}/events.parquet")
    out = t.query({"n": len_(t.value)}, by=[t.event_type, bar(t.ts, duration(1, "d"))])
    return out.so_far().to_df()


@query("SELECT i AS n, i * i AS sq FROM range(0, 1000) t(i)")
def range_rows(spark, sf_dir):
    df = spark.range(1000).select(F.col("id").alias("n"))
    t = Frame.of(df, order_by=["n"])
    return t.query({"n": t.n, "sq": t.n * t.n}).to_df()


@query("SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def lookup_then_group(spark, sf_dir):
    l, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")  # noqa: E741
    j = l.query(["l_orderkey", "l_extendedprice"]).join(o, on=[lambda t: t["l_orderkey"] if "l_orderkey" in t.row else t["o_orderkey"]])
    return _rounded(j.query({"total": sum_(j.l_extendedprice)}, by=["o_orderpriority"]).to_df(), total=2)





def _sides_no_key(spark, sf_dir) -> tuple[Frame, Frame]:
    left, right = _purchases_views(spark, sf_dir)
    return left.query(["event_id", "ts"]), right.query(["ts", "view_id"])


_NO_KEY = "WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT ts, {pick}(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1) "


@query(_NO_KEY.format(pick="min") + "SELECT l.event_id, r.view_id FROM l ASOF LEFT JOIN r ON l.ts < r.ts")
def asof_no_key_forward_strict(spark, sf_dir):
    left, right = _sides_no_key(spark, sf_dir)
    return left.join(right, asof="ts", direction="forward", strict=True).query(["event_id", "view_id"]).to_df()


_NO_KEY_BOTH = (
    _NO_KEY.format(pick="max")
    + ", f AS (SELECT ts, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1), "
    + "b AS (SELECT l.event_id, l.ts, r.view_id AS bid, r.ts AS bts FROM l ASOF LEFT JOIN r ON l.ts >= r.ts), "
    + "a AS (SELECT l.event_id, f.view_id AS aid, f.ts AS ats FROM l ASOF LEFT JOIN f ON l.ts < f.ts) "
)


@query(_NO_KEY_BOTH + f"SELECT event_id, {_NEAR.format(b='bid', a='aid')} AS view_id FROM b JOIN a USING (event_id)")
def asof_no_key_nearest(spark, sf_dir):
    left, right = _sides_no_key(spark, sf_dir)
    return left.join(right, asof="ts", direction="nearest").query(["event_id", "view_id"]).to_df()


@query(_NO_KEY_BOTH + "SELECT event_id, CASE WHEN ts - bts <= INTERVAL 90 SECOND THEN bid END AS view_id FROM b JOIN a USING (event_id)")
def asof_no_key_within(spark, sf_dir):
    left, right = _sides_no_key(spark, sf_dir)
    return left.join(right, asof="ts", within=duration(90, "s")).query(["event_id", "view_id"]).to_df()


@query(
    _SIDES.format(pick="min")
    + "SELECT l.event_id, CASE WHEN r.ts - l.ts <= INTERVAL 12 HOUR THEN r.view_id END AS view_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts"
)
def asof_forward_within(spark, sf_dir):
    left, right = _purchases_views(spark, sf_dir)
    return left.join(right, on=["user_id"], asof="ts", direction="forward", within=duration(12, "h")).query(["event_id", "view_id"]).to_df()


@query(
    "WITH l AS (SELECT event_id, user_id, event_id % 3 AS lot, ts FROM events WHERE event_type = 'purchase'), "
    "r AS (SELECT user_id, event_id % 3 AS lot, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3) "
    "SELECT l.event_id, r.view_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.lot = r.lot AND l.ts >= r.ts"
)
def asof_two_keys(spark, sf_dir):
    left, right = _purchases_views(spark, sf_dir)
    left = left.query({"event_id": left.event_id, "user_id": left.user_id, "lot": left.event_id % 3, "ts": left.ts})
    right = right.query({"user_id": right.user_id, "lot": right.view_id % 3, "ts": right.ts, "view_id": right.view_id})
    return left.join(right, on=["user_id", "lot"], asof="ts").query(["event_id", "view_id"]).to_df()


@query(
    "WITH l AS (SELECT event_id, user_id % 10 AS u, epoch_us(ts) // 3600000000 AS h FROM events WHERE event_type = 'purchase'), "
    "r AS (SELECT user_id % 10 AS u, epoch_us(ts) // 3600000000 AS h, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) "
    "SELECT l.event_id, r.view_id FROM l ASOF LEFT JOIN r ON l.u = r.u AND l.h > r.h"
)
def asof_of_expressions(spark, sf_dir):
    """Keys and times that are expressions: the user's group and the hour."""
    left, right = _purchases_views(spark, sf_dir)
    out = left.join(right, on=[lambda t: t["user_id"] % 10], asof=lambda t: bar(t["ts"], duration(1, "h")), strict=True)
    return out.query(["event_id", "view_id"]).to_df()


@query(
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(s_name, '') AS s_name FROM lineitem LEFT JOIN supplier s ON l_suppkey = s.s_suppkey AND l_linenumber = s.s_nationkey % 7 + 1"
)
def lookup_two_keys(spark, sf_dir):
    """A lookup by two keys, one of them an expression."""
    l, s = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")  # noqa: E741
    key = lambda t: t["l_suppkey"] if "l_suppkey" in t.row else t["s_suppkey"]
    lot = lambda t: t["l_linenumber"] if "l_linenumber" in t.row else t["s_nationkey"] % 7 + 1
    return l.join(s, on=[key, lot]).query(["l_orderkey", "l_linenumber", "s_name"]).to_df()


@query(
    "SELECT event_id, chr((65 + event_id % 26)::INTEGER) AS letter, (65 + event_id % 26)::BIGINT AS code, event_id % 2 = 0 AS even, make_timestamp(event_id * 1000) AS moment, (event_id * 1000) % 86400000000 AS clock, (DATE '1970-01-01' + (event_id % 9000)::INTEGER)::DATE AS day, ts::DATE::TIMESTAMP AS midnight, CASE WHEN user_id % 2 = 0 THEN 93784500000 END AS gap FROM events"
)
def casts_rare(spark, sf_dir):
    """Char, Bool, Timedelta, and moments of nanoseconds and of texts."""
    t = _t(spark, sf_dir, "events")
    text = Expr(STRING, lambda u: F.when(u % 2 == 0, "1 day 02:03:04.5").otherwise("soon"), (t.user_id,), True)
    letter, ns = call("Char", t.event_id % 26 + 65), t.event_id * 1_000_000
    cols = {"event_id": t.event_id, "letter": letter, "code": to_int(letter), "even": call("Bool", t.event_id % 2 == 0), "moment": to_timestamp(ns), "clock": to_time(ns % 86_400_000_000_000)}
    cols |= {"day": to_date((t.event_id % 9000) * 86_400_000_000_000), "midnight": to_timestamp(to_date(t.ts)), "gap": call("Timedelta", text)}
    return _us(t.query(cols).to_df(), "gap")


@query("SELECT event_id, event_id % 500 * 86400000000 AS days, event_id * 7 AS part, 3600000000 // (event_id + 1) * 1000 AS quotient, CASE WHEN event_id % 2 = 0 THEN -1500000 ELSE 250 END AS units FROM events")
def timedelta_ops(spark, sf_dir):
    """Products and quotients of durations, in nanoseconds, and their suffixes."""
    t = _t(spark, sf_dir, "events")
    nanos = lambda e: call("Timedelta", e)
    odd = Expr(INT, lambda n: F.when(n % 2 == 0, F.lit(-1_500_000_000)).otherwise(F.lit(250_000)), (t.event_id,), True)
    cols = {"event_id": t.event_id, "days": duration(1, "d") * nanos(t.event_id % 500), "part": duration(7, "us") * nanos(t.event_id), "quotient": duration(1, "h") / nanos((t.event_id + 1) * 1000) * nanos(to_int(duration(1, "ms"))), "units": nanos(odd)}
    return _us(t.query(cols).to_df(), "days", "part", "quotient", "units")


def _stored(spark, t: Frame) -> str:
    path = f"{new_folder(spark)}/t.csv"
    csv_store(t, path)
    return path


@query("SELECT o_orderkey, o_orderpriority || ', \"' || o_orderstatus || '\"' AS tag, round(o_totalprice, 2) AS o_totalprice, o_orderdate::DATE AS day, o_orderdate::TIMESTAMP AS at, o_orderkey % 2 = 0 AS even FROM orders")
def csv_store_load(spark, sf_dir):
    """Stored with quoted cells, and loaded under the inferred row type."""
    t = _t(spark, sf_dir, "orders")
    cols = {"o_orderkey": t.o_orderkey, "tag": t.o_orderpriority + ', "' + t.o_orderstatus + '"', "o_totalprice": t.o_totalprice, "day": to_date(t.o_orderdate), "at": to_timestamp(t.o_orderdate), "even": t.o_orderkey % 2 == 0}
    return _rounded(load(spark, _stored(spark, t.query(cols))).to_df(), o_totalprice=2)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS n, NULL::DATE AS f, substr(o_orderstatus, 1, 1) AS c FROM orders")
def csv_load_typed(spark, sf_dir):
    """Cells that don't parse under the given types are missing."""
    t = _t(spark, sf_dir, "orders")
    text = Expr(STRING, lambda k, c: F.when(k % 3 == 0, c.cast("string")).otherwise(F.concat(c.cast("string"), F.lit("x"))), (t.o_orderkey, t.o_custkey), True)
    path = _stored(spark, t.query({"o_orderkey": t.o_orderkey, "n": text, "f": t.o_orderpriority, "c": t.o_orderstatus}))
    return csv_load(spark, path, {"o_orderkey": INT, "n": INT, "f": DATE, "c": CHAR}).to_df()


@query("SELECT event_type, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS s, product(CASE WHEN event_id = 7 THEN 3.0 ELSE 1.0 END) AS p FROM events GROUP BY 1")
def stream_csv(spark, sf_dir):
    """Running aggregates over CSV files that arrive in a folder."""
    t = _t(spark, sf_dir, "events")
    three = Expr(FLOAT, lambda i: F.when(i == 7, 3.0).otherwise(1.0), (t.event_id,), True)
    path = _stored(spark, t.query({"event_id": t.event_id, "user_id": t.user_id, "event_type": t.event_type, "f": three}))
    s = stream_csv_load(spark, path.rpartition("/")[0], {"event_id": INT, "user_id": INT, "event_type": STRING, "f": FLOAT})
    return s.query({"n": len_(s.event_id), "s": sum_(s.user_id), "p": prod(s.f)}, by=["event_type"]).so_far().to_df()


@query("SELECT event_id, user_id + 1 AS next FROM events WHERE event_type = 'view'")
def stream_rows(spark, sf_dir):
    """A projection and filter of a stream, batch by batch."""
    t = stream_parquet(spark, f"{sf_dir}/events.parquet")
    return t.query({"event_id": t.event_id, "next": t.user_id + 1}, where=t.event_type == "view").so_far("append").to_df()


@query("SELECT user_id, max(event_id) AS last FROM events GROUP BY 1")
def stream_batches(spark, sf_dir):
    """Operators that need order, inside each micro-batch: here the sorted batch's groups."""
    t, folder = stream_parquet(spark, f"{sf_dir}/events.parquet"), new_folder(spark)

    def keep(batch: Frame, n: int) -> None:
        first = batch.df.groupBy("user_id").agg(F.max("event_id").alias("last"))
        first.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    t.each_batch(keep, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("user_id").agg(F.max("last").alias("last"))


@query("SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def group_two_keys(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    return t.query({"n": len_(t.l_orderkey)}, by=["l_suppkey", "l_returnflag"]).to_df()


@query("SELECT l_suppkey, (product(CASE WHEN l_orderkey % 40 = 0 THEN -1 WHEN l_orderkey % 997 = 0 THEN 2 ELSE 1 END))::BIGINT AS p FROM lineitem GROUP BY 1")
def agg_int_product(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    factor = Expr(INT, lambda k: F.when(k % 40 == 0, -1).when(k % 997 == 0, 2).otherwise(1).cast("long"), (t.l_orderkey,), True)
    return t.query({"p": prod(factor)}, by=["l_suppkey"]).to_df()
