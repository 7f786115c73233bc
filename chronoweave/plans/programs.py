"""Programs of the text language over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from ..lang import Session
from ..operators import Frame
from ..shared import new_folder
from .catalogue import _rounded, _us, query


def program(name: str, sql: str, source: str, us: tuple[str, ...] = (), **digits: int) -> None:
    """Register a program whose last value is a table; ``@`` stands for the tables' folder, ``~`` for one of its own."""

    def run(spark, sf_dir):
        text = source.replace("@", sf_dir)
        if "~" in text:
            text = text.replace("~", new_folder(spark))
        value = Session(spark, write=lambda s: None).run(text)
        assert isinstance(value, Frame), name
        return _us(_rounded(value.to_df(), **digits), *us)

    run.__name__ = name
    run.__doc__ = source
    query(sql)(run)


program(
    "lang_query",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total, count(*)::BIGINT AS n FROM lineitem "
    "WHERE l_quantity > 10 AND (l_tax < 0.05 OR l_discount > 0.09) GROUP BY 1, 2",
    """
let t = from_parquet("@/lineitem.parquet")
func net(price: Float64, off: Float64) = price * (1.0 - off)
from t select total = sum(net(l_extendedprice, l_discount)), n = len(l_orderkey) by l_returnflag, l_linestatus where l_quantity > 10.0 and l_tax < 0.05 or l_discount > 0.09
""",
    total=2,
)
program(
    "lang_overloads",
    "SELECT c_custkey::VARCHAR AS k, c_mktsegment || '*' AS m, c_name || '7' AS j FROM customer",
    """
func label(n: Int64) = String(n)
func label(s: String) = s + "*"
func (+)(a: String, b: Int64) = a + String(b)
let c = from_parquet("@/customer.parquet")
from c select k = label(c_custkey), m = label(c_mktsegment), j = c_name + 7
""",
)
program(
    "lang_templates",
    "SELECT event_id, 9 * user_id AS s, event_id - user_id AS e FROM events",
    """
func scaled{n: Int64}(x: Int64) => n * x
func less{T: Type}(x: T, y: T): return x - y end
let e = from_parquet("@/events.parquet")
from e select event_id, s = scaled{9}(user_id), e = less{Int64}(event_id, user_id)
""",
)
program(
    "lang_generic_aggregate",
    "SELECT event_type, max(event_id) - max(event_id) + sum(event_id)::BIGINT // count(*) AS a, round(sum(value) / count(*), 6) AS b FROM events GROUP BY 1",
    """
func middle[T](xs: [T]) = sum(xs) / len(xs)
let e = from_parquet("@/events.parquet")
from e select a = middle(event_id), b = middle(value) by event_type
""",
    b=6,
)
program(
    "lang_named_arguments",
    "SELECT p_partkey, (p_size::BIGINT * 4 + 1) AS a, (p_size::BIGINT * 10 + 3) AS b FROM part",
    """
func line(x: Int64, slope: Int64 = 4, lift: Int64 = 1) = x * slope + lift
let p = from_parquet("@/part.parquet")
from p select p_partkey, a = line(p_size), b = line(lift = 3, slope = 10, x = p_size)
""",
)
program(
    "lang_control",
    "SELECT event_id FROM events WHERE user_id = 31",
    """
var k = 1
while k < 40:
  k = k * 3
end
if k > 50:
  k = k - 50
else:
  k = 0
end
let e = from_parquet("@/events.parquet")
from e select event_id where user_id == k
""",
)
program(
    "lang_suffixes",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_shipdate + INTERVAL 36 HOUR AS later, 90000000 AS gap FROM lineitem WHERE l_extendedprice > 20000",
    """
func suffix_k(n: Int64) = n * 1000
let t = from_parquet("@/lineitem.parquet")
from t select l_orderkey, l_linenumber, later = l_shipdate + 36h, gap = (l_shipdate + 1m + 30s) - l_shipdate where l_extendedprice > Float64(20k)
""",
    us=("gap",),
)
program(
    "lang_tables",
    "SELECT * FROM (VALUES (1, 'x', 'q', true), (NULL, 'y\"z', 'r', false), (3, 'tab' || chr(9), 's', true)) t(a, b, c, d)",
    r"""
data R = {a: Int64, b: String, c: Char, d: Bool}
!R([1, nil, 3], ["x", "y\"z", "tab\t"], ['q', 'r', 's'], [true, false, true])
""",
)
program(
    "lang_arrays",
    "SELECT * FROM (VALUES (6, 3, 9), (NULL, 2, 9), (8, NULL, 9)) t(a, b, c)",
    """
data R: a: Int64, b: Int64, c: Int64 end
let xs = [1, nil, 3]
let back = reverse([nil, 2, 3, 40, 50][0:3])
var ys = [0, 0, 0]
var i = 0
while i < 3:
  ys[i] = xs[0] + [5, 6, 7, 8][3]
  i = i + 1
end
!R(xs + 5, back, ys)
""",
)
program(
    "lang_joins",
    "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) "
    "SELECT l.event_id, CASE WHEN l.ts - v.ts <= INTERVAL 2 HOUR THEN v.view_id END AS view_id FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts > v.ts",
    """
let e = from_parquet("@/events.parquet")
let bought = from e select event_id, user_id, ts where event_type == "purchase"
let seen = sort (from e select user_id, ts, view_id = event_id where event_type == "view") by view_id
from (join bought, seen on user_id asof ts strict within 2h) select event_id, view_id
""",
)
program(
    "lang_lookup",
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    """
let n = from (from_parquet("@/nation.parquet")) select n_name, key = n_regionkey
let r = from (from_parquet("@/region.parquet")) select key = r_regionkey, r_name
from (join n, r on key) select n_name, r_name
""",
)
program(
    "lang_nested",
    "SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) > 26 AND count(*) > 3",
    """
let t = from_parquet("@/lineitem.parquet")
let by_supplier = from reverse(sort t by l_partkey) select m = mean(l_quantity), n = len(l_quantity) by l_suppkey
from by_supplier exec l_suppkey where m > 26.0 and n > 3
""",
)
program(
    "lang_compile",
    "SELECT c_custkey, c_custkey * 6 AS six FROM customer",
    """
func double($x: Int64) = x + x
let factor = compile("double(1) + 2 * 2")
let c = from_parquet("@/customer.parquet")
from c select c_custkey, six = c_custkey * factor
""",
)
program(
    "lang_csv",
    "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer",
    """
let c = from_parquet("@/customer.parquet")
let kept = from c select c_custkey, c_name, c_acctbal
store(kept, "~/c.csv")
load("~/c.csv")
""",
    c_acctbal=2,
)
program(
    "lang_csv_provider",
    "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    """
let n = from_parquet("@/nation.parquet")
let kept = from n select n_nationkey, n_name
store(kept, "~/n.csv")
csv_load{CsvProvider{"~/n.csv"}}("~/n.csv")
""",
)
program(
    "lang_reflection",
    """SELECT * FROM (VALUES ('Int64', 'Comptime', 'id'), ('[Float64]', 'Normal', 'mass'), ('{id: Int64, mass: Float64}', 'Normal', 'none')) t(kind, mode, name)""",
    """
data R = {kind: String, mode: String, name: String}
data P = {id: Int64, mass: Float64}
let p = !P([1], [2.0])
var late = 4
let names = columns(p)
!R([type_of(1), type_of([1.5]), type_of(P(1, 2.0))], [mode_of(2 + 3), mode_of(late), mode_of(late + 1)], [names[0], names[1], "none"])
""",
)
program(
    "lang_user_types",
    "SELECT * FROM (VALUES ('Ada', 7.5, 2), ('Bo', 7.5, 3)) t(who, height, n)",
    """
data Pair{T: Type}: who: String, height: T end
let one = Pair{Float64}("Ada", 7.5)
data R = {who: String, height: Float64, n: Int64}
let gone = 3
del gone
!R([one.who, "Bo"], [one.height, one.height], [2, 3])
""",
)
program(
    "lang_durations",
    "SELECT * FROM (VALUES (86400000000, 5400000000), (172800000000, -1500000), (259200000000, 0)) t(days, parts)",
    """
data R = {days: Timedelta, parts: Timedelta}
!R(1d * Timedelta([1, 2, 3]), [3h / 2ns, 0s - 1500ms, 1d - Timedelta("1 day")])
""",
    us=("days", "parts"),
)
