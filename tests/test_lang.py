"""The text front end: values, statements, functions and queries."""

import pytest

from chronoweave.errors import QueryError
from chronoweave.lang import Session
from chronoweave.lang.parser import parse


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lang")
    path = folder / "gauges.csv"
    days = ["2021-06-10", "2021-06-12", "2021-06-14"]
    rows = [(k, d, base + i, base + i + 0.5, 100 * (i + 1)) for k, base in (("north", 115.0), ("south", 29.0)) for i, d in enumerate(days)]
    path.write_text("station,day,low,high,drops\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    session = Session(spark, ["one"])
    session.run(f'let gauges = load("{path}")')
    session.folder = folder
    return session


@pytest.mark.parametrize(
    "source,want",
    [
        ("7 / 2", "3"), ("-7 / 2", "-3"), ("-7 % 2", "-1"), ("7.0 / 2", "3.5"), ("2 + 3 * 4", "14"), ("(2 + 3) * 4", "20"), ("1 << 4 | 1", "17"),
        ("0xff + 0b11 + 0o7", "265"), ("1 + nil", "nil"), ("1.5 + nan", "nan"), ("true or false and false", "false"), ("not nil == 5", "true"),
        ("nil == 5", "false"), ('"a" "b" + "c"', '"abc"'), ("[1, 2, nil] + 5", "[6, 7, nil]"), ("sum([1, 2, 3])", "6"), ("prod([2, 3])", "6"),
        ("mean([1, 2, nil])", "1.5"), ("variance([1, 2, nil])", "0.25"), ("stddev([1, 2, nil])", "0.5"), ('sum(["a", "b"])', '"ab"'),
        ("count([1, nil])", "1"), ("len([1, nil])", "2"), ('len("abc")', "3"), ("range(4)", "[0, 1, 2, 3]"), ("reverse([1, 2])", "[2, 1]"),
        ("5m + 3s", 'Timedelta("00:05:03")'), ('Timestamp("2017-01-01 10:00:00") - Timestamp("2017-01-01")', 'Timedelta("10:00:00")'),
        ('bar(Timestamp("2017-01-01 10:07:00"), 5m)', 'Timestamp("2017-01-01 10:05:00")'), ('Date("2017-01-01") + Time("10:20:00")', 'Timestamp("2017-01-01 10:20:00")'),
        ("Int64(3.9)", "3"), ('Int64("x")', "nil"), ("String(1.50)", '"1.5"'), ("'a'", "'a'"), ("sin(0.0)", "0.0"), ("[1, 2][1]", "2"), ("[1, 2, 3][0:2]", "[1, 2]"),
        ("type_of(3)", '"Int64"'), ("type_of([1.0])", '"[Float64]"'), ("mode_of(7 + 3)", '"Comptime"'), ("traits_of(sum)", '"pure, autostream"'), ('compile("2" + "+3")', "5"), ("argv", '["one"]'),
        ("range(30)", "[" + ", ".join(map(str, range(25))) + ", ...]"),
    ],
)
def test_values(s, source, want):
    assert s.eval(source) == want


@pytest.mark.parametrize(
    "source,want",
    [
        ("var x = 0\nwhile x < 5:\n x = x + 1\nend\nx", "5"),
        ("func f(n: Int64):\n if n < 2: return n\n else: return f(n - 1) + f(n - 2)\n end\nend\nf(10)", "55"),
        ("func g(x: Int64) = x + 1\nfunc g(x: String) = x + \"!\"\ng(\"a\")", '"a!"'),
        ("func nearer{T: Type}(mark: T, a: T, b: T): if (a - mark) * (a - mark) < (b - mark) * (b - mark): return a else: return b end end\nnearer{Float64}(1.0, 2.5, -1.25)", "2.5"),
        ("func shifted{bits: Int64}(word: Int64) => word << bits | 1\nshifted{3}(5) + shifted{1}(2)", "46"),
        ("func h[T](xs: [T]) = len(xs)\nh([1, 2])", "2"),
        ('func (+)(a: String, b: Int64) = a + String(b)\n"x" + 4', '"x4"'),
        ("func suffix_k(n: Int64) = n * 1000\n3k", "3000"),
        ("func twice($x: Int64) = x + x\ntwice(4)", "8"),
        ("func d(x: Int64, y: Int64 = 2) = x * y\nd(y = 5, x = 3) + d(4)", "23"),
        ("data Span{K: Type}: from_: K, to_: K, label: String end\nlet s = Span{Timedelta}(2m, 90s, \"b\")\ns.from_ - s.to_", 'Timedelta("00:00:30")'),
        ('let marks = ["p", "q", "r", "s"]\nvar i = 3\nwhile i > 1:\n marks[i] = marks[i - 2] + "!"\n i = i - 1\nend\nmarks', '["p", "q", "p!", "q!"]'),
        ("(range(1000) * 3)[997]", "2991"), ("range(1000)[10:16:2]", "[10, 12, 14]"), ("1d * Timedelta([1, 2, 3])", '[Timedelta("1 days"), Timedelta("2 days"), Timedelta("3 days")]'),
        ("Timedelta(1)", 'Timedelta("00:00:00.000000001")'), ("1s / 8ns", 'Timedelta("00:00:00.125000")'), ("Int64(7ns + 1us)", "1007"), ("5ns < 1us", "true"),
        ("let y: Float64 = nan\ndel y\n2", "2"),
        ("data R = {a: Int64, b: String}\nlen(!R([1, 2], [\"x\", \"y\"]))", "2"),
    ],
)
def test_programs(spark, source, want):
    assert Session(spark).eval(source) == want


def rows(text):
    return [line.split() for line in text.splitlines()]


def test_queries(s):
    assert rows(s.eval("from gauges select n = len(low), v = sum(drops) by station")) == [["station", "n", "v"], ["north", "3", "600"], ["south", "3", "600"]]
    assert rows(s.eval('from gauges select day, high - low where station == "south" and drops > 100'))[1:] == [["2021-06-12", "0.5"], ["2021-06-14", "0.5"]]
    assert rows(s.eval("from (from gauges select m = mean(low) by station) select station where m > 100.0"))[1:] == [["north"]]
    assert rows(s.eval("from reverse(sort gauges by low) select low where drops == 300"))[1:] == [["117.0"], ["31.0"]]


def test_user_functions_in_queries(s):
    s.run("func wmean(ws, vs) = sum(ws * vs) / sum(ws)\nlet floor_ = 100")
    assert rows(s.eval("from gauges select w = wmean(drops, low) by station where drops > floor_"))[1:] == [["north", "116.6"], ["south", "30.6"]]
    assert s.eval("wmean(gauges.drops, gauges.low) > 70.0") == "true"


def test_joins(s):
    s.run('data L: station: String, crew: Char end\nlet ls = !L(["north"], [\'Q\'])')
    assert [r[-1] for r in rows(s.eval("join gauges, ls on station"))][1:4] == ["Q"] * 3
    s.run('data V: day: Date, visit: String end\nlet vs = !V([Date("2021-06-09"), Date("2021-06-12")], ["first", "second"])')
    assert [r[-1] for r in rows(s.eval("join gauges, vs asof day strict"))][1:4] == ["first", "first", "second"]
    assert [r[-1] for r in rows(s.eval("from (join gauges, vs asof day nearest within 2d) select visit"))][1:4] == ["first", "second", "second"]


def test_store_and_print(s):
    out = []
    s.write = out.append
    s.run(f'store(from gauges select station, low where drops == 100, "{s.folder}/o.csv")\nprint(1.0)\nprint([1, 2])\nprint("x")')
    assert open(s.folder / "o.csv").read() == "station,low\nnorth,115.0\nsouth,29.0\n"
    assert out == ["1.0", "[1, 2]", "x"]


@pytest.mark.parametrize(
    "source",
    ['print("early")\n1 + "a"', 'func bad(x: Int64) = x + "a"', 'print("early")\nif 1 < 2: print(3) else: 1 + true end', 'print("early")\nwhile false: sum("x" + 1) end', 'func f(n: Int64): if n < 1: return 1 else: return "one" end end', 'print("early")\nfrom gauges select low + station', 'print("early")\nlet x: String = 3', "func g(t: !{a: Int64}) = t.b", 'print("early")\nfrom gauges select sum(low), high by station'],
)
def test_programs_are_checked_before_they_run(s, source):
    out = []
    s.write = out.append
    with pytest.raises(QueryError):
        s.run(source)
    assert out == []


def test_checks_leave_the_unknown_to_the_run(s):
    path = f"{s.folder}/later.csv"
    assert s.eval(f'store(from gauges select drops where low > 100.0, "{path}")\nlet back = load("{path}")\nsum(back.drops)') == "600"
    assert s.eval("func down(n: Int64): if n > 0: return down(n - 1) end return 0 end\ndown(3)") == "0"
    with pytest.raises(QueryError, match="out of bounds"):
        s.run("gauges.low[6]")


@pytest.mark.parametrize(
    "source,traits,mode",
    [
        ("2.5", "pure, transform, linear", "Comptime"), ("fixed * 2", "pure, transform, linear", "Comptime"), ("loose * 2", "none", "Normal"), ("[fixed, loose]", "none", "Normal"), ("[fixed, 4][1]", "pure, transform", "Comptime"),
        ("print(fixed)", "none", "Normal"), ("now()", "none", "Normal"), ("gauges", "transform, linear", "Normal"), ("gauges.low - 1.0", "transform, linear", "Normal"), ("gauges.low[1]", "transform", "Normal"), ("halved(fixed)", "pure, transform, linear", "Comptime"),
        ("halved", "pure, transform, linear", "Comptime"), ("total", "pure, autostream", "Comptime"), ("stddev", "pure, autostream", "Comptime"), ("flow", "transform, linear", "Stream"), ("flow.n + 1", "transform, linear", "Stream"), ("flow.n[0]", "transform", "Normal"),
        ("from flow select sum(n) by k", "transform", "Stream"), ("sort flow by n", "transform", "Normal"), ("Float64", "pure, transform, linear", "Comptime"), ('Int64("12")', "pure, transform, linear", "Comptime"),
    ],
)
def test_traits_and_modes(s, source, traits, mode):
    if s.top.find("flow") is None:
        folder = s.folder / "flow"
        folder.mkdir()
        (folder / "a.csv").write_text("k,n\na,1\n")
        s.run(f'let fixed = 4\nvar loose = 5\nlet flow = stream_load("{folder}")\nfunc halved(x: Int64) = x / 2\nfunc total(xs: [Int64]) = sum(xs + 1)')
    assert s.eval(f"traits_of({source})") == f'"{traits}"'
    assert s.eval(f"mode_of({source})") == f'"{mode}"'


@pytest.mark.parametrize(
    "source,message",
    [
        ("zz", "not declared"), ("let a = 1\na = 2", "not a var"), ("var a = 1\na = 2.0", "is Int64, not Float64"), ("1 + true", "takes no"), ("[1, 2.0]", "one builtin type"),
        ("[1, 2] + [1]", "mismatched"), ("[1][3]", "out of bounds"), ("1 / 0", "divided by zero"), ("import os", "not implemented"), ("if 1: 2 end", "must be a Bool"),
        ("join gauges, gauges on station", "both tables"), ("join gauges, gauges strict", "needs on or asof"), ("from gauges select by station", "needs columns"),
        ("var p = \"x\"\nload(p)", "known before"), ("from gauges select zz", "not declared"), ("1 +", "unexpected"),
    ],
)
def test_errors(s, source, message):
    with pytest.raises(QueryError, match=message):
        s.run(source)


def test_or_binds_tighter_than_and():
    assert parse("a and b or c") == [("expr", ("call", "and", [("name", "a"), ("call", "or", [("name", "b"), ("name", "c")])]))]
