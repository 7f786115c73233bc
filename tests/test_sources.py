"""CSV inference, loading and storing; streams."""

import datetime as dt

import pytest

from chronoweave import shared
from chronoweave.errors import QueryError
from chronoweave.functions import bar, duration, len_, mean, sum_, variance
from chronoweave.operators import Frame
from chronoweave.sources import csv_load, csv_store, infer_row, load
from chronoweave.sources.files import column_names
from chronoweave.streaming import StreamFrame, stream_csv_load, stream_parquet
from chronoweave.types import BOOL, DATE, FLOAT, INT, STRING, TIME, TIMESTAMP

CSV = """Sym,day,at,When Seen,n,x,ok,,n,note
a,2020-01-02,10:00:00,2020-01-02 10:00:00.5,1,1.5,true,,7,"p, q"
b,2020/01/03,11:30:00,2020-01-03 00:00:00,,2,false,,8,r
c,2020-01-04,12:00:00,2020-01-04 01:02:03,3,1e3,true,,,s
"""


@pytest.fixture()
def path(tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    return str(tmp_path / "t.csv")


def test_inferred_row(spark, path):
    assert infer_row(spark, path) == {"sym": STRING, "day": DATE, "at": TIME, "when_seen": TIMESTAMP, "n": INT, "x": FLOAT, "ok": BOOL, "unnamed_7": STRING, "n_1": INT, "note": STRING}


def test_names():
    assert column_names(["A b", "a_b", "", "x.y", "A B"]) == ["a_b", "a_b_1", "unnamed_2", "x_y", "a_b_2"]


def test_load(spark, path):
    rows = load(spark, path).collect()
    assert rows[0] == ("a", dt.date(2020, 1, 2), 36_000_000_000, dt.datetime(2020, 1, 2, 10, 0, 0, 500_000), 1, 1.5, True, "", 7, "p, q")
    assert rows[1][4] is None and rows[2][5] == 1000.0 and rows[2][8] is None


def test_moments_as_stored_load_like_other_layouts(spark, tmp_path):
    """What a cast reads beyond the accepted layouts stays missing, and both ways to read agree."""
    held = {"0001-01-01 00:00:00": dt.datetime(1, 1, 1), "1582-10-10 01:02:03.5": dt.datetime(1582, 10, 10, 1, 2, 3, 500_000), "2020-02-29 23:59:59.000001": dt.datetime(2020, 2, 29, 23, 59, 59, 1)}
    none = ["2021-02-29 00:00:00", "2020-13-01 00:00:00", "2020-01-01 24:00:00", "2020-01-01 00:60:00", "2020-01-01 00:00:60", "2020-1-1 00:00:00", "2020-01-01 00:00:00Z"]
    texts = [*held, *(t.replace("-", "/", 2) for t in held), *none]
    (tmp_path / "m.csv").write_text("at\n" + "".join(f"{t}\n" for t in texts))
    assert [r[0] for r in csv_load(spark, str(tmp_path / "m.csv"), {"at": TIMESTAMP}).collect()] == [*held.values(), *held.values(), *[None] * len(none)]


def test_typed_load_by_position(spark, tmp_path):
    (tmp_path / "s.csv").write_text("h,i,j\n1,x\n2,y,3,4\nbad,z,5\n")
    assert csv_load(spark, str(tmp_path / "s.csv"), {"a": INT, "b": STRING, "c": INT}).collect() == [(1, "x", None), (2, "y", 3), (None, "z", 5)]


def test_only_the_first_rows_are_sampled(spark, tmp_path):
    (tmp_path / "l.csv").write_text("a\n" + "1\n" * 9 + "x\n")
    assert infer_row(spark, str(tmp_path / "l.csv")) == {"a": INT}
    assert load(spark, str(tmp_path / "l.csv")).collect()[-1] == (None,)


def test_store_and_load_again(spark, tmp_path):
    t = Frame.rows(spark, {"s": STRING, "n": INT, "f": FLOAT, "d": DATE, "b": BOOL}, [("A,A", 1, 1.25, dt.date(2020, 5, 6), True), ('say "x"', None, float("nan"), None, False)])
    out = str(tmp_path / "o.csv")
    csv_store(t, out)
    assert open(out).read() == 's,n,f,d,b\n"A,A",1,1.25,2020-05-06,true\n"say ""x""",,,,false\n'
    assert load(spark, out).collect()[0] == ("A,A", 1, 1.25, dt.date(2020, 5, 6), True)
    csv_store(t.reverse(), out)
    assert open(out).read().splitlines()[1].startswith('"say')


def test_store_joins_parts_in_order(spark, tmp_path, monkeypatch):
    """Rows are written by tasks; none passes through Python."""
    t = Frame.of(spark.range(0, 5000, 1, 13).selectExpr("id * 7919 % 5000 AS n", "concat('é,', id) AS s"), order_by=["n"])
    rows = [f'{n},"é,{i}"' for n, i in sorted((i * 7919 % 5000, i) for i in range(5000))]
    for f in ("toLocalIterator", "collect"):
        monkeypatch.setattr(type(t.df), f, lambda *a, **k: pytest.fail("rows on the driver"))
    monkeypatch.setattr(shared, "shared_dir", lambda s: str(tmp_path / "shared"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "150")
    try:
        for frame, want in ((t, rows), (t.reverse(), rows[::-1]), (t.where(t.n < 0), [])):
            csv_store(frame, str(tmp_path / "p.csv"))
            assert (tmp_path / "p.csv").read_text().splitlines() == ["n,s", *want]
            assert not [f for f in (tmp_path / "shared").iterdir() if not f.name.startswith(".")]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_stream_of_csv_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text("k,v\n" + "".join(f"{'ab'[j % 2]},{i * 10 + j}\n" for j in range(i * 2)))
    t = stream_csv_load(spark, str(folder), {"k": STRING, "v": INT})
    got = t.query({"s": sum_(t.v), "n": len_(t.v), "m": mean(t.v), "w": variance(t.v)}, by=["k"]).so_far().collect()
    assert sorted(got) == [("a", 52, 3, 52 / 3, pytest.approx(27.555555556)), ("b", 55, 3, 55 / 3, pytest.approx(27.555555556))]
    first = t.query({"k": t.k, "v": t.v + 1}, where=t.v > 20).so_far("append").collect()
    assert sorted(first) == [("a", 23), ("b", 22), ("b", 24)]


def test_stream_refuses_order(spark, sf_dir):
    t = stream_parquet(spark, f"{sf_dir}/events.parquet")
    for f in (t.sort, t.reverse, t.join):
        with pytest.raises(QueryError, match="no order"):
            f()
    with pytest.raises(QueryError, match="streaming"):
        StreamFrame(spark.range(1), {})


def test_stream_windows_with_watermark(spark, sf_dir):
    t = stream_parquet(spark, f"{sf_dir}/events.parquet").watermark("ts", "1 hour")
    got = t.windowed("ts", "1 day", {"n": len_(t.user_id)}, by=["event_type"]).so_far().collect()
    b = Frame.of(spark.read.parquet(f"{sf_dir}/events.parquet"))
    want = b.query({"n": len_(b.user_id)}, by={"ts": bar(b.ts, duration(1, "d")), "event_type": b.event_type}).collect()
    assert sorted(got) == sorted(want)


def test_each_batch_gives_frames(spark, sf_dir, tmp_path):
    t, seen = stream_parquet(spark, f"{sf_dir}/events.parquet"), []
    t.each_batch(lambda f, n: seen.append(f.sort("ts").count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
