"""Every registered query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from chronoweave.plans import programs  # noqa: F401  they register themselves
from chronoweave.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_norm(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(map(_norm, r)) for r in df.collect()) == want


def test_values_between_two_digits_round_as_in_sql(spark, tmp_path):
    """Prices with a 5 behind the last digit, and too large for the digits; compared whole."""
    con = duckdb.connect()
    price = "CASE WHEN i % 50 = 0 THEN i * 1e11 + 0.12345 ELSE i * 17.7 + (i % 997) / 32768.0 END"
    con.execute(f"CREATE TABLE lineitem AS SELECT i AS l_orderkey, (i % 7 + 1)::INTEGER AS l_linenumber, {price} * (1 - i % 2 * 2) AS l_extendedprice, (i % 50 + 1) / 8.0 AS l_quantity, (i % 11) / 100.0 AS l_discount FROM range(3000) t(i)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    got = [tuple(r) for r in QUERIES["float_ops"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(SQL["float_ops"]).fetchall())


@pytest.mark.parametrize("name", ("csv_load_typed", "stream_csv"))
def test_stored_rows_stay_out_of_python(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("rows on the driver"))
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["l_returnflag", "l_shipdate", "vwap"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
