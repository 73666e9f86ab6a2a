import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "week_date" and df.count() > 0


def test_every_sql_names_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    return f"{v:.5g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(got.columns)
    con.execute(f"CREATE VIEW _wanted AS {catalog.ORACLES[name]}")
    want = con.sql(f"SELECT {', '.join(cols)} FROM _wanted").fetchall()
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert sorted([plain(v) for v in r] for r in rows) == sorted([plain(v) for v in r] for r in want)
