"""Every registered query runs, and agrees with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandmark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def cells(rows, cols):
    norm = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([norm(r[c]) for c in cols]) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in ("lineitem", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert cells(rows, cols) == cells([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], cols)


def test_kde_grid_is_whole(spark):
    assert QUERIES["kde_grid"](spark, DATA).count() == 250 * 250
