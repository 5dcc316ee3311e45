"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_entry_points_need_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, check=True)
    queries, sql = map(int, said.stdout.split())
    assert queries >= sql > 50


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "perf_iso" in df.columns


@pytest.mark.parametrize("name", ["sma", "rsi", "roll_mdd", "sharpe", "arma_garch", "covariance", "ema_blocked"])
def test_queries_equal_their_sql(spark, name):
    from seriesmill.plans import queries as q

    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(q.SQL[name])
    columns = [c[0] for c in want.description]
    got = q.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
