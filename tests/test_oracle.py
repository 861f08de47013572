"""Every catalogue query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lexigrow.plans import catalogue

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.execute(ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
