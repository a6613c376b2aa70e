"""Queries that SQL can express give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from mascate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(rows):
    shorten = lambda value: float(f"{value:.9g}") if isinstance(value, float) else value
    return sorted((tuple(map(shorten, row)) for row in rows), key=repr)


@pytest.mark.parametrize("name", ["op9_quality_bayes", "op11_periodic_runs", "op13_centroid_clusters"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert canonical(got.collect()) == canonical(want.fetchall())
