"""Run every registered query and its SQL on the same tables and compare the rows.

Usage: python tools/check_oracle.py [sf_dir] [query ...]
"""

import glob
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mascate.plans.registry import ORACLES, QUERIES  # noqa: E402
from mascate.session import local_session  # noqa: E402


def canonical(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    """Rows with columns in name order, sorted, so that neither order matters."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, name, sf_dir):
    """None if the rows agree, else a text that says how they differ; and the row count."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None, len(got)
    rel = con.sql(ORACLES[name])
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}", len(got)
    if got == want:
        return None, len(got)
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} / {len(want)} rows\n  spark only: {extra}\n  sql only:   {missing}", len(got)


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session, base = local_session(), connect(where)
    bad = 0
    for query in sys.argv[2:] or QUERIES:
        began = time.time()
        try:
            problem, count = compare(session, base, query, where)
        except Exception as error:  # noqa: BLE001 - the run goes on and reports
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        print(f"{query:36s} {count:8d} rows {time.time() - began:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{bad} differ")
    sys.exit(bad > 0)
