from datetime import date
from decimal import Decimal

import pytest

from conftest import rows
from mascate.functions.calendar import DateWindow
from mascate.sources.tables import (
    TABLES,
    read_facts,
    read_parquet,
    refusals,
    schema_of,
    sift,
    write_facts,
    write_snapshot,
)


def test_schemas(spark):
    assert {name: len(schema_of(name).fields) for name in TABLES}["customers"] == 17


def test_read_with_other_names(spark, tmp_path):
    source = spark.createDataFrame(
        [(3, 12, date(2026, 1, 1), 7, "123   ", 9.999, "S ", "unused")],
        "loja INT, doc INT, dia DATE, vend LONG, cliente STRING, valor DOUBLE, canc STRING, extra STRING",
    )
    source.write.parquet(str(tmp_path / "in"))
    names = dict(store="loja", document="doc", date="dia", seller_no="vend", tax_id="cliente", total="valor", cancelled="canc")
    got = read_parquet(spark, "orders", str(tmp_path / "in"), names)
    assert got.schema.simpleString() == schema_of("orders").simpleString()
    assert rows(got) == [(3, 12, date(2026, 1, 1), 7, "123", Decimal("10.00"), "S")]
    plan = got.select("tax_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cliente:string>" in plan


def test_facts_by_month(spark, make, tmp_path):
    path = str(tmp_path / "facts")
    days = [date(2026, m, d) for m in (1, 2, 3) for d in (1, 15, 28)]
    write_facts(make("orders", [dict(tax_id="1", date=d, total=Decimal(1)) for d in days]), path)
    window = DateWindow.days(date(2026, 2, 15), date(2026, 3, 1))
    got = read_facts(spark, "orders", path, window)
    assert [r[0] for r in rows(got, "date")] == [date(2026, 2, 15), date(2026, 2, 28), date(2026, 3, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(date,2026-02-15)" in plan
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_facts(got, path)


def test_snapshot_is_never_overwritten(spark, make, tmp_path):
    df = make("sellers", [dict(seller_id=1, seller_no=1)])
    path = write_snapshot(df, str(tmp_path), "v1")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_snapshot(df, str(tmp_path), "v1")


DIRTY = [
    ("1", "12", "2026-01-01", "7", "123   ", "9.994", "S ", 1),
    ("1", "12", "2026-01-01", "7", "123   ", "9.994", "S ", 1),
    ("x", "12", "2026-02-30", "7", "123", "abc", None, 2),
    (None, None, None, None, None, None, None, None),
    ("2", "9999999999", "2026-01-01", "2147483648", "123", "1e3", "N", 4),
    ("", "1", "2026-01-01", " 7 ", "", "-0.01", "", 5),
]
DIRTY_SCHEMA = "store string, document string, date string, vend string, tax_id string, total string, cancelled string, row int"


def test_sift_sets_rows_aside(spark):
    """Each row goes one way; those that fit are cast as by conform, the others keep their values and their reasons."""
    source = spark.createDataFrame(DIRTY, DIRTY_SCHEMA)
    accepted, refused = sift(source, "orders", {"seller_no": "vend"}, required=("date", "tax_id"))
    assert accepted.schema.simpleString() == schema_of("orders").simpleString()
    one = (1, Decimal(12), date(2026, 1, 1), 7, "123", Decimal("9.99"), "S")
    assert rows(accepted) == [one, one]
    got = {r["row"]["row"]: [tuple(reason) for reason in r["reasons"]] for r in refused.collect()}
    assert got == {
        2: [("store", "value", "x"), ("date", "value", "2026-02-30"), ("total", "value", "abc")],
        None: [("date", "missing", None), ("tax_id", "missing", None)],
        4: [("document", "value", "9999999999"), ("seller_no", "value", "2147483648")],
        5: [("store", "value", "")],
    }
    assert {(r["column"], r["reason"]): r["rows"] for r in refusals(refused).collect()}["store", "value"] == 2
    empty = sift(source.limit(0), "orders", {"seller_no": "vend"})
    assert [df.count() for df in empty] == [0, 0]
    with pytest.raises(ValueError, match="no column"):
        sift(source, "orders", required=("vend",))


def test_lookup_skips_row_groups(spark, make, tmp_path):
    """Ids inside the bounds of every row group are found through the Bloom filter."""
    path = str(tmp_path / "facts")
    ids = [f"{n:014d}" for n in range(0, 60_000, 2)]
    orders = spark.createDataFrame([(i,) for i in ids], "tax_id string").selectExpr(
        "1 AS store", "1 AS document", "DATE '2026-02-03' AS date", "1 AS seller_no", "tax_id", "1 AS total", "'N' AS cancelled"
    )
    write_facts(orders.repartition(1), path, row_group=32 * 1024)

    def read_rows(wanted):
        df = read_facts(spark, "orders", path, DateWindow(), wanted)
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while "Scan" not in plan.nodeName():
            plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan.children().head()
        return len(found), plan.metrics().apply("numOutputRows").value()

    assert read_rows(None) == (30_000, 30_000)
    found, scanned = read_rows([ids[n] for n in range(5, 15)])
    assert found == 10 and scanned < 15_000
    # odd numbers are between others and in no group
    found, scanned = read_rows([f"{n:014d}" for n in range(10_001, 50_001, 5_000)])
    assert found == 0 and scanned < 15_000
