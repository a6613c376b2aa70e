import os
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from conftest import rows
from mascate.functions.calendar import DateWindow
from mascate.operators import ledger, month_records, newest, risk
from mascate.sources import month_store
from mascate.sources.shared import shared_folder
from mascate.sources.tables import freeze_month, frozen_months, read_months

AS_OF = date(2026, 6, 15)
D = Decimal


def random_lines(rng, count):
    days = [date(2025, 11, 25) + timedelta(days=n) for n in range(0, 225, 3)]
    pick = lambda *values: rng.choice(values)
    return [
        dict(
            customer_id=pick(None, 1, 1, 1, 1, 2, 3, 4, 5, 6, 7),
            date=rng.choice(days),
            document=pick(None, D(1), D(2), D(-3)),
            product=pick(None, D(0), D(5)),
            signed_value=pick(None, D("10.5"), D("-3"), D("1200"), D("0.01")),
            customer_name=pick("A", " B ", None),
            tax_id=pick("1", "2", "0-3", None),
            status=pick(None, 1, 8),
            seller_name=pick("x", " y", None),
            store=pick(1, 2, None),
        )
        for _ in range(count)
    ]


def random_movements(rng, count):
    days = [date(2026, 2, 20) + timedelta(days=n) for n in range(125)]
    return [
        dict(
            tax_id=rng.choice(["1", "00000000000002", "0-3", "44", None]),
            date=rng.choice([*days, None]),
            total=rng.choice([None, D("0.00"), D("15.25"), D("900")]),
            cancelled=rng.choice([None, "N", "S", "X"]),
        )
        for _ in range(count)
    ]


@pytest.fixture
def people(make):
    customers = make("customers", [
        dict(customer_id=1, tax_id="1", parent_id=1, name="One"),
        dict(customer_id=2, tax_id="00000000000002", parent_id=1, parent_tax_id="1", name="Two"),
        dict(customer_id=3, tax_id="44", name="Four", status=9),
    ])
    history = make("owner_history", [
        dict(tax_id="1", seller_no=7, since=datetime(2026, 1, 1)), dict(tax_id="2", seller_no=8, since=datetime(2026, 1, 1)),
    ])
    sellers = make("sellers", [dict(seller_id=1, seller_no=7, name=" Seven ")])
    return customers, history, sellers


def store_of(spark, root, batches, records, merged):
    for number, batch in enumerate(batches):
        assert month_store.add(records(*batch), root, merged, f"batch {number}")
    return month_store.read(spark, root)


def test_line_reports_from_the_store(spark, make, people, tmp_path):
    customers, history, sellers = people
    lines = random_lines(random.Random(1), 500)
    whole = make("sales_lines", lines)
    batches = [(make("sales_lines", part),) for part in (lines[:200], lines[200:450], lines[450:])]
    stored = store_of(spark, str(tmp_path), batches, month_records.line_records, month_records.merged_lines)
    assert rows(month_records.active_customers(stored, customers, history, sellers, AS_OF)) == rows(
        risk.active_customers(whole, customers, history, sellers, AS_OF)
    )
    assert rows(month_records.record_risk(stored, history, sellers, AS_OF, minimum=2000)) == rows(
        risk.record_risk(whole, history, sellers, AS_OF, minimum=2000)
    )


def test_movement_reports_from_the_store(spark, make, people, tmp_path):
    customers, history, sellers = people
    rng = random.Random(3)
    orders, returns = random_movements(rng, 300), random_movements(rng, 200)
    batches = [
        (make("orders", orders[a:b]), make("returns", returns[c:d]))
        for a, b, c, d in ((0, 200, 0, 20), (200, 300, 20, 20), (0, 0, 20, 200))
    ]
    stored = store_of(spark, str(tmp_path), batches, month_records.movement_records, month_records.merged_movements)
    orders, returns = make("orders", orders), make("returns", returns)
    facts = (orders, returns, customers, history, sellers, AS_OF)
    for now in (False, True):
        got = month_records.deactivation_risk(stored, *facts, minimum=100_000, net_current_month=now)
        assert rows(got) == rows(risk.deactivation_risk(*facts, minimum=100_000, net_current_month=now))
    targets = spark.createDataFrame([("1",), ("2",), ("44",), ("77",)], "tax_id string")
    windows = [dict(month="2026-04"), dict(start=date(2026, 3, 5), end=date(2026, 3, 20)), dict(start=date(2026, 2, 28))]
    windows += [dict(start=date(2026, 3, 5), end=AS_OF, seller_no=8)]
    for window in windows:
        got = month_records.net_purchases(stored, targets, customers, orders, returns, history, sellers, AS_OF, **window)
        want = ledger.net_purchases(targets, customers, orders, returns, history, sellers, AS_OF, **window)
        assert rows(got) == rows(want), window


def records(make, *days):
    lines = [dict(customer_id=1, date=day, signed_value=D(1), document=D(n)) for n, day in enumerate(days)]
    return month_records.line_records(make("sales_lines", lines))


def value_of(spark, root):
    return {row["month"].month: int(row["value"]) for row in month_store.read(spark, root).collect()}


def test_only_touched_months_are_written(spark, make, tmp_path):
    root, merge = str(tmp_path), month_records.merged_lines
    may, june = date(2026, 5, 3), date(2026, 6, 3)
    assert month_store.add(records(make, may, june, june), root, merge, "a")
    before = dict(rows(month_store.stored_months(spark, root)))
    assert month_store.add(records(make, june), root, merge, "b")
    after = dict(rows(month_store.stored_months(spark, root)))
    assert before[date(2026, 5, 1)] == after[date(2026, 5, 1)] and before[date(2026, 6, 1)] != after[date(2026, 6, 1)]
    assert os.listdir(f"{root}/rows/run={after[date(2026, 6, 1)]}") .count("month=2026-05-01") == 0
    assert value_of(spark, root) == {5: 1, 6: 3}
    # a batch that comes again, and an empty one
    assert not month_store.add(records(make, june), root, merge, "b")
    assert month_store.add(records(make), root, merge, "c") and not month_store.add(records(make), root, merge, "c")
    assert value_of(spark, root) == {5: 1, 6: 3}
    window = DateWindow(date(2026, 6, 1), date(2026, 7, 1))
    plan = month_store.read(spark, root, window)._jdf.queryExecution().executedPlan().toString()
    assert "month=2026-05" not in plan and month_store.read(spark, root, window).count() == 1
    assert month_store.read(spark, root, DateWindow(date(2027, 1, 1), None)).count() == 0


def test_two_runs_at_once(spark, make, tmp_path):
    root, merge, june = str(tmp_path), month_records.merged_lines, date(2026, 6, 3)
    month_store.add(records(make, june), root, merge, "a")
    first = month_store.prepare(records(make, june), root, merge, "b")
    second = month_store.prepare(records(make, june, june), root, merge, "c")
    assert month_store.commit(spark, root, second)
    assert not month_store.commit(spark, root, first)
    assert value_of(spark, root) == {6: 3}
    assert month_store.add(records(make, june), root, merge, "b")
    assert value_of(spark, root) == {6: 4}


def test_an_empty_store_says_so(spark, tmp_path):
    with pytest.raises(ValueError, match="no month"):
        month_store.read(spark, str(tmp_path))


def test_frozen_month_stays_when_runs_interleave(spark, make, tmp_path, monkeypatch):
    """A second run that looked before the first one's entry writes, enters, and loses."""
    from mascate.sources import tables

    root, june = str(tmp_path), date(2026, 6, 1)
    mine, other = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,), (3,)], "a int")
    enter = tables.append_entry

    def meanwhile(rows_, root_):
        monkeypatch.setattr(tables, "append_entry", enter)
        assert freeze_month(other, root, june)
        enter(rows_, root_)

    monkeypatch.setattr(tables, "append_entry", meanwhile)
    assert not freeze_month(mine, root, june)
    assert sorted(r["a"] for r in read_months(spark, root).collect()) == [2, 3]
    assert rows(frozen_months(spark, root)) == [(june,)]


def test_store_without_months(spark, tmp_path):
    assert frozen_months(spark, str(tmp_path)).count() == 0
    empty = read_months(spark, str(tmp_path), "a int")
    assert empty.columns == ["a", "month"] and empty.count() == 0


def test_line_numbers_sort_like_their_parts(spark, make):
    rng = random.Random(5)
    lines = random_lines(rng, 300) + [dict(date=date(1, 1, 1), document=D(-999999999)), dict(date=date(9999, 12, 31))]
    frame = make("sales_lines", lines)
    got = frame.select(newest.line_number(frame).alias("n"), "date", "document", "product").distinct().orderBy("n").collect()
    low = lambda x: (x is not None, x or 0)
    assert [tuple(r)[1:] for r in got] == sorted((tuple(r)[1:] for r in got), key=lambda r: (r[0], low(r[1]), low(r[2])))
    with pytest.raises(ValueError, match="too many digits"):
        newest.line_number(frame.selectExpr("date", "1L AS document", "2L AS product"))


def test_lines_are_hashed_before_the_first_shuffle(spark, make, people):
    """No sort of the sales lines on the map side: their sums and newest number go through a hash aggregate."""
    _, history, sellers = people
    lines = make("sales_lines", random_lines(random.Random(1), 50))
    plan = risk.record_risk(lines, history, sellers, AS_OF)._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "partial_max(newest" in line]
    assert partial and all("HashAggregate" in line and "Sort" not in line for line in partial)


def test_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
