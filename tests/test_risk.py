from datetime import date, datetime
from decimal import Decimal

from conftest import rows
from mascate.operators import risk, snapshots
from mascate.sources.tables import freeze_month, frozen_months, read_months

AS_OF = date(2026, 6, 15)
D = Decimal


def deactivation(make, **options):
    customers = make("customers", [
        dict(customer_id=1, tax_id="00000000000001", parent_id=1, name="Parent"),
        dict(customer_id=2, tax_id="00000000000002", parent_id=1, parent_tax_id="00000000000001"),
        dict(customer_id=3, tax_id="00000000000003", name="Hidden", status=9),
        dict(customer_id=4, tax_id="00000000000004", name="Big"),
        dict(customer_id=5, tax_id="00000000000005", name="Idle"),
    ])
    orders = make("orders", [
        dict(tax_id="00000000000001", date=date(2026, 4, 1), total=D("100")),
        dict(tax_id="0000000000000-2", date=AS_OF, total=D("50.50")),
        dict(tax_id="00000000000001", date=date(2026, 3, 31), total=D("9000")),
        dict(tax_id="00000000000001", date=date(2026, 6, 16), total=D("9000")),
        dict(tax_id="00000000000003", date=AS_OF, total=D("1")),
        dict(tax_id="00000000000004", date=AS_OF, total=D("3200")),
        dict(tax_id="00000000000005", date=date(2026, 5, 2), total=D("7")),
        dict(tax_id="00000000000005", date=AS_OF, total=D("8"), cancelled="S"),
        dict(tax_id="888", date=AS_OF, total=D("3199.99")),
    ])
    returns = make("returns", [
        dict(tax_id="00000000000002", date=date(2026, 6, 1), total=D("10"), cancelled="X"),
        dict(tax_id="00000000000002", date=date(2026, 5, 31), total=D("5")),
    ])
    history = make("owner_history", [
        dict(tax_id="00000000000002", seller_no=7, since=datetime(2026, 1, 1)),
        dict(tax_id="00000000000001", seller_no=8, since=datetime(2026, 1, 1)),
        dict(tax_id="00000000000003", seller_no=9, since=datetime(2026, 1, 1)),
    ])
    sellers = make("sellers", [dict(seller_id=1, seller_no=8, name="Eight")])
    return risk.deactivation_risk(orders, returns, customers, history, sellers, AS_OF, **options)


def test_deactivation(make):
    got = deactivation(make)
    assert [r.parent_tax_id for r in got.collect()] == ["00000000000005", "00000000000001", "888"]
    assert rows(got, "parent_tax_id", "name", "seller_name", "total_3m", "current_month", "zero_month", "missing") == sorted([
        ("00000000000001", "Parent", "Eight", D("135.50"), D("60.50"), False, D("3064.50")),
        ("00000000000005", "Idle", None, D("7.00"), D("0.00"), True, D("3193.00")),
        ("888", None, None, D("3199.99"), D("3199.99"), False, D("0.01")),
    ], key=repr)
    net = deactivation(make, net_current_month=True)
    assert {r.parent_tax_id: r.current_month for r in net.collect()}["00000000000001"] == D("40.50")


def test_deactivation_seller(make):
    # Only the child's movements count for its seller, and they change the sums.
    assert rows(deactivation(make, seller_no=7), "parent_tax_id", "total_3m", "current_month") == [
        ("00000000000001", D("35.50"), D("60.50"))
    ]
    # A seller whose only customer is hidden, and an unknown one: everybody.
    everybody = rows(deactivation(make))
    assert rows(deactivation(make, seller_no=9)) == everybody
    assert rows(deactivation(make, seller_no=99)) == everybody


def line(customer, day, value, **more):
    return dict(customer_id=customer, tax_id=f"{customer or 0:014d}", date=day, signed_value=D(str(value)),
                customer_name=f" C{customer} ", seller_name=" Line ", document=D(1), product=D(1), **more)


def test_active_customers(make):
    first, last = date(2025, 12, 1), date(2026, 5, 31)
    lines = make("sales_lines", [
        line(1, first, 1),
        line(2, last, "0.99"),
        line(3, date(2025, 11, 30), 50), line(3, date(2026, 6, 1), 50),
        line(4, last, 9, status=8),
        line(5, first, 9, status=8), line(5, last, 9, status=1),
        line(None, last, 9),
        line(6, last, 9),
        {**line(7, last, 1), "document": D(2), "customer_name": "New"}, line(7, last, 9),
    ])
    customers = make("customers", [
        dict(customer_id=1, area2="11", phone2="9"), dict(customer_id=1, tax_id="x", area2="12", phone2="8"),
        dict(customer_id=5, area1="1", phone1="2"),
    ])
    history = make("owner_history", [dict(tax_id="1", seller_no=1), dict(tax_id=f"{6:014d}", seller_no=1), dict(tax_id=f"{5:014d}", seller_no=2)])
    sellers = make("sellers", [dict(seller_id=1, seller_no=1, name=" Owner ")])
    got = risk.active_customers(lines, customers, history, sellers, AS_OF)
    assert [tuple(r) for r in got.select("customer_id", "name", "phone", "status", "seller_name").collect()] == [
        (1, "C1", "12 8", None, "Line"),
        (5, "C5", "1 2", 1, "Line"),  # owner without a known seller: the last line's seller
        (6, "C6", " ", None, "Owner"),
        (7, "New", " ", None, "Line"),
    ]


def record(make, **options):
    lines = make("sales_lines", [
        line(1, date(2026, 4, 1), 3200, store=1),
        line(2, date(2026, 4, 1), "3199.99", store=1), line(2, date(2026, 6, 30), "0.01", store=2),
        line(3, date(2026, 3, 31), 500, store=1), line(3, date(2026, 6, 2), 500, store=1),
        line(4, date(2026, 5, 31), -20), line(4, date(2025, 12, 1), 100), line(4, date(2025, 11, 30), 7),
        line(4, date(2026, 7, 1), 9999),
        line(5, date(2026, 5, 1), 5, status=6),
        line(None, date(2026, 5, 1), 5),
        {**line(6, date(2026, 5, 1), 0), "signed_value": None, "seller_name": None},
        {**line(7, date(2026, 5, 1), 1), "seller_name": None},
    ])
    history = make("owner_history", [dict(tax_id=f"{2:014d}", seller_no=1)])
    sellers = make("sellers", [dict(seller_id=1, seller_no=1, name=" Owner ")])
    return risk.record_risk(lines, history, sellers, date(2026, 6, 15), **options)


def test_record_risk(make):
    got = [tuple(r) for r in record(make).drop("name").collect()]
    assert got == [
        (2, "Owner", 2, D("0.01"), D("0.01"), True, D("3199.99")),
        (4, "Line", None, D("3220"), D("0"), False, D("80")),
        (7, None, None, D("3199"), D("0"), False, D("1")),
    ]
    assert [r.customer_id for r in record(make, seller_name=" Owner ").collect()] == [2]
    assert [r.customer_id for r in record(make, store=2).collect()] == [2]
    assert record(make, seller_name="").count() == 3
    assert record(make, store=9).count() == 0


def test_record_risk_summary(make):
    groups = rows(risk.record_risk_summary(record(make)))
    assert groups == sorted([
        ("seller", "Owner", 1, 1, D("0.01"), D("0.01")),
        ("seller", "Line", 1, 0, D("3220"), D("0")),
        ("seller", "(sem info)", 1, 0, D("3199"), D("0")),
        ("store", "2", 1, 1, D("0.01"), D("0.01")),
        ("store", "(sem info)", 2, 0, D("6419"), D("0")),
        ("total", "", 3, 1, D("6419.01"), D("0.01")),
    ], key=repr)
    report = risk.record_risk_report(record(make))
    assert rows(report["summary"]) == [(3, 1, D("6419.01"), D("0.01"))]
    assert report["by_seller"].count() == 3 and report["by_store"].count() == 2
    empty = risk.record_risk_report(record(make, store=9))
    assert rows(empty["summary"]) == [(0, 0, 0, 0)] and empty["by_store"].count() == 0


def test_month_snapshots(make, spark, tmp_path):
    month, root = date(2026, 6, 1), str(tmp_path / "open")
    assert frozen_months(spark, root).count() == 0
    assert freeze_month(snapshots.open_month(record(make), month), root, month)
    kept = read_months(spark, root)
    assert kept.count() == 3
    # A month that is there already adds nothing, whatever the report says now; another one does.
    assert not freeze_month(snapshots.open_month(record(make, store=9), month), root, month)
    assert read_months(spark, root).count() == 3
    assert snapshots.open_month(record(make), month, kept).count() == 0
    assert snapshots.open_month(record(make), date(2026, 7, 3), kept).count() == 3
    # An empty month is frozen too.
    july = date(2026, 7, 1)
    assert freeze_month(snapshots.open_month(record(make, store=9), july), root, july)
    assert not freeze_month(snapshots.open_month(record(make), july), root, july)
    assert rows(frozen_months(spark, root)) == [(month,), (july,)] and read_months(spark, root).count() == 3

    ending = record(make).where("customer_id <> 4")
    closed = snapshots.close_month(kept, ending, month)
    assert rows(closed, "customer_id", "seller_name", "store", "realised", "reached") == sorted([
        (2, "Owner", 2, D("0.01"), True), (4, "Line", None, D("0"), False), (7, None, None, D("0"), False),
    ], key=repr)
    groups = snapshots.month_groups(snapshots.current_month(kept, ending, month))
    assert rows(groups.where("grouped_by = 'total'"), "customers", "reached", "realised") == [(3, 1, D("0.01"))]
    ends = str(tmp_path / "closed")
    assert snapshots.oldest_open_month(frozen_months(spark, root), frozen_months(spark, ends)) == month
    assert freeze_month(closed, ends, month)
    assert snapshots.oldest_open_month(frozen_months(spark, root), frozen_months(spark, ends)) == july
    done = read_months(spark, ends)
    assert snapshots.close_month(kept, ending, month, done).count() == 0
    assert [r.customer_id for r in snapshots.history_of(done, month=month, seller_name="Owner").collect()] == [2]
    assert snapshots.history_of(done, month=date(2026, 5, 1)).count() == 0
    assert snapshots.history_of(done, store=2).count() == 1


def test_empty_summary_has_its_total(make):
    nothing = risk.record_risk(
        make("sales_lines", []), make("owner_history", []), make("sellers", []), AS_OF, ordered=False
    )
    assert rows(risk.record_risk_summary(nothing)) == [("total", "", 0, 0, D(0), D(0))]
    assert rows(risk.record_risk_report(nothing)["summary"]) == [(0, 0, D(0), D(0))]
