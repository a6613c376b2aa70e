import random
from datetime import date, datetime
from decimal import Decimal

from conftest import rows
from test_ledger import digits, pad
from mascate.operators import league, members

D = Decimal
AS_OF = date(2026, 2, 10)


def t(n):
    return f"{n:014d}"


def owners(make):
    history = make("owner_history", [dict(tax_id=t(1), seller_no=7, since=datetime(2026, 1, 1))])
    return history, make("sellers", [dict(seller_id=1, seller_no=7, name="Seven")])


def test_top_members(make):
    customers = make("customers", [
        dict(customer_id=1, tax_id=t(1), parent_id=1, parent_tax_id=t(1), name="P1"),
        dict(customer_id=2, tax_id=t(2), parent_id=1, parent_tax_id=t(1), name="Child"),
        dict(customer_id=3, tax_id=t(3), parent_id=3, parent_tax_id=t(3), name="Hidden", status=8),
        dict(customer_id=4, tax_id=t(4), parent_id=3, parent_tax_id=t(3), name="Child of hidden"),
        dict(customer_id=5, tax_id="5", parent_id=5, parent_tax_id="5", name="Short"),
        *[dict(customer_id=n, tax_id=t(n), parent_id=n, parent_tax_id=t(n), name=f"N{n}") for n in range(10, 60)],
    ])
    detail = make("league_members", [dict(member_no=n, tax_id=str(n)) for n in [1, 2, 3, 4, 5, *range(10, 60)]])
    ranking = make("ranking", [
        dict(member_no=2, position=1, value=D(900)), dict(member_no=1, position=5, value=D(500)),
        dict(member_no=4, position=2, value=D(800)), dict(member_no=5, position=3, value=D(700)),
        dict(member_no=99, position=4, value=D(600)), dict(member_no=10, position=None, value=D(10000)),
        *[dict(member_no=n, position=n, value=D(n)) for n in range(11, 60)],
    ])
    got = members.top_members(ranking, detail, customers, *owners(make)).collect()
    assert len(got) == 30
    # The parent is preferred to its better placed child; a hidden parent hides its child.
    assert [(r.position, r.tax_id, r.name) for r in got[:4]] == [
        (3, t(5), None), (4, None, None), (5, t(1), "P1"), (11, t(11), "N11"),
    ]
    assert {r.mine for r in got} == {False} and got[2].seller_no == 7
    marked = members.top_members(ranking, detail, customers, *owners(make), seller_no=7, size=100).collect()
    assert len(marked) == 53
    assert [r.mine for r in marked[:3]] == [None, None, True]
    assert (marked[-1].position, marked[-1].tax_id) == (None, t(10))


def test_birthdays(make):
    def customer(n, born, **more):
        return {**dict(customer_id=n, tax_id=t(n), parent_tax_id=t(n), parent_name=f" P{n} ", parent_birth=born), **more}

    customers = make("customers", [
        customer(1, date(2000, 2, 29), parent_area2="11", parent_phone2="9"),
        customer(2, date(1990, 2, 1)),
        customer(3, date(1990, 1, 31)), customer(4, date(1990, 3, 1)), customer(5, None),
        customer(6, date(1990, 2, 5), status=6), customer(7, date(1990, 2, 5), parent_status=95),
        customer(9, date(1990, 2, 8), parent_tax_id=t(8)), customer(8, date(1990, 2, 7), parent_tax_id=t(8)),
    ])
    got = members.birthdays(customers, *owners(make), AS_OF)
    assert [(r.parent_tax_id, r.name, r.day, r.days_to_month, r.seller_name, r.phone) for r in got.collect()] == [
        (t(2), "P2", 1, -9, None, " "), (t(8), "P8", 7, -9, None, " "), (t(1), "P1", 29, -9, "Seven", "11 9"),
    ]
    assert all(r.in_month and r.is_parent for r in got.collect())
    mine = members.birthdays(customers, *owners(make), AS_OF, seller_no=7)
    assert rows(mine, "parent_tax_id") == [(t(1),)]
    assert rows(members.birthdays(customers, *owners(make), AS_OF, seller_no=3)) == rows(got)


def test_roster_list(make):
    customers = make("customers", [
        dict(customer_id=1, tax_id=t(1), parent_tax_id=t(1), area1="1", phone1="2"),
        dict(customer_id=2, tax_id=t(2), parent_tax_id=t(1)),
        dict(customer_id=3, tax_id=t(3), status=8),
        dict(customer_id=4, tax_id="4", status=8),
    ])
    roster = make("league_roster", [dict(tax_id=x, active="S") for x in (t(1), "2", t(3), "4", "5", "6")]
                  + [dict(tax_id=t(7), active="N"), dict(tax_id=t(8))])
    detail = make("league_members", [
        dict(plan_code=1, member_no=1, tax_id=t(1), name=" A ", plan="gold", plan_end=datetime(2026, 1, 5), stars=3, points=1.5),
        dict(plan_code=2, member_no=2, tax_id=t(2), plan_end=datetime(2026, 2, 5), plan_start=datetime(2025, 2, 5)),
        dict(plan_code=3, member_no=2, tax_id=t(2)),
        dict(plan_code=4, tax_id=t(3)), dict(plan_code=5, tax_id="4"), dict(plan_code=6, tax_id="0000000000-0005"),
        dict(plan_code=7, tax_id=t(7)),
    ])
    got = members.roster_list(roster, detail, customers)
    # Own id is matched unpadded, so the hidden account "4" hides the member stored as "4".
    assert rows(got, "plan_code", "tax_id", "phone", "stars", "points", "plan_start", "plan_end") == sorted([
        (2, t(2), " ", 0, 0.0, "05/02/2025", "05/02/2026"), (6, t(5), None, 0, 0.0, None, None),
    ], key=repr)


HIDDEN = {6, 8, 9, 95}


def profile_of(target, customers, roster, detail):
    """One tax id at a time, straight from the definition."""
    own = digits(target or "").rjust(14, "0")
    homes = sorted((c for c in customers if pad(c["tax_id"]) == own), key=lambda c: c["customer_id"])

    def parent(c):
        return pad(c["parent_tax_id"] or c["tax_id"])

    group = {own}
    if homes:
        group |= {pad(c["tax_id"]) for c in customers if parent(c) == parent(homes[0]) and c["status"] not in HIDDEN}
    active = {pad(r["tax_id"]) for r in roster if r["active"] == "S"}
    found = [m for m in detail if pad(m["tax_id"]) in group]
    oldest = datetime(1900, 1, 1)
    best = max(found, key=lambda m: (pad(m["tax_id"]) == own, m["changed"] or oldest, m["plan_code"])) if found else None
    phones = [c for c in customers if pad(c["tax_id"]) in group and c["status"] not in HIDDEN]
    phone = None
    if phones:
        c = max(phones, key=lambda c: (pad(c["tax_id"]) == own, c["phone2"] == "9", -c["customer_id"]))
        phone = " 9" if c["phone2"] == "9" else f" {c['phone1']}"
    inside = bool(group & active)
    status = "ativa" if inside else "ja_esteve" if best else "nunca"
    shown = digits(best["tax_id"]) if best else own.lstrip("0")
    balance = (best["points"] or 0) - (best["purchases_7m"] or 0) + (best["current_month"] or 0) if best else 0
    return (own, shown, best["name"] if best else None, phone, inside, status, float(balance))


def test_member_profile_one_by_one(make, spark):
    rng = random.Random(11)
    ids = [t(n) for n in range(15)] + ["3", "000000-00000004", "123456789012345"]
    customers = [dict(customer_id=i, tax_id=rng.choice(ids), parent_tax_id=rng.choice([None, "", t(1), "1", t(2)]),
                      status=rng.choice([None, 1, 8]), phone1=str(i), phone2=rng.choice(["9", "0", None])) for i in range(25)]
    roster = [dict(tax_id=rng.choice(ids), active=rng.choice("SN")) for _ in range(4)]
    detail = [dict(plan_code=i, member_no=i, tax_id=rng.choice(ids), name=f"m{i}", points=rng.choice([None, float(i)]),
                   purchases_7m=rng.choice([None, 2.0]), current_month=1.0,
                   changed=rng.choice([None, datetime(2026, 1, 1), datetime(2026, 1, 2)])) for i in range(9)]
    asked = [*ids, "99", "", "1234567890123456"]
    got = members.member_profile(
        spark.createDataFrame([(a,) for a in asked], "tax_id STRING"),
        make("customers", customers), make("league_roster", roster), make("league_members", detail),
    )
    want = {profile_of(a, customers, roster, detail) for a in asked}
    assert {w[5] for w in want} == {"ativa", "ja_esteve", "nunca"}
    assert rows(got, "target", "tax_id", "name", "phone", "in_league", "status", "balance") == sorted(want, key=repr)


def test_league_sales(make):
    roster = make("league_roster", [
        dict(tax_id="1", entered=date(2025, 1, 1), active="N"), dict(tax_id="0-1", entered=date(2026, 6, 1)),
        dict(tax_id="1", entered=date(2026, 6, 1)), dict(tax_id="2"), dict(tax_id="3", entered=date(2026, 5, 31)),
    ])

    def move(tax, day, total, seller=1, cancelled=None):
        return dict(tax_id=tax, date=date(2026, 6, day), total=D(str(total)), seller_no=seller, cancelled=cancelled)

    orders = make("orders", [move("1", 1, 10), move("2", 10, 5), move("3", 10, 3, 2), move("1", 11, 99), move("1", 5, 7, 3),
                             move("9", 5, 99), move("2", 5, 50, 1, "S"), move("3", 5, 1, 2, "X"), move("0-1", 5, 2, 2)])
    returns = make("returns", [move("1", 2, 4), move("1", 2, 4, 1, "X"), move("2", 2, 1, 2, "N")])
    sellers = make("sellers", [dict(seller_id=1, seller_no=1, name="a"), dict(seller_id=2, seller_no=2, name="b"),
                               dict(seller_id=3, seller_no=2, name="c")])
    as_of = date(2026, 6, 10)
    got = league.league_sales_by_seller(roster, orders, returns, sellers, as_of)
    assert [tuple(r) for r in got.collect()] == [
        (1, 1, "a", D("11.00"), D("6.00")),
        (2, 2, "b", D("5.00"), D("2.00")), (3, 2, "c", D("5.00"), D("2.00")),  # a number held twice counts twice
    ]
    assert rows(league.league_goal_status(got)) == [(D(1600000), D("21.00"), False, D("1599979.00"))]
    assert rows(league.league_goal_status(got, 21)) == [(D(21), D("21.00"), True, D(0))]
    none = league.league_sales_by_seller(roster, orders, returns, sellers, date(2020, 1, 1))
    assert rows(league.league_goal_status(none, 5)) == [(D(5), D(0), False, D(5))]
    wide = league.league_sales_by_seller(roster, orders, returns, sellers, as_of, end=date(2026, 6, 11), new_since=date(2026, 7, 1))
    assert wide.first().league_sales == D("110.00") and wide.first().new_member_sales == 0


def test_roster_blocks(make):
    roster = make("league_roster", [dict(tax_id="1", active="S", entered=date(2026, 1, 1)), dict(tax_id="0-1", active="S"),
                                    dict(tax_id="00000000000001", active="S"), dict(tax_id="2", active="N", entered=date(2025, 1, 1)),
                                    dict(tax_id="2", entered=date(2025, 3, 1)), dict(tax_id="3", active="s")])
    assert rows(members.active_roster(roster)) == [(t(1),)]
    assert rows(members.member_since(roster)) == sorted([
        ("1", date(2026, 1, 1)), ("01", None), (t(1), None), ("2", date(2025, 3, 1)), ("3", None)], key=repr)


def test_a_figure_that_is_no_number_is_zero(make, spark):
    nan = float("nan")
    detail = make("league_members", [dict(plan_code=1, member_no=1, tax_id="1", points=nan, purchases_7m=nan, discount_pct=nan)])
    roster = make("league_roster", [dict(tax_id="1", active="S")])
    nobody = make("customers", [])
    targets = spark.createDataFrame([("1",)], "tax_id STRING")
    profile = members.member_profile(targets, nobody, roster, detail)
    assert rows(profile, "points", "purchases_7m", "balance", "message") == [(0.0, 0.0, 0.0, "Ativa na Liga.")]
    assert rows(members.roster_list(roster, detail, nobody), "points", "discount_pct") == [(0.0, 0.0)]
