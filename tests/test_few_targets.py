"""Reports on few targets give what the reports on all give for them, and cut the facts as they are scanned."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest

from conftest import rows
from mascate.operators import few_targets, ledger, members, owners
from mascate.plans.driver_tables import Roles

AS_OF = date(2026, 6, 15)
IDS = ["1", "2", "00000000000003", "0-4", "00000000000005", "6", "", None]


@pytest.fixture
def tables(make):
    rng = random.Random(8)
    pick = lambda *values: rng.choice(values)
    customers = [
        dict(
            customer_id=pick(1, 2, 3, 4, 5, 6, 7, None),
            tax_id=rng.choice(IDS),
            parent_tax_id=rng.choice(IDS),
            parent_id=pick(1, None),
            status=pick(None, 1, 9),
            phone2=pick("9", None),
            area2="11",
        )
        for _ in range(30)
    ]
    facts = [
        dict(tax_id=rng.choice(IDS), date=date(2026, rng.randrange(1, 7), 3), total=Decimal(n), cancelled=pick("N", None, "S"))
        for n in range(200)
    ]
    history = [dict(tax_id=rng.choice(IDS), seller_no=rng.randrange(3), since=datetime(2026, 1, n + 1)) for n in range(20)]
    sellers = [dict(seller_id=n, seller_no=n, name=f"s{n}") for n in range(3)]
    roster = [dict(member_no=n, tax_id=rng.choice(IDS), active=pick("S", "N")) for n in range(9)]
    details = [dict(member_no=n, plan_code=n, tax_id=rng.choice(IDS), name=f"m{n}") for n in range(9)]
    return {
        "customers": make("customers", customers),
        "orders": make("orders", facts[:120]),
        "returns": make("returns", facts[120:]),
        "history": make("owner_history", history),
        "sellers": make("sellers", sellers),
        "roster": make("league_roster", roster),
        "details": make("league_members", details),
    }


ASKED = [("1",), ("00000000000003",), ("4",), ("77",), ("1",), (None,)]


def test_same_net_purchases(spark, tables):
    targets = spark.createDataFrame(ASKED, "tax_id string")
    args = [targets, *[tables[n] for n in ("customers", "orders", "returns", "history", "sellers")], AS_OF]
    for options in ({}, {"seller_no": 1}):
        want = rows(ledger.net_purchases(*args, **options))
        assert rows(few_targets.net_purchases(*args, **options)) == want and want
    # more targets than are few, and more accounts
    for most in (2, 5):
        assert rows(few_targets.net_purchases(*args, most=most)) == rows(ledger.net_purchases(*args))


def test_same_profiles(spark, tables):
    targets = spark.createDataFrame(ASKED, "tax_id string")
    args = [targets, tables["customers"], tables["roster"], tables["details"]]
    want = rows(members.member_profile(*args))
    assert rows(few_targets.member_profile(*args)) == want
    assert rows(few_targets.member_profile(*args, most=1)) == want


def test_same_owners(spark, tables):
    targets = spark.createDataFrame(ASKED, "tax_id string")
    every = rows(owners.latest_owner(tables["history"], tables["sellers"]))
    want = [row for row in every if row[0] in ("1", "00000000000003", "4", "77")]
    for most in (few_targets.FEW, 1):
        assert rows(few_targets.owners_of(targets, tables["history"], tables["sellers"], most)) == want


def test_facts_are_cut_before_they_are_summed(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    targets = r.targets().orderBy("tax_id").limit(3)
    args = (targets, r.customers(), r.orders(), r.returns(), r.history(), r.sellers(), date(2000, 6, 15))
    plan = few_targets.net_purchases(*args)._jdf.queryExecution().executedPlan().toString()
    # from the sum of the facts down to the first scan below it: a semi-join and no shuffle
    below = plan[plan.rindex("partial_sum(value") :]
    below = below[: below.index("FileScan")]
    assert "BroadcastHashJoin" in below and "LeftSemi" in below and "Exchange hashpartitioning" not in below
