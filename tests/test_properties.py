"""Relations between reports that hold on any data, checked on the driver tables."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mascate.operators import customers as cust
from mascate.operators import ledger, owners
from mascate.plans import registry
from mascate.plans.driver_tables import Roles
from mascate.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_net_is_orders_minus_returns(spark):
    r = Roles(spark, SF)
    valid = r.orders().where(ledger.not_cancelled(F.col("cancelled")))
    back = r.returns().where(ledger.never_cancelled(F.col("cancelled")))
    total = F.sum("total")
    net = ledger.net_ledger(r.orders(), r.returns()).agg(F.sum("value")).first()[0]
    assert net == valid.agg(total).first()[0] - back.agg(total).first()[0]


def test_groups_add_up_to_the_total(spark):
    summary = QUERIES["record_risk_summary"](spark, SF).drop("group_name")
    sums = summary.groupBy("grouped_by").agg(
        *[F.round(F.sum(c), 2).alias(c) for c in ("customers", "reached", "needed", "realised")]
    )
    found = {r[0]: tuple(r)[1:] for r in sums.collect()}
    assert found["seller"] == found["store"] == found["total"]


@pytest.mark.parametrize("key, build", [
    ("tax_digits", lambda r: cust.customer_directory(r.customers())),
    ("tax_digits", lambda r: owners.latest_owner(r.history(), r.sellers())),
    ("target", lambda r: cust.target_groups(r.targets(), r.customers())),
])
def test_keys_are_unique(spark, key, build):
    df = build(Roles(spark, SF))
    assert df.count() == df.select(key).distinct().count()


@pytest.mark.parametrize("name", ["race_pacing", "birthdays", "deactivation_risk"])
def test_fallback_is_the_unfiltered_report(spark, name):
    assert rows(QUERIES[f"{name}_seller_fallback"](spark, SF)) == rows(QUERIES[name](spark, SF))


def test_a_filtered_race_is_a_part_of_the_race(spark):
    mine, everyone = (rows(QUERIES[n](spark, SF)) for n in ("race_pacing_seller", "race_pacing"))
    assert 0 < len(mine) < len(everyone) and set(mine) < set(everyone)


class Shuffled(Roles):
    """The same tables with their rows in another order and other partitions."""

    def table(self, name):
        return super().table(name).repartition(5).orderBy(F.rand(17))


@pytest.mark.parametrize("name", [
    "net_purchases_seller", "active_customers", "record_risk", "member_profile", "roster_list",
    "top_members_seller", "user_change_conflicts", "latest_owner",
])
def test_row_order_does_not_matter(spark, monkeypatch, name):
    want = rows(QUERIES[name](spark, SF))
    monkeypatch.setattr(registry, "Roles", Shuffled)
    assert rows(QUERIES[name](spark, SF)) == want
