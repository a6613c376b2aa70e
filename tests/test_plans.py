"""Plan shapes that must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from mascate.operators.customers import customer_directory
from mascate.operators.dedupe import best_per_key
from mascate.operators.lookup import lookup
from mascate.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_pairing(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_dates_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataValueLength", "2000")
    try:
        plan = plan_of(QUERIES["league_sales_by_seller"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataValueLength")
    orders = [s for s in re.findall(r"FileScan parquet.*", plan) if "o_totalprice" in s]
    assert orders and all("GreaterThanOrEqual(o_orderdate" in s and "LessThan(o_orderdate" in s for s in orders)
    lines = [s for s in re.findall(r"FileScan parquet.*", plan) if "l_shipdate" in s]
    assert lines and all("EqualTo(l_returnflag,R)" in s and "GreaterThanOrEqual(l_sh" in s for s in lines)
    assert all("l_quantity" not in s and "l_tax" not in s for s in lines)


def test_best_row_is_combined_before_the_shuffle(spark):
    df = spark.range(0, 40000, 1, 8).select((F.col("id") % 2).alias("k"), "id")
    best = best_per_key(df, ["k"], ["id"])
    assert [tuple(r) for r in best.orderBy("k").collect()] == [(0, 39998), (1, 39999)]
    assert re.search(r"partial_max.*", plan_of(best))


def test_hot_parent_lookup_is_split(spark):
    """A parent that holds most accounts: its rows are divided among tasks; a plain join is not."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    kept = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        accounts = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("group_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        sums = accounts.groupBy("group_id").agg(F.count("*").alias("n"))

        def split(joined):
            done = joined.agg(F.count("n"), F.sum("n"), F.max("text"))
            assert tuple(done.collect()[0])[:2] == (60000, 40000 * 40000 + 20000)
            return "skew=true" in plan_of(done)

        assert split(lookup(accounts, sums, "group_id"))
        assert not split(accounts.join(sums, "group_id", "left"))
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_keeps_a_column_of_its_marks_name(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, _mark string")
    right = spark.createDataFrame([(1, "x")], "k int, _mark_ string")
    got = lookup(left, right, "k")
    assert got.columns == ["k", "_mark", "_mark_"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "b", None)]


def test_directory_has_one_shuffle(spark, make):
    plan = plan_of(customer_directory(make("customers", [dict(customer_id=1, tax_id="1")])))
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_the_owners_of_listed_members_are_looked_up(spark):
    plan = QUERIES["top_members"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi[^\n]*\n(?:[^\n]*\n){1,6}?[^\n]*o_orderkey", plan)
    assert "strategy=broadcast" not in plan


@pytest.mark.parametrize(
    "name", ["goal_streaks_stage_seller", "deactivation_risk_seller", "birthdays_seller", "race_pacing_seller"]
)
def test_the_fallback_test_reuses_the_facts(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    plan = plan_of(df)
    assert "ReusedExchange" in plan


def test_the_history_is_not_sorted_before_the_shuffle(spark):
    plan = plan_of(QUERIES["latest_owner"](spark, SF))
    assert re.search(r"[^t]HashAggregate\(keys=[^\n]*partial_max\(", plan)
