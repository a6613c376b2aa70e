"""Goal pacing in a race, streaks of periods on goal, and the global goal."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mascate.functions.calendar import first_of_month
from mascate.functions.keys import tax_id14, visible
from mascate.operators.customers import customer_directory
from mascate.operators.fallback import with_fallback
from mascate.operators.lookup import lookup
from mascate.operators.owners import flag_owned, latest_owner

# The stars of a finished race, the share of the expected amount that is still
# yellow, the streak lengths reported, and the traffic-light names.
FULL_STARS = 20
YELLOW_SHARE = "0.95"
STREAK_LENGTHS = (4, 5)
GREEN, YELLOW, RED = "verde", "amarelo", "vermelho"


def _with_member(
    df: DataFrame,
    members: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
) -> DataFrame:
    """Add member name and tax id, the directory row of the padded tax id, and the parent's owner.

    The directory key is not padded, so accounts stored with a short id have no match.
    """
    detail = members.select(
        "member_no",
        F.trim("name").alias("name"),
        "tax_id",
        tax_id14(F.col("tax_id")).alias("tax_id14"),
    )
    directory = customer_directory(customers).select(
        F.col("tax_digits").alias("tax_id14"), "is_parent", "parent_tax_id14", "phone", "status"
    )
    owner = latest_owner(history, sellers).withColumnRenamed("tax_digits", "parent_tax_id14")
    people = lookup(df.join(detail, "member_no", "left"), directory, "tax_id14")
    return lookup(people.where(visible(F.col("status"))), owner, "parent_tax_id14")


def race_pacing(
    race_purchases: DataFrame,
    race_goals: DataFrame,
    race_prizes: DataFrame,
    members: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    seller_no: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Members of the races open on ``as_of``: stars, shortfall, expected amount, traffic light.

    A member with a prize of any race is left out. The race length does not count its last day but
    the days elapsed do, so the expected amount passes the goal on the last day. An unknown star
    value gives full stars; a race of no length or a star value of zero gives NULL figures.
    """
    today = F.lit(as_of)
    races = race_goals.where((F.col("start") <= today) & (F.col("end") >= today)).select(
        "start", "end", "goal", "star_value"
    )
    runners = (
        race_purchases.select("member_no", "start", "end", "total")
        .join(races, ["start", "end"])
        .join(race_prizes.select("member_no"), "member_no", "left_anti")
    )
    people = _with_member(runners, members, customers, history, sellers)
    people = flag_owned(people, "tax_id14", history, seller_no)
    if seller_no is None:
        people = people.drop("owned")
    else:
        shown = ["member_no", "name", "tax_id", "phone", "seller_no", "seller_name", "total", "goal", "star_value"]
        people = with_fallback(people.select(*shown, "start", "end", "owned"), "owned", whole=True)

    length = F.datediff("end", "start")
    elapsed = F.datediff(F.least(today, F.col("end")), F.col("start")) + 1
    stars = F.when(F.col("star_value") == 0, None).otherwise(
        F.least(
            F.lit(FULL_STARS), F.floor(F.try_divide(F.col("total"), F.col("star_value")))
        ).cast("int")
    )
    # The light compares products of decimals, so no division can tip a total that is exactly due.
    paid = F.col("total") * length
    due = F.col("goal") * elapsed
    colour = (
        F.when(length == 0, None)
        .when(paid >= due, GREEN)
        .when(paid >= due * F.lit(YELLOW_SHARE).cast("decimal(3,2)"), YELLOW)
        .otherwise(RED)
    )
    result = people.select(
        "member_no",
        "name",
        "tax_id",
        "phone",
        "seller_no",
        "seller_name",
        F.round("total", 2).alias("realised"),
        stars.alias("stars"),
        (F.lit(FULL_STARS) - stars).alias("missing_stars"),
        F.greatest(
            F.lit(0).cast("decimal(12,2)"), F.round(F.col("goal") - F.col("total"), 2)
        ).alias("to_goal"),
        F.round(F.try_divide(F.col("goal"), length), 2).alias("daily_goal"),
        elapsed.alias("days_elapsed"),
        F.round(F.try_divide(due, length), 2).alias("expected"),
        colour.alias("colour"),
    )
    if ordered:
        result = result.orderBy(
            F.col("missing_stars").asc_nulls_last(),
            F.col("realised").desc_nulls_first(),
            F.col("member_no").asc(),
        )
    return result


def period_ranks(goals: DataFrame, last_period: date) -> DataFrame:
    """Periods with a goal up to ``last_period``, numbered from 1: ``period, goal, rank, is_last``.

    One row per calendar month (or day) is enforced first, so the window without a partition sorts
    a few thousand rows at most, whatever the size of the facts.
    """
    in_order = Window.orderBy("period")
    return (
        goals.where(F.col("period") <= F.lit(last_period))
        .groupBy("period")
        .agg(F.max("goal").alias("goal"))
        .withColumn("rank", F.row_number().over(in_order))
        .withColumn("is_last", F.lead("period").over(in_order).isNull())
    )


def islands(df: DataFrame, keys: list[str], rank: str, *values: Column) -> DataFrame:
    """Runs of consecutive ranks per key: the aggregates ``values`` over each run.

    Both steps use the partitioning of ``keys``: one shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    runs = df.withColumn("_run", F.col(rank) - place)
    return runs.groupBy(*keys, "_run").agg(*values).drop("_run")


def _goal_runs(purchases: DataFrame, goals: DataFrame, last_period: date) -> DataFrame:
    """The rows of :func:`goal_islands` with the total and goal of each run's last period."""
    hits = (
        purchases.join(F.broadcast(period_ranks(goals, last_period)), "period")
        .where(F.col("total") >= F.col("goal"))
        .select("member_no", "rank", "period", "total", "goal", "is_last")
    )
    return islands(
        hits,
        ["member_no"],
        "rank",
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count("*").cast("int").alias("length"),
        F.max("is_last").alias("is_current"),
        F.max_by("total", "rank").alias("last_total"),
        F.max_by("goal", "rank").alias("last_goal"),
    )


def goal_islands(purchases: DataFrame, goals: DataFrame, last_period: date) -> DataFrame:
    """Every maximal run of goal periods in which a member reached the goal.

    ``purchases`` is ``member_no, period, total`` with one row per member and period; ``goals`` is
    ``period, goal``. Periods without a goal do not break a run. Gives ``member_no, first_period,
    last_period, length, is_current``; current runs end at the last goal period.

    The ranked goals are broadcast: they hold one row per calendar period.
    """
    return _goal_runs(purchases, goals, last_period).drop("last_total", "last_goal")


def goal_streaks(
    purchases: DataFrame,
    goals: DataFrame,
    members: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    stage: int | None = None,
    seller_no: int | None = None,
    unit: str = "month",
    ordered: bool = True,
) -> DataFrame:
    """Members whose current run on goal has length 4 or 5, or the one length given by ``stage``."""
    if stage is not None and stage not in STREAK_LENGTHS:
        raise ValueError(f"stage must be one of {STREAK_LENGTHS}, got {stage!r}")
    if unit not in ("month", "day"):
        raise ValueError(f"unit must be 'month' or 'day', got {unit!r}")
    last_period = first_of_month(as_of) if unit == "month" else as_of
    lengths = STREAK_LENGTHS if stage is None else (stage,)

    # A current run ends at the last goal period: its last goal and total are the current ones.
    runs = _goal_runs(purchases, goals, last_period).where(
        F.col("is_current") & F.col("length").isin(*lengths)
    )
    people = _with_member(runs, members, customers, history, sellers).where(
        F.coalesce("is_parent", F.lit(True))
    )
    people = flag_owned(people, "tax_id14", history, seller_no)
    people = with_fallback(people, "owned") if seller_no is not None else people.drop("owned")
    goal, bought = F.col("last_goal"), F.col("last_total")
    result = people.select(
        "member_no",
        "name",
        "tax_id",
        "phone",
        "seller_no",
        "seller_name",
        "length",
        F.round(goal, 2).alias("goal"),
        F.round(bought, 2).alias("bought"),
        F.greatest(F.lit(0).cast("decimal(12,2)"), F.round(goal - bought, 2)).alias("to_goal"),
    )
    if ordered:
        result = result.orderBy(
            F.col("length").desc(), F.col("name").asc_nulls_last(), F.col("member_no").asc()
        )
    return result
