"""League members: roster, ranking, birthdays and profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.functions.keys import (
    digits,
    has_number,
    parent_tax_id14,
    phone_of,
    tax_id14,
    tax_id14_uncut,
    visible,
)
from mascate.functions.text import date_text
from mascate.operators.customers import customer_directory, customer_phone, visible_customers
from mascate.operators.dedupe import best_per_key, low_first
from mascate.operators.fallback import with_fallback
from mascate.operators.lookup import lookup
from mascate.operators.owners import flag_owned, latest_owner

# How many members the ranking shows, and the texts of a member's standing.
TOP_SIZE = 30
ACTIVE, FORMER, NEVER = "ativa", "ja_esteve", "nunca"
MESSAGES = {
    ACTIVE: "Ativa na Liga.",
    FORMER: "Ja esteve na Liga (nao esta ativa no momento).",
    NEVER: "Cliente nao esta na Liga (sem cadastro FashionStar).",
}


def active_roster(roster: DataFrame) -> DataFrame:
    """The distinct padded tax ids of active league entries."""
    return (
        roster.where(F.col("active") == "S")
        .select(tax_id14(F.col("tax_id")).alias("tax_id14"))
        .distinct()
    )


def member_since(roster: DataFrame) -> DataFrame:
    """The latest league entry date per tax id (digits, not padded), active or not."""
    return roster.groupBy(digits(F.col("tax_id")).alias("tax_digits")).agg(
        F.max("entered").alias("member_since")
    )


def top_members(
    ranking: DataFrame,
    members: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    seller_no: int | None = None,
    size: int = TOP_SIZE,
) -> DataFrame:
    """The first members of the ranking, one per parent account; a seller marks, never filters.

    Owners are looked up for the listed parents only: the ownership history is cut down to them
    before it is reduced to the latest owner.
    """
    directory = customer_directory(customers)
    own = directory.select(
        F.col("tax_digits").alias("tax_id14"), "parent_tax_id14", F.col("is_parent").alias("own_is_parent")
    )
    detail = members.select("member_no", tax_id14(F.col("tax_id")).alias("tax_id14"))
    ranked = lookup(
        ranking.select("member_no", "position", "value").join(detail, "member_no", "left"),
        own,
        "tax_id14",
    ).withColumn(
        "_key",
        F.coalesce("parent_tax_id14", F.concat(F.lit("c"), F.col("member_no").cast("string"))),
    )
    one_per_parent = best_per_key(
        ranked.drop("member_no"),
        ["_key"],
        [F.coalesce("own_is_parent", F.lit(False)), low_first("position"), "value", "tax_id14"],
    ).select("position", "value", F.coalesce("parent_tax_id14", "tax_id14").alias("tax_id"))
    listed = directory.select(F.col("tax_digits").alias("tax_id"), "name", "phone", "status")
    order = [
        F.col("position").asc_nulls_last(),
        F.col("value").desc_nulls_first(),
        F.col("tax_id").asc_nulls_last(),
    ]
    top = (
        one_per_parent.join(listed, "tax_id", "left")
        .where(visible(F.col("status")))
        .orderBy(*order)
        .limit(size)
    )
    wanted = top.select(F.col("tax_id").alias("_tax"))
    near = history.withColumn("_tax", digits(F.col("tax_id"))).join(wanted, "_tax", "left_semi")
    owner = latest_owner(near, sellers).withColumnRenamed("tax_digits", "tax_id")
    mine = F.lit(False) if seller_no is None else F.col("seller_no") == seller_no
    return (
        top.join(owner, "tax_id", "left")
        .select(
            "position",
            "tax_id",
            "name",
            "phone",
            F.lit(True).alias("is_parent"),
            "seller_no",
            "seller_name",
            F.round("value", 2).alias("value"),
            mine.alias("mine"),
        )
        .orderBy(*order)
    )


def birthdays(
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    seller_no: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Parents with a birthday in the month of ``as_of``, one row per raw parent tax id.

    A seller filter picks accounts before the parents are formed and gives way if nobody is left.
    """
    accounts = customers.where(
        F.col("parent_birth").isNotNull()
        & visible(F.col("status"))
        & visible(F.col("parent_status"))
    ).select(
        digits(F.col("tax_id")).alias("tax_digits"),
        "customer_id",
        "parent_tax_id",
        "parent_name",
        "parent_birth",
        "parent_area1",
        "parent_phone1",
        "parent_area2",
        "parent_phone2",
    )

    def this_month(df: DataFrame) -> DataFrame:
        return best_per_key(df, ["parent_tax_id"], [low_first("customer_id")]).where(
            F.month("parent_birth") == as_of.month
        )

    if seller_no is None:
        parents = this_month(accounts)
    else:
        # Both answers in one pass: the first account the seller owns, and the first of all.
        flagged = flag_owned(accounts, "tax_digits", history, seller_no)
        first = F.struct(low_first("customer_id").alias("low_id"), *[c for c in accounts.columns if c != "parent_tax_id"])
        both = flagged.groupBy("parent_tax_id").agg(
            F.max(F.when(F.col("owned"), first)).alias("mine"), F.max(first).alias("every")
        )
        mine, every = (F.struct(F.col(c).alias("row"), F.lit(c == "mine").alias("owned")) for c in ("mine", "every"))
        answers = F.when(F.col("mine").isNotNull(), F.array(mine, every)).otherwise(F.array(every))
        chosen = both.select("parent_tax_id", F.inline(answers)).select("parent_tax_id", "row.*", "owned")
        parents = with_fallback(chosen.where(F.month("parent_birth") == as_of.month), "owned").drop("low_id")
    owner = latest_owner(history, sellers).withColumnRenamed("tax_digits", "_parent14")
    born = F.col("parent_birth")
    opening_year = F.when(F.month(born) >= as_of.month, as_of.year).otherwise(as_of.year + 1)
    result = (
        parents.withColumn("_parent14", tax_id14(F.col("parent_tax_id")))
        .join(owner, "_parent14", "left")
        .select(
            "parent_tax_id",
            F.trim("parent_name").alias("name"),
            born.alias("birth"),
            F.lit(True).alias("is_parent"),
            "seller_no",
            "seller_name",
            F.dayofmonth(born).alias("day"),
            (F.month(born) == as_of.month).alias("in_month"),
            F.datediff(F.make_date(opening_year, F.month(born), F.lit(1)), F.lit(as_of)).alias(
                "days_to_month"
            ),
            phone_of(
                F.col("parent_area2"),
                F.col("parent_phone2"),
                F.col("parent_area1"),
                F.col("parent_phone1"),
            ).alias("phone"),
        )
    )
    if ordered:
        result = result.orderBy("day", F.col("parent_tax_id").asc_nulls_last())
    return result


def _number(name: str) -> Column:
    """A figure as a double; none and "not a number" are zero."""
    zero = F.lit(0).cast("double")
    return F.coalesce(F.nanvl(F.col(name).cast("double"), zero), zero)


def roster_list(roster: DataFrame, members: DataFrame, customers: DataFrame) -> DataFrame:
    """Active league members with their plan, one per parent: the plan that ends last."""
    directory = customer_directory(customers).select(
        "tax_digits", "parent_tax_id14", "phone", "status"
    )
    enrolled = lookup(
        members.withColumn("tax_id14", tax_id14(F.col("tax_id"))),
        active_roster(roster),
        "tax_id14",
        "left_semi",
    ).withColumn("tax_digits", digits(F.col("tax_id")))
    listed = (
        lookup(enrolled, directory, "tax_digits")
        .where(visible(F.col("status")))
        .withColumn("parent_key", F.coalesce("parent_tax_id14", "tax_id14"))
    )
    best = best_per_key(
        listed, ["parent_key"], ["plan_end", low_first("plan_code"), low_first("member_no")]
    )
    return best.select(
        "plan_code",
        F.col("tax_digits").alias("tax_id"),
        F.trim("name").alias("name"),
        "phone",
        "plan",
        F.coalesce("stars", F.lit(0)).alias("stars"),
        _number("points").alias("points"),
        F.coalesce("exchange_days", F.lit(0)).alias("exchange_days"),
        _number("discount_pct").alias("discount_pct"),
        date_text(F.col("plan_start")).alias("plan_start"),
        date_text(F.col("plan_end")).alias("plan_end"),
        F.lit(True).alias("in_league"),
    )


def member_profile(
    targets: DataFrame, customers: DataFrame, roster: DataFrame, members: DataFrame
) -> DataFrame:
    """Standing, points and balance of each target tax id, seen with its account group.

    The group is every visible account with the target's parent, plus the target. What the target
    needs from its group (is anyone on the roster, the newest record, the best phone) is reduced
    to one row per tax id and then one per group, so no pair of target and account is formed.
    """
    asked = targets.select(tax_id14_uncut(F.col("tax_id")).alias("target")).distinct()
    keyed = customers.select(
        tax_id14(F.col("tax_id")).alias("tax_id14"),
        parent_tax_id14(F.col("parent_tax_id"), F.col("tax_id")).alias("group_id"),
        "customer_id",
        "status",
        has_number(F.col("phone2")).alias("has_mobile"),
        customer_phone().alias("phone"),
    )
    home = best_per_key(
        keyed.select("tax_id14", "group_id", "customer_id"), ["tax_id14"], [low_first("customer_id")]
    ).select(F.col("tax_id14").alias("target"), "group_id")

    # One row per tax id.
    on_roster = active_roster(roster).withColumn("on_roster", F.lit(True))
    shown = ["tax_id", "name", "stars", "plan", "points", "exchange_days", "discount_pct"]
    shown += ["purchases_7m", "current_month", "birth", "plan_start", "plan_end"]
    newest = ["changed", "plan_code", "member_no"]
    records = best_per_key(
        members.select(
            tax_id14(F.col("tax_id")).alias("tax_id14"), *newest, F.struct(*shown).alias("record")
        ),
        ["tax_id14"],
        newest,
    )
    phones = best_per_key(
        visible_customers(keyed).select("tax_id14", "has_mobile", "customer_id", "phone"),
        ["tax_id14"],
        ["has_mobile", low_first("customer_id")],
    )
    facts = (
        phones.join(records, "tax_id14", "full")
        .join(on_roster, "tax_id14", "full")
        .withColumn("on_roster", F.coalesce("on_roster", F.lit(False)))
    )

    # One row per group.
    accounts = visible_customers(keyed).select("group_id", "tax_id14").distinct()
    in_group = lookup(accounts, facts, "tax_id14")
    record_rank = F.struct(*newest, "tax_id14", "record")
    phone_rank = F.struct("has_mobile", low_first("customer_id").alias("low_id"), "phone")
    groups = (
        in_group.groupBy("group_id")
        .agg(
            F.max("on_roster").alias("group_on_roster"),
            F.max(F.when(F.col("record").isNotNull(), record_rank)).alias("best_record"),
            F.max(F.when(F.col("phone").isNotNull(), phone_rank)).alias("best_phone"),
        )
        .select(
            "group_id",
            "group_on_roster",
            F.col("best_record.record").alias("group_record"),
            F.col("best_phone.phone").alias("group_phone"),
        )
    )

    own = facts.select(F.col("tax_id14").alias("target"), "on_roster", "record", "phone")
    joined = lookup(
        asked.join(home, "target", "left").join(own, "target", "left"), groups, "group_id"
    )
    profile = joined.select(
        "target",
        F.coalesce("phone", "group_phone").alias("phone"),
        (F.coalesce("on_roster", F.lit(False)) | F.coalesce("group_on_roster", F.lit(False))).alias(
            "in_league"
        ),
        F.coalesce("record", "group_record").alias("r"),
    )
    points, bought, current = _number("r.points"), _number("r.purchases_7m"), _number("r.current_month")
    status = (
        F.when(F.col("in_league"), ACTIVE).when(F.col("r").isNotNull(), FORMER).otherwise(NEVER)
    )
    record_id = F.coalesce(F.nullif(F.col("r.tax_id"), F.lit("")), "target")
    return profile.select(
        "target",
        F.when(F.col("r").isNull(), F.regexp_replace("target", "^0+", ""))
        .otherwise(digits(record_id))
        .alias("tax_id"),
        F.col("r.name").alias("name"),
        "phone",
        "in_league",
        status.alias("status"),
        F.when(status == ACTIVE, MESSAGES[ACTIVE])
        .when(status == FORMER, MESSAGES[FORMER])
        .otherwise(MESSAGES[NEVER])
        .alias("message"),
        F.coalesce("r.stars", F.lit(0)).alias("stars"),
        F.col("r.plan").alias("plan"),
        points.alias("points"),
        F.coalesce("r.exchange_days", F.lit(0)).alias("exchange_days"),
        _number("r.discount_pct").alias("discount_pct"),
        bought.alias("purchases_7m"),
        current.alias("current_month"),
        (points - bought + current).alias("balance"),
        date_text(F.col("r.birth")).alias("birth"),
        date_text(F.col("r.plan_start")).alias("plan_start"),
        date_text(F.col("r.plan_end")).alias("plan_end"),
    )
