"""The report tables, derived from the driver's star schema.

Every derivation reads whole tables and has a twin in :mod:`mascate.plans.oracle_roles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns used of each driver table; declared, so that no job runs to infer them.
SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_extendedprice DOUBLE, l_discount DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "events": "ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE",
}


def tax_id(key: Column) -> Column:
    return F.lpad(key.cast("string"), 14, "0")


class Roles:
    """Each method is one report table as a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # Customers, sellers, owners

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        parent = key - key % 3
        return self.table("customer").select(
            key.alias("customer_id"),
            tax_id(key).alias("tax_id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("string").alias("area1"),
            key.cast("string").alias("phone1"),
            F.lit(" 55 ").alias("area2"),
            F.when(F.col("c_acctbal") < 0, "000").otherwise((key + 1000).cast("string")).alias("phone2"),
            F.col("c_nationkey").alias("status"),
            parent.alias("parent_id"),
            tax_id(parent).alias("parent_tax_id"),
        )

    def order_span(self) -> DataFrame:
        """First and last order date per customer."""
        day = F.col("o_orderdate").cast("date")
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(F.min(day).alias("first_order"), F.max(day).alias("last_order"))
        )

    def customers_with_parent(self) -> DataFrame:
        """Customers with the attributes of their parent; the birth date is its first order."""
        customers = self.customers()
        parents = customers.join(self.order_span(), "customer_id", "left").select(
            F.col("customer_id").alias("parent_id"),
            F.col("name").alias("parent_name"),
            F.col("first_order").alias("parent_birth"),
            F.col("area1").alias("parent_area1"),
            F.col("phone1").alias("parent_phone1"),
            F.col("area2").alias("parent_area2"),
            F.col("phone2").alias("parent_phone2"),
            F.col("status").alias("parent_status"),
        )
        return customers.join(parents, "parent_id", "left")

    def sellers(self) -> DataFrame:
        return self.table("nation").select(
            (F.col("n_nationkey") + 100).alias("seller_id"),
            F.col("n_nationkey").alias("seller_no"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("store"),
        )

    def history(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_orderkey") % 25).cast("int").alias("seller_no"),
            tax_id(F.col("o_custkey")).alias("tax_id"),
            F.col("o_orderdate").alias("since"),
        )

    # Facts

    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("document"),
            F.col("o_orderdate").cast("date").alias("date"),
            (F.col("o_orderkey") % 25).cast("int").alias("seller_no"),
            F.col("o_custkey").alias("customer_id"),
            tax_id(F.col("o_custkey")).alias("tax_id"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
            F.when(F.col("o_orderstatus") == "P", "S")
            .when(F.col("o_orderstatus") == "O", "N")
            .alias("cancelled"),
        )

    def returns(self) -> DataFrame:
        lines = self.table("lineitem").where(F.col("l_returnflag") == "R")
        value = F.col("l_extendedprice").cast("decimal(12,2)") * (
            F.lit(1) - F.col("l_discount").cast("decimal(5,2)")
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("document"),
            F.col("l_partkey").alias("product"),
            F.col("l_shipdate").cast("date").alias("date"),
            (F.col("l_orderkey") % 25).cast("int").alias("seller_no"),
            F.col("o_custkey").alias("customer_id"),
            tax_id(F.col("o_custkey")).alias("tax_id"),
            value.cast("decimal(12,2)").alias("total"),
            F.when(F.col("o_orderstatus") == "P", "S")
            .when(F.col("o_orderstatus") == "O", "N")
            .when(F.col("l_linestatus") == "O", "X")
            .alias("cancelled"),
        )

    def sales_lines(self) -> DataFrame:
        """Signed lines of orders and returns that are not cancelled."""
        valid = ~F.col("cancelled").eqNullSafe("S")
        fields = ["document", "date", "customer_id", "tax_id", "seller_no"]
        sold = self.orders().where(valid).select(
            *fields, F.lit(0).cast("bigint").alias("product"), F.col("total").alias("signed_value")
        )
        returned = self.returns().where(valid).select(
            *fields, "product", (-F.col("total")).alias("signed_value")
        )
        shown = self.customers().select("customer_id", F.col("name").alias("customer_name"), "status")
        sellers = self.sellers().select("seller_no", F.col("name").alias("seller_name"), "store")
        lines = sold.unionByName(returned).withColumns(
            {name: F.col(name).cast("decimal(14,0)") for name in ("document", "product")}
        )
        return lines.join(shown, "customer_id", "left").join(sellers, "seller_no", "left")

    # League

    def roster(self) -> DataFrame:
        """Customers of two market segments; one of them has no member detail."""
        enrolled = self.table("customer").where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"))
        return enrolled.join(
            self.order_span(), F.col("c_custkey") == F.col("customer_id"), "left"
        ).select(
            F.col("c_custkey").alias("member_no"),
            tax_id(F.col("c_custkey")).alias("tax_id"),
            F.col("first_order").alias("entered"),
            F.when(F.col("c_acctbal") >= 0, "S").otherwise("N").alias("active"),
        )

    def members(self) -> DataFrame:
        """Member detail of every segment but one."""
        detailed = self.table("customer").where(F.col("c_mktsegment") != "FURNITURE")
        nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
        return detailed.join(
            self.order_span(), F.col("c_custkey") == F.col("customer_id"), "left"
        ).select(
            (nation % 4).alias("plan_code"),
            F.col("c_custkey").alias("member_no"),
            F.col("c_name").alias("name"),
            tax_id(F.col("c_custkey")).alias("tax_id"),
            F.col("c_mktsegment").alias("plan"),
            F.nullif(nation, F.lit(0)).alias("stars"),
            (nation * 2).alias("exchange_days"),
            (nation * F.lit(0.25)).alias("discount_pct"),
            balance.alias("points"),
            (balance * F.lit(0.5)).alias("purchases_7m"),
            F.when(balance >= 0, nation.cast("double")).alias("current_month"),
            F.col("first_order").alias("birth"),
            F.col("first_order").alias("plan_start"),
            F.when(balance >= 100, F.col("last_order")).alias("plan_end"),
            F.col("last_order").alias("changed"),
        )

    def ranking(self) -> DataFrame:
        """Members by total spend; a low total has no position."""
        total = F.sum("total")
        return (
            self.orders()
            .where(~F.col("cancelled").eqNullSafe("S"))
            .groupBy(F.col("customer_id").alias("member_no"))
            .agg(total.alias("value"))
            .withColumn(
                "position",
                F.when(F.col("value") >= 100000, F.lit(2000000000) - F.floor("value")).cast("int"),
            )
        )

    def race_purchases(self) -> DataFrame:
        """Spend per customer and calendar quarter; each quarter is a race."""
        start = F.trunc("date", "quarter")
        return (
            self.orders()
            .where(~F.col("cancelled").eqNullSafe("S"))
            .groupBy(F.col("customer_id").alias("member_no"), start.alias("start"))
            .agg(F.sum("total").alias("total"))
            .select(
                "member_no",
                "start",
                F.date_sub(F.add_months("start", 3), 1).alias("end"),
                F.col("total").cast("decimal(12,2)").alias("total"),
            )
        )

    def race_goals(self) -> DataFrame:
        """The goal of a quarter is 60 % of its best total; a star is a twentieth of it."""
        goal = (F.max("total") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(12,2)")
        star = (F.col("goal") * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(12,2)")
        return (
            self.race_purchases()
            .groupBy("start", "end")
            .agg(goal.alias("goal"))
            .withColumn("star_value", star)
        )

    def race_prizes(self) -> DataFrame:
        """Members that reached the goal of any quarter."""
        return (
            self.race_purchases()
            .join(self.race_goals(), ["start", "end"])
            .where(F.col("total") >= F.col("goal"))
            .select("member_no", "start", "end")
        )

    def day_purchases(self) -> DataFrame:
        """Event value per user and day."""
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("member_no"), F.col("ts").cast("date").alias("period"))
            .agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(12,2)").alias("total"))
        )

    def day_goals(self) -> DataFrame:
        """A goal of 50 on every day with events but the tenth of a month."""
        return (
            self.table("events")
            .select(F.col("ts").cast("date").alias("period"))
            .distinct()
            .where(F.dayofmonth("period") != 10)
            .withColumn("goal", F.lit("50.00").cast("decimal(12,2)"))
        )

    # Users

    def targets(self) -> DataFrame:
        """Every customer's tax id, and one unknown id per supplier."""
        known = self.table("customer").select(tax_id(F.col("c_custkey")).alias("tax_id"))
        unknown = self.table("supplier").select(
            F.concat(F.lit("9"), F.lpad(F.col("s_suppkey").cast("string"), 13, "0")).alias("tax_id")
        )
        return known.unionByName(unknown)

    def users(self) -> DataFrame:
        nation = F.col("c_nationkey")
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.upper("c_name").alias("login"),
            F.md5("c_name").alias("password_md5"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("active"),
            F.lit("2000-01-01").cast("date").alias("created"),
            F.lit(None).cast("date").alias("changed"),
            F.lit(None).cast("int").alias("created_by"),
            F.lit(None).cast("int").alias("changed_by"),
            F.col("c_custkey").alias("person_id"),
            (nation + 3).alias("seller_no"),
            F.lit(1).alias("type"),
            (nation % 5).cast("string").alias("store"),
        )

    def user_targets(self) -> DataFrame:
        """The codes of all suppliers; a negative twin of each is unknown."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(F.explode(F.array(key, -key - 1)).alias("user_id"))

    def user_changes(self) -> DataFrame:
        """Per supplier an update and a create that may ask for the same login, and updates that
        must be refused: an unknown user, a login that another user holds."""
        key, name, balance = F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal")
        supplier = self.table("supplier")
        none = F.lit(None)

        def rows(df, seq, op, user_id, login, password, email, seller_no):
            return df.select(
                seq.cast("bigint").alias("seq"),
                F.lit(op).alias("op"),
                user_id.cast("bigint").alias("user_id"),
                login.cast("string").alias("login"),
                password.cast("string").alias("password"),
                email.cast("string").alias("email"),
                none.cast("int").alias("active"),
                none.cast("bigint").alias("person_id"),
                seller_no.cast("int").alias("seller_no"),
                none.cast("int").alias("type"),
                none.cast("string").alias("store"),
                none.cast("int").alias("created_by"),
                F.lit(1).alias("changed_by"),
            )

        login = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
        update = rows(
            supplier, key * 4, "update", key, F.when(balance >= 5000, login), name, none, F.col("s_nationkey")
        )
        again = rows(
            supplier, key * 4 + 1, "update", key, none, none, F.concat(name, F.lit("@example.org")), none
        )
        create = rows(supplier, key * 4 + 2, "create", -key - 1, login, name, none, none)
        refused = rows(
            supplier,
            key * 4 + 3,
            "update",
            F.when(balance < 5000, -key - 1).otherwise(key),
            F.when(balance >= 5000, "customer#000000000"),
            none,
            none,
            none,
        ).where(F.col("user_id") != 0)
        return update.unionByName(again).unionByName(create).unionByName(refused)
