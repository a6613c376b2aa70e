from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from mascate.operators import customers as cust
from mascate.operators import owners


def test_directory(make):
    customers = make("customers", [
        dict(customer_id=5, tax_id="111.222.333-44", name=" Later "),
        dict(customer_id=2, tax_id="11122233344", name=" First ", parent_id=2, parent_tax_id=""),
        dict(customer_id=3, tax_id="00000000000099", name="Child", parent_id=2, parent_tax_id="111.222.333-44", status=8),
        dict(customer_id=None, tax_id="77", name="No id", parent_id=7, parent_tax_id="5"),
        dict(customer_id=9, tax_id="123456789012345", name="Long", parent_id=9, area1="11", phone1="5"),
    ])
    got = rows(cust.customer_directory(customers))
    assert got == sorted([
        ("11122233344", True, "00011122233344", "First", " ", None),
        ("00000000000099", False, "00011122233344", "Child", " ", 8),
        ("77", None, "00000000000005", "No id", " ", None),
        ("123456789012345", True, "12345678901234", "Long", "11 5", None),
    ], key=repr)
    blank = cust.customer_directory(customers, blank_phone_as_null=True)
    assert {r.phone for r in blank.collect()} == {None, "11 5"}


def test_target_groups(make, spark):
    customers = make("customers", [
        dict(customer_id=1, tax_id="00000000000001", parent_tax_id="00000000000001"),
        dict(customer_id=2, tax_id="00000000000002", parent_tax_id="00000000000001"),
        dict(customer_id=3, tax_id="00000000000003", parent_tax_id="00000000000001", status=95),
        dict(customer_id=4, tax_id="4", parent_tax_id="00000000000001"),
        dict(customer_id=5, tax_id="000000000000-05", parent_tax_id="00000000000001"),
        dict(customer_id=6, tax_id="00000000000006"),
        dict(customer_id=8, tax_id="00000000000007", parent_tax_id="00000000000002"),
        dict(customer_id=7, tax_id="00000000000007", parent_tax_id="00000000000001"),
    ])
    targets = spark.createDataFrame([(t,) for t in ("1", "2", "2", "3", "4", "5", "6", "7", "8")], "tax_id STRING")
    one, two = "00000000000001", "00000000000002"

    def own(n):
        return f"{n:014d}"

    assert rows(cust.target_groups(targets, customers)) == sorted([
        (one, one, one, True),
        (two, one, one, True),
        (own(3), None, own(3), False),  # hidden account
        (own(4), None, own(4), False),  # stored short: never matches
        (own(5), one, one, False),  # stored with punctuation: found, but not under the raw id
        (own(6), None, own(6), False),
        (own(7), one, one, True),  # lowest customer id decides
        (own(8), None, own(8), False),
    ], key=repr)


def test_latest_owner(make):
    early, late = datetime(2026, 1, 1), datetime(2026, 2, 1)
    history = make("owner_history", [
        dict(tax_id="1", seller_no=1, since=early),
        dict(tax_id="1", seller_no=2, since=late),
        dict(tax_id="0-1", seller_no=1, since=early),
        dict(tax_id="2", seller_no=3, since=None),
        dict(tax_id="2", seller_no=1, since=early),
        dict(tax_id="3", seller_no=1, since=early),
        dict(tax_id="3", seller_no=2, since=early),
        dict(tax_id="4", seller_no=77, since=early),
        dict(tax_id="5", seller_no=None, since=late),
        dict(tax_id="5", seller_no=1, since=early),
        dict(tax_id="6", seller_no=None, since=None),
        dict(tax_id="6", seller_no=-2147483648, since=None),
        dict(tax_id="7", seller_no=2147483647, since=datetime(1900, 1, 1, 0, 0, 0, 1)),
        dict(tax_id="7", seller_no=1, since=datetime(1900, 1, 1, 0, 0, 0, 2)),
    ])
    sellers = make("sellers", [
        dict(seller_id=12, seller_no=2, name="Second"),
        dict(seller_id=11, seller_no=2, name=" First "),
        dict(seller_id=10, seller_no=1, name="One"),
    ])
    assert rows(owners.latest_owner(history, sellers)) == sorted([
        ("1", 2, "First"), ("01", 1, "One"), ("2", 1, "One"), ("3", 2, "First"), ("4", 77, None),
        ("5", None, None), ("6", -2147483648, None), ("7", 1, "One"),
    ], key=repr)
    shuffled = history.orderBy(F.rand(3))
    assert rows(owners.latest_owner(shuffled, sellers)) == rows(owners.latest_owner(history, sellers))
    # The filter goes by any owner ever, the display by the latest one.
    docs = history.select(F.col("tax_id").alias("k")).distinct()
    assert rows(owners.owned_by_seller(docs, "k", history, 1)) == [("1",), ("2",), ("3",), ("5",), ("7",)]
    flagged = owners.flag_owned(docs, "k", history, 1)
    assert rows(flagged.where("owned").drop("owned")) == [("1",), ("2",), ("3",), ("5",), ("7",)]
    assert flagged.count() == docs.count()


def test_link_users(make):
    users = make("users", [dict(user_id=1, seller_no=5, password_md5="x"), dict(user_id=2, seller_no=6), dict(user_id=3)])
    sellers = make("sellers", [dict(seller_id=2, seller_no=5, name="b"), dict(seller_id=1, seller_no=5, name="a", store=4)])
    got = owners.link_users_to_sellers(users, sellers)
    assert "password_md5" not in got.columns
    assert rows(got, "user_id", "seller_id", "seller_name", "seller_store") == [(1, 1, "a", 4), (2, None, None, None), (3, None, None, None)]
