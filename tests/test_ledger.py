import random
import re
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from conftest import rows
from mascate.functions.calendar import DateWindow, resolve_window
from mascate.operators.ledger import net_ledger, net_purchases

AS_OF = date(2026, 6, 15)


def test_cancelled_rules(make):
    flags = [None, "N", "S", "X"]
    orders = make("orders", [dict(tax_id=f"o{f}", date=AS_OF, total=Decimal("2"), cancelled=f) for f in flags])
    returns = make("returns", [dict(tax_id=f"r{f}", date=AS_OF, total=Decimal("1"), cancelled=f) for f in flags]
                   + [dict(tax_id="null", date=AS_OF)])
    strict = {r.tax_id: r.value for r in net_ledger(orders, returns).collect()}
    assert set(strict) == {"oNone", "oN", "oX", "rNone", "rN", "null"}
    assert strict["oX"] == 2 and strict["rN"] == -1 and strict["null"] == 0
    loose = {r.tax_id for r in net_ledger(orders, returns, strict_returns=False).collect()}
    assert loose == set(strict) | {"rX"}


def test_window_edges(make):
    days = [date(2026, 3, 31), date(2026, 4, 1), AS_OF, AS_OF + timedelta(1)]
    orders = make("orders", [dict(tax_id="1", date=d, total=Decimal("1")) for d in days])
    none = make("returns", [])
    kept = net_ledger(orders, none, DateWindow.days(date(2026, 4, 1), AS_OF)).select("date").collect()
    assert {r.date for r in kept} == {days[1], days[2]}


def digits(text):
    return None if text is None else re.sub("[^0-9]", "", text)


def pad(text):
    return None if text is None else digits(text).rjust(14, "0")[:14]


HIDDEN = {6, 8, 9, 95}


def one_request(target, data, window, grain, seller):
    """One target at a time, straight from the definition."""
    customers, orders, returns, history, names = data
    target = pad(target)
    seen = sorted(
        (c for c in customers if c["status"] not in HIDDEN and digits(c["tax_id"]) == target),
        key=lambda c: c["customer_id"],
    )
    parent = seen[0]["parent_tax_id"] if seen else None
    accounts = {c["tax_id"] for c in customers
                if parent is not None and c["parent_tax_id"] == parent and c["status"] not in HIDDEN}
    if seller is None:
        accounts.add(target)
    else:
        mine = {digits(h["tax_id"]) for h in history if h["seller_no"] == seller}
        accounts = {a for a in accounts if digits(a) in mine}
    sums = defaultdict(Decimal)
    for sign, facts in ((1, orders), (-1, returns)):
        for f in facts:
            valid = f["cancelled"] != "S" if sign > 0 else f["cancelled"] in (None, "N")
            inside = (window.start is None or f["date"] >= window.start) and (window.stop is None or f["date"] < window.stop)
            if f["tax_id"] in accounts and valid and inside:
                key = f["date"].replace(day=1) if grain == "month" else f["date"]
                sums[key] += sign * (f["total"] or 0)
    if seller is not None and not sums:
        return one_request(target, data, window, grain, None)
    key14 = pad(parent if parent is not None else target)
    own = [h for h in history if digits(h["tax_id"]) == key14]
    owner = max(own, key=lambda h: (h["since"], h["seller_no"]))["seller_no"] if own else None
    return {(target, k, v, owner, names.get(owner)) for k, v in sums.items()}


def messy_world(seed):
    rng = random.Random(seed)
    ids = [f"{n:014d}" for n in range(12)] + ["5", "000000000000-07", "123456789012345", ""]
    customers = [dict(customer_id=i, tax_id=rng.choice(ids), status=rng.choice([None, 1, 2, 8, 95]),
                      parent_id=rng.randrange(20), parent_tax_id=rng.choice([None, "", *ids[:5], "0000000000000-3"]))
                 for i in range(30)]

    def facts():
        return [dict(tax_id=rng.choice(ids), date=AS_OF - timedelta(rng.randrange(500) - 40), seller_no=rng.randrange(4),
                     total=rng.choice([None, Decimal(rng.randrange(10000)) / 100]), cancelled=rng.choice([None, "N", "S", "X"]))
                for _ in range(120)]

    history = [dict(tax_id=rng.choice(ids), seller_no=rng.randrange(4), since=datetime(2026, 1, 1 + i)) for i in range(25)]
    names = {0: "Zero", 1: "One", 2: "Two"}
    return ids, (customers, facts(), facts(), history, names)


@pytest.mark.parametrize("options", [
    dict(), dict(grain="day", start=date(2026, 1, 1), end=AS_OF), dict(month="2026-05"),
    dict(seller_no=1), dict(seller_no=2, months=3), dict(seller_no=99, months=2),
])
def test_net_purchases_one_by_one(make, spark, options):
    ids, data = messy_world(len(str(options)))
    customers, orders, returns, history, names = data
    targets = spark.createDataFrame([(i,) for i in [*ids, "99", "1", "7"]], "tax_id STRING")
    got = net_purchases(
        targets, make("customers", customers), make("orders", orders), make("returns", returns),
        make("owner_history", history),
        make("sellers", [dict(seller_id=n, seller_no=n, name=name) for n, name in names.items()]),
        AS_OF, **options,
    )
    window = resolve_window(AS_OF, *[options.get(k) for k in ("start", "end", "month", "months")])
    want = set()
    for target in {pad(i) for i in [*ids, "99", "1", "7"]}:
        want |= one_request(target, data, window, options.get("grain", "month"), options.get("seller_no"))
    assert want
    assert rows(got, "tax_id", "period", "total", "seller_no", "seller_name") == sorted(want, key=repr)
    label = got.first()["label"]
    assert len(label) == (10 if options.get("grain") == "day" else 7)


def test_bad_grain(make, spark):
    with pytest.raises(ValueError):
        net_purchases(*[None] * 6, AS_OF, grain="week")
