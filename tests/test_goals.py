import random
from datetime import date, datetime
from decimal import Decimal

import pytest

from conftest import rows
from mascate.operators import goals

AS_OF = date(2026, 6, 10)
D = Decimal


def people(make):
    members = make("league_members", [dict(member_no=n, name=f" M{n} ", tax_id=f"{n}") for n in range(1, 13)])
    customers = make("customers", [
        dict(customer_id=n, tax_id=f"{n:014d}", parent_id=1 if n == 5 else n, status=9 if n == 4 else None)
        for n in range(1, 13)
    ])
    history = make("owner_history", [dict(tax_id=f"{2:014d}", seller_no=7, since=datetime(2026, 1, 1)),
                                     dict(tax_id=f"{2:014d}", seller_no=8, since=datetime(2026, 2, 1))])
    sellers = make("sellers", [dict(seller_id=1, seller_no=8, name="Eight")])
    return members, customers, history, sellers


def race(make, goal_rows, purchase_rows, prize_rows=(), **options):
    return goals.race_pacing(
        make("race_purchases", purchase_rows), make("race_goals", goal_rows), make("race_prizes", prize_rows),
        *people(make), AS_OF, **options,
    )


START, END = date(2026, 6, 1), date(2026, 6, 21)
GOAL = dict(start=START, end=END, goal=D("2000"), star_value=D("100"))


def bought(member, total, start=START, end=END):
    return dict(member_no=member, start=start, end=end, total=D(str(total)))


def test_race_colours_and_stars(make):
    # 20 days long, 10 elapsed: 1000 is due, 950 is the yellow limit.
    got = race(make, [GOAL], [bought(1, 1000), bought(2, "999.99"), bought(3, 950), bought(6, "949.99"),
                              bought(7, 2500), bought(8, 99), bought(4, 1000), bought(9, 1000)],
               [dict(member_no=9, start=date(2020, 1, 1), end=date(2020, 2, 1))])
    table = {r.member_no: r for r in got.collect()}
    assert set(table) == {1, 2, 3, 6, 7, 8}  # 4 is hidden, 9 has an old prize
    assert {n: r.colour for n, r in table.items()} == {
        1: "verde", 2: "amarelo", 3: "amarelo", 6: "vermelho", 7: "verde", 8: "vermelho",
    }
    one, seven = table[1], table[7]
    assert (one.name, one.stars, one.missing_stars, one.to_goal) == ("M1", 10, 10, D("1000.00"))
    assert (one.daily_goal, one.days_elapsed, one.expected) == (D("100.00"), 10, D("1000.00"))
    assert (seven.stars, seven.missing_stars, seven.to_goal) == (20, 0, 0)
    assert [r.member_no for r in got.collect()][:2] == [7, 1]
    assert (table[2].seller_no, table[2].seller_name) == (8, "Eight")


def test_race_edges(make):
    other = (date(2026, 6, 10), date(2026, 6, 10))
    got = race(make, [
        dict(GOAL, star_value=None),
        dict(start=other[0], end=other[1], goal=D("10"), star_value=D("0")),
        dict(start=date(2026, 1, 1), end=date(2026, 6, 9), goal=D("10"), star_value=D("1")),
    ], [bought(1, 5), bought(2, 5, *other), bought(3, 5, date(2026, 1, 1), date(2026, 6, 9))])
    table = {r.member_no: r for r in got.collect()}
    assert set(table) == {1, 2}
    assert table[1].stars == 20 and table[1].missing_stars == 0
    two = table[2]
    assert (two.stars, two.missing_stars, two.daily_goal, two.expected, two.colour) == (None,) * 5
    assert two.days_elapsed == 1


def test_race_last_day_expects_more_than_the_goal(make):
    days = dict(start=date(2026, 6, 1), end=AS_OF, goal=D("900"), star_value=D("1"))
    got = race(make, [days], [bought(1, 900, days["start"], days["end"])]).first()
    assert got.expected == D("1000.00") and got.colour == "vermelho"


def test_race_seller_filter_and_fallback(make):
    everything = [bought(1, 5), bought(2, 5)]
    # Seller 7 owned member 2 once: the row is kept and shows the latest owner.
    assert rows(race(make, [GOAL], everything, seller_no=7), "member_no", "seller_no") == [(2, 8)]
    assert rows(race(make, [GOAL], everything, seller_no=55), "member_no") == [(1,), (2,)]


MONTHS = [date(2025, m, 1) for m in range(7, 13)] + [date(2026, m, 1) for m in range(1, 7)]


def streak(make, hits, goal_months=MONTHS, **options):
    month_goals = make("month_goals", [dict(period=m, goal=D("100")) for m in goal_months]
                       + [dict(period=date(2026, 7, 1), goal=D("100"))])
    purchases = make("month_purchases", [dict(member_no=n, period=m, total=D(str(t))) for n, m, t in hits])
    return goals.goal_streaks(purchases, month_goals, *people(make), AS_OF, **options)


def run(member, months, total=100):
    return [(member, m, total) for m in months]


def test_streak_lengths(make):
    hits = (run(1, MONTHS[-3:]) + run(2, MONTHS[-4:]) + run(3, MONTHS[-5:], 150) + run(6, MONTHS[-6:])
            + run(7, MONTHS[-5:-1]) + run(8, MONTHS[-4:], "99.99") + run(4, MONTHS[-4:]) + run(5, MONTHS[-4:]))
    got = streak(make, hits)
    assert [(r.member_no, r.length, r.bought, r.to_goal) for r in got.collect()] == [
        (3, 5, D("150.00"), D("0.00")), (2, 4, D("100.00"), D("0.00")),
    ]  # 4 is hidden, 5 is not a parent
    assert rows(streak(make, hits, stage=4), "member_no") == [(2,)]
    assert rows(streak(make, hits, stage=5, seller_no=7), "member_no") == [(3,)]
    assert rows(streak(make, hits, seller_no=7), "member_no") == [(2,)]
    with pytest.raises(ValueError):
        streak(make, hits, stage=3)


def test_streak_skips_months_without_goal(make):
    months = MONTHS[:-3] + MONTHS[-2:]
    hits = run(1, [MONTHS[-5], MONTHS[-4], MONTHS[-2], MONTHS[-1]])
    assert rows(streak(make, hits, months), "member_no", "length") == [(1, 4)]
    assert rows(streak(make, hits), "member_no") == []


def test_islands_against_brute_force(make, spark):
    rng = random.Random(5)
    goal_of = {m: D(rng.randrange(50, 60)) for m in MONTHS if m != MONTHS[4]}
    totals = {(n, m): D(rng.randrange(45, 70)) for n in range(30) for m in MONTHS if rng.random() < 0.9}
    want = []
    for n in range(30):
        current = []
        for m in [*sorted(goal_of), None]:
            if m is not None and totals.get((n, m), D(0)) >= goal_of[m]:
                current.append(m)
            elif current:
                want.append((n, current[0], current[-1], len(current), current[-1] == max(goal_of)))
                current = []
    got = goals.goal_islands(
        make("month_purchases", [dict(member_no=n, period=m, total=t) for (n, m), t in totals.items()]),
        make("month_goals", [dict(period=m, goal=g) for m, g in goal_of.items()]),
        MONTHS[-1],
    )
    assert rows(got) == sorted(want, key=repr)
