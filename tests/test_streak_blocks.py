"""Runs joined from blocks of the goal calendar are the runs over all of it."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest

from conftest import rows
from mascate.operators.goals import goal_islands
from mascate.operators.streak_blocks import block_runs, joined, with_current

FIRST = date(2026, 1, 1)


def day(n):
    return FIRST + timedelta(days=n)


@pytest.fixture
def tables(make):
    rng = random.Random(4)
    calendar = [n for n in range(40) if rng.random() < 0.8]
    goals = make("month_goals", [dict(period=day(n), goal=Decimal(10) if n % 9 else None) for n in calendar])
    bought = [
        dict(member_no=member, period=day(n), total=Decimal(rng.choice([9, 10, 11, 12])))
        for member in range(25)
        for n in range(42)
        if rng.random() < 0.9
    ]
    return make("month_purchases", bought), goals


@pytest.mark.parametrize("cuts", [(14, 27), (1, 39), (20, 21)])
def test_joined_blocks_are_the_whole(tables, cuts):
    purchases, goals = tables
    last = day(38)
    edges = [0, *cuts, 39]
    blocks = [block_runs(purchases, goals, day(a), day(b - 1)) for a, b in zip(edges, edges[1:])]
    one, two = (day(cut) for cut in cuts)
    left = joined(joined(blocks[0], blocks[1], goals, one), blocks[2], goals, two)
    right = joined(blocks[0], joined(blocks[1], blocks[2], goals, two), goals, one)
    want = rows(goal_islands(purchases, goals, last))
    assert rows(with_current(left, goals, last)) == want and any(row[4] for row in want)
    assert rows(with_current(right, goals, last)) == want


def test_blocks_without_runs(tables):
    purchases, goals = tables
    none = block_runs(purchases, goals, day(100), day(120))
    some = block_runs(purchases, goals, day(0), day(20))
    assert none.count() == 0
    assert rows(joined(some, none, goals, day(100))) == rows(some)
    assert rows(joined(none, some, goals, day(0))) == rows(some)
    # a calendar without periods on one side of the border
    assert rows(joined(none, some, goals.limit(0), day(0))) == rows(some)


def test_only_the_blocks_purchases_are_read(spark, tables, tmp_path):
    purchases, goals = tables
    purchases.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = block_runs(stored, goals, day(10), day(12))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(period,2026-01-11)" in plan and "LessThanOrEqual(period,2026-01-13)" in plan
