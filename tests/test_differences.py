import random

import pytest

from conftest import rows
from mascate.operators.differences import applied, difference, touched_columns

SCHEMA = "id int, a string, b double, key string, change string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def random_rows(rng, ids):
    pick = lambda *values: rng.choice(values)
    return [(n, pick("x", "", None, "null"), pick(1.0, None, float("nan")), pick("k", None), pick(None, "c")) for n in ids]


def test_applying_the_difference_gives_the_new_snapshot(spark):
    rng = random.Random(1)
    old = random_rows(rng, rng.sample(range(60), 40))
    kept = [row for row in old if rng.random() < 0.5]
    known = {row[0] for row in kept}
    new = kept + random_rows(rng, [n for n in rng.sample(range(70), 45) if n not in known])
    before, after = frame(spark, old), frame(spark, new)
    changes = difference(before, after, "id").cache()
    # NaN is no value that equals itself
    assert repr(rows(applied(before, changes, "id"))) == repr(rows(after))
    assert repr(rows(applied(after, difference(after, before, "id"), "id"))) == repr(rows(before))

    by_id = {row[0]: row for row in old}, {row[0]: row for row in new}
    same = lambda x, y: x == y or (x is not None and y is not None and x != x and y != y)
    want = {}
    for n in by_id[0].keys() | by_id[1].keys():
        left, right = by_id[0].get(n), by_id[1].get(n)
        if left is None or right is None:
            want[n] = ("inserted" if left is None else "deleted", None)
        elif names := [c for c, x, y in zip(("a", "b", "key", "change"), left[1:], right[1:]) if not same(x, y)]:
            want[n] = ("changed", names)
    assert {r["id"]: (r["change"], r["columns"]) for r in changes.collect()} == want
    changed = [names for kind, names in want.values() if kind == "changed"]
    counts = {(r["change"], r["column"]): r["rows"] for r in touched_columns(changes).collect()}
    assert counts["changed", "a"] == sum("a" in names for names in changed)


def test_odd_snapshots(spark):
    none, one = frame(spark, []), frame(spark, [(1, "x", 1.0, None, None)])
    assert difference(none, none, "id").count() == 0 == difference(one, one, "id").count()
    assert rows(applied(none, difference(none, one, "id"), "id")) == rows(one)
    assert applied(one, difference(one, none, "id"), "id").count() == 0
    # a NULL is not an empty text, nor a value of the next column
    moved = frame(spark, [(1, None, None, "x", None)])
    assert rows(difference(frame(spark, [(1, "x", None, None, None)]), moved, "id"), "columns") == [(["a", "key"],)]
    # rows without a key
    lost = frame(spark, [(None, "x", None, None, None)])
    assert rows(difference(lost, one, "id"), "id", "change") == [(1, "inserted"), (None, "deleted")]
    assert rows(applied(lost, difference(lost, one, "id"), "id")) == rows(one)
    with pytest.raises(ValueError, match="differ in their columns"):
        difference(one, one.drop("a"), "id")


def test_only_keys_and_digests_of_all_rows_are_shuffled(spark, tmp_path):
    for name, data in (("old", [(1, "x", 1.0, None, None)]), ("new", [(1, "y", 1.0, None, None)])):
        frame(spark, data).write.parquet(str(tmp_path / name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("old", "new"))
        plan = difference(old, new, "id").select("change")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "sha2" in plan and plan.count("Join FullOuter") >= 1
