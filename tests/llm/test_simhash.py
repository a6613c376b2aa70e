import random

import pytest
import xxhash

from mascate.llm import simhash
from mascate.llm.components import component_of

from .fixtures import ODD, empty, odd, table


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))] if words else []
    bits = 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            bits |= 1 << b
    return bits


def brute_classes(items):
    """Smallest id of each class, by comparing all pairs."""
    prints = [(doc, brute_fingerprint(text)) for doc, text in items]
    root = list(range(len(prints)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for n, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(n)] = min(least.get(find(n), doc), doc)
    return sorted(((doc, f"{fp:016x}", least.get(find(n))) for n, (doc, fp) in enumerate(prints)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def near_copies():
    """Copies with a few words changed each, so that classes hang together by chains."""
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(400)]
    items = []
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for copy in range(25):
            items.append((base * 100 + copy, " ".join(words)))
            if copy % 2:
                words = list(words)
                words[rng.randrange(200)] = rng.choice(vocabulary)
    return items


@pytest.mark.parametrize("paired_bucket", [simhash.PAIRED_BUCKET, 1])
def test_classes_match_all_pairs(spark, paired_bucket):
    items = near_copies()
    docs = table(spark, [(i, t, "en", "a", len(t)) for i, t in items])
    assert found(simhash.near_duplicates(docs, paired_bucket=paired_bucket)) == brute_classes(items)


def plan_nodes(plan):
    """All nodes of the plan that ran, inside its stages too."""
    name = plan.nodeName()
    if name.startswith("Adaptive"):
        return plan_nodes(plan.executedPlan())
    if "QueryStage" in name:
        return plan_nodes(plan.plan())
    children = plan.children()
    return [plan] + [node for n in range(children.size()) for node in plan_nodes(children.apply(n))]


def test_points_of_a_crowded_bucket_stay_off_the_driver(spark):
    """300 fingerprints have 624,300 points, of whose size Spark knows nothing before they are shuffled."""
    center = 0x1234_5678_9ABC_DEF0
    fps = [center ^ flip for flip in simhash._flips(64, 2)[:300]]
    found = simhash.links(spark.createDataFrame([(fp,) for fp in fps], "fp long"), paired_bucket=16)
    edges = {(r["a"], r["b"]) for r in found.collect()}
    broadcast = [n for n in plan_nodes(found._jdf.queryExecution().executedPlan()) if "BroadcastExchange" in n.nodeName()]
    assert all(n.metrics().apply("dataSize").value() < 10 << 20 for n in broadcast)
    assert edges and all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in edges)
    near, reached = {fp: set() for fp in fps}, [center]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for fp in reached:
        reached += near[fp].difference(reached)
    assert sorted(reached) == sorted(fps)


def test_odd_rows(spark):
    assert found(simhash.near_duplicates(odd(spark))) == brute_classes([(r[0], r[1]) for r in ODD])


def test_one_of_each_class_stays(spark):
    docs = odd(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes = brute_classes([(r[0], r[1]) for r in ODD])
    assert sorted((i for i in ids if i is not None)) == sorted({c for _, _, c in classes if c is not None})
    # the text without an id has a class of its own, the one without both joins the empty ones
    assert ids.count(None) == 1


def test_empty_table(spark):
    assert found(simhash.near_duplicates(empty(spark))) == []
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    chain = [(n, n + 1) for n in range(100, 160)]
    hub = [(1, n) for n in range(200, 400)] + [(300, 300)]
    got = {r["node"]: r["root"] for r in component_of(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {n: 100 for n in range(100, 161)} | {n: 1 for n in [1, *range(200, 400)]}
    assert component_of(spark.createDataFrame([], "a long, b long")).count() == 0
