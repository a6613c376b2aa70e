import hashlib
import math
import random

import numpy as np
import pytest

from mascate.llm import queries, table_kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster string, id int, label int"


def plain(rows, size, clusters=40, rounds=5, seed="2"):
    """The same clusters by loops over Python's whole numbers."""
    kept = []
    for row in rows:
        vector = row[1]
        if vector is not None and len(vector) == size:
            if all(x is not None and math.isfinite(x) and abs(x) < 2.0**64 for x in vector):
                kept.append((row[0], [math.floor(256 * x) for x in vector]))
    digest = lambda n: (n is None, hashlib.sha256(f"{seed}:{n}".encode()).hexdigest())
    centroids = [vector for _, vector in sorted(kept, key=lambda row: (digest(row[0]), row[1]))[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(vector):
        return min((square(vector, centroid), n) for n, centroid in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, vector in kept:
            groups.setdefault(nearest(vector)[1], []).append(vector)
        for n, vectors in groups.items():
            centroids[n] = [sum(column) // len(vectors) for column in zip(*vectors)]
    found = [(number, *nearest(vector)) for number, vector in kept]
    sums = {}
    for _, distance, n in found:
        sums[n] = sums.get(n, 0) + distance
    most = (1 << 63) - 1
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, min(d, most), min(sums[n], most), min(sum(sums.values()), most), shown[n]) for i, d, n in found]


def vectors(rng, count, size, spread=0.2):
    rows = []
    for number in range(count):
        middle = rng.choice([-0.5, 0.0, 0.25])
        rows.append((number, [rng.gauss(middle, spread) for _ in range(size)], "x", 1, 2))
    return rows


def checked(spark, rows, size, **settings):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, table_kmeans.cluster(frame, size=size, **settings).collect()), key=repr)
    assert got == sorted(plain(rows, size, **settings), key=repr)
    return got


def test_same_clusters_as_by_loops(spark):
    got = checked(spark, vectors(random.Random(1), 300, 8), 8, clusters=12)
    assert len({row[1] for row in got}) > 3


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = vectors(rng, 60, 4)
    rows += rows[:7] + [(3, [0.5, 0.5, 0.5, 0.5], None, None, None), (None, [0.1] * 4, None, None, None)]
    rows += [(100 + n, vector, "", 0, 0) for n, vector in enumerate([None, [], [0.1] * 3, [0.1] * 5])]
    rows += [(200 + n, [0.1, 0.2, x, 0.3], "", 0, 0) for n, x in enumerate([None, math.nan, math.inf, -math.inf, 1e300])]
    got = checked(spark, rows, 4, clusters=6)
    assert len(got) == 69


def test_values_far_apart(spark):
    """Beyond the kept tables, and beyond 64 bits."""
    rng = random.Random(3)
    near = vectors(rng, 80, 4)
    checked(spark, near + [(500 + n, [rng.uniform(-1e5, 1e5) for _ in range(4)], "", 0, 0) for n in range(60)], 4, clusters=9)
    checked(spark, near + [(600, [1e18, -1e18, 0.0, 1e9], "", 0, 0), (601, [1e12] * 4, "", 0, 0)], 4, clusters=5)


def test_few_vectors_ties_and_none(spark):
    checked(spark, vectors(random.Random(4), 3, 4), 4, clusters=40)
    checked(spark, [(n, [0.5, 0.5, 0.0, 0.0], "", 0, 0) for n in range(50)], 4, clusters=5)
    assert checked(spark, [], 4) == []
    assert checked(spark, [(1, [0.0], "", 0, 0)], 4) == []


@pytest.mark.parametrize("reach", [300, 40_000, 1 << 40])
def test_tables_are_squared_distances(reach):
    rng = np.random.default_rng(5)
    centroids = rng.integers(-reach, reach, (7, 5)).tolist()
    tables = table_kmeans.Tables(centroids)
    for spread in (reach // 3, reach):
        values = rng.integers(-spread, spread, (500, 5))
        got = tables.distances(values.astype(float))
        wide = (values.astype(object)[:, None, :] - np.array(centroids, dtype=object)[None]) ** 2
        assert (got.astype(object) == wide.sum(axis=2)).all()


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(n, [rng.gauss(0, 0.13) for _ in range(64)], "", 0, n % 5) for n in range(150)]
    narrow = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "cast(embedding AS array<float>) embedding", "label")
    narrow.write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(row["vec_id"], row["embedding"]) for row in narrow.collect()]
    got = queries.op13_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(stored, 64), key=repr)
