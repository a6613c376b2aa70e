"""Clusters around centroids in whole numbers: distances are sums of entries of tables of squared differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import written

#: Vectors that a task looks up at a time, and the entries of its tables that it keeps for the next ones.
SLICE, KEPT = 2048, 1 << 17
#: Components below this give distances that 64 bits hold; larger ones are worked out in Python's whole numbers.
NARROW = 1 << 27
#: Components of this size and more are no numbers to the operator: their sums fit no column.
WIDEST = 2.0**64
LARGEST = (1 << 63) - 1


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them NULL, not finite, or beyond ``WIDEST``."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < WIDEST))
    return F.coalesce((F.size(vector) == size) & whole, F.lit(False))


def integers(column: pa.ListArray, size: int, scale: float) -> np.ndarray:
    """A row of floor(scale * x) for each vector, as doubles, which hold them exactly."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(-1, size) * scale)


class Tables:
    """For a round's centroids, of each dimension and integer value the squared differences to all of them.

    The tables cover the values from the least to the largest that have occurred in the task; where
    these lie so far apart that the tables would have more than ``KEPT`` rows, each slice has tables
    of just its own values.
    """

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.reach = max((abs(x) for row in centroids for x in row), default=0)
        self.low = self.high = self.kind = None
        self.tables: list[np.ndarray] | None = None

    def _kind(self, reach: int):
        spread = reach + self.reach
        if self.centroids.shape[1] * spread * spread < 1 << 31:
            return np.int32
        return np.int64 if max(reach, self.reach) <= NARROW else object

    def _table(self, dimension: int, values: np.ndarray, kind) -> np.ndarray:
        own = np.array([int(x) for x in values], dtype=object) if kind is object else values.astype(kind)
        apart = own[:, None] - self.centroids[:, dimension].astype(kind)[None, :]
        return apart * apart

    def _cover(self, low: np.ndarray, high: np.ndarray) -> None:
        if self.low is not None:
            low, high = np.minimum(low, self.low), np.maximum(high, self.high)
        self.low, self.high, self.tables = low, high, None
        if (high - low + 1).sum() <= KEPT:
            self.kind = self._kind(int(max(np.abs(low).max(), np.abs(high).max())))
            self.tables = [
                self._table(n, np.arange(a, b + 1), self.kind) for n, (a, b) in enumerate(zip(low, high))
            ]

    def distances(self, values: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to each centroid: one gather for each dimension, summed."""
        low, high = values.min(axis=0), values.max(axis=0)
        if self.low is None or (low < self.low).any() or (high > self.high).any():
            self._cover(low, high)
        kind = self.kind if self.tables else self._kind(int(np.abs(values).max()))
        total = np.zeros((len(values), len(self.centroids)), dtype=kind)
        for n, column in enumerate(values.T):
            if self.tables:
                total += np.take(self.tables[n], (column - self.low[n]).astype(np.intp), axis=0)
            else:
                occurring, place = np.unique(column, return_inverse=True)
                total += np.take(self._table(n, occurring, kind), place, axis=0)
        return total

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, of equal ones the smallest, and the distance."""
        every = self.distances(values)
        best = every.argmin(axis=1)
        return best, every[np.arange(len(best)), best]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE))


def _sums(vectors: DataFrame, centroids: list[list[int]], size: int, scale: float) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors their number and their componentwise sums."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        tables, count = Tables(shared.value), len(shared.value)
        totals = np.zeros((count, size + 1), dtype=object)
        for batch in _slices(batches):
            values = integers(batch.column("vector"), size, scale)
            best, _ = tables.nearest(values)
            order = np.argsort(best, kind="stable")
            found, begins = np.unique(best[order], return_index=True)
            wide = np.abs(values).max() > NARROW
            rows = np.array([[int(x) for x in row] for row in values[order]], dtype=object) if wide else values[order].astype(np.int64)
            totals[found, :size] += np.add.reduceat(rows, begins, axis=0).astype(object)
            totals[found, size] += np.diff([*begins, len(order)]).astype(object)
        used = [n for n in range(count) if totals[n, size]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(used, np.int32), size + 1)),
                pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(used))),
                pa.array([Decimal(x) for n in used for x in totals[n]], pa.decimal128(38, 0)),
            ],
            names=["cluster", "place", "total"],
        )

    parts = vectors.select("vector").mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    rows = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    totals = {(row["cluster"], row["place"]): int(row["total"]) for row in rows}
    used = sorted({cluster for cluster, _ in totals})
    return {n: (totals[n, size], [totals[n, place] for place in range(size)]) for n in used}


def first_centroids(vectors: DataFrame, size: int, scale: float, clusters: int, seed: str) -> list[list[int]]:
    """The ``clusters`` vectors whose id has the smallest hash; of equal hashes the smaller vector, NULL ids last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    column = pa.array([list(map(float, row["vector"])) for row in rows], pa.list_(pa.float64()))
    return [[int(x) for x in row] for row in integers(column, size, scale)]


def fit(vectors: DataFrame, size: int, scale: float, clusters: int, rounds: int, seed: str) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; one without vectors stays where it was."""
    centroids = first_centroids(vectors, size, scale, clusters, seed)
    for _ in range(rounds if centroids else 0):
        for n, (count, sums) in _sums(vectors, centroids, size, scale).items():
            centroids[n] = [total // count for total in sums]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], size: int, scale: float) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of each vector; a distance beyond 64 bits is the largest they hold."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        tables = Tables(shared.value)
        for batch in _slices(batches):
            best, distance = tables.nearest(integers(batch.column("vector"), size, scale))
            if distance.dtype == object:
                distance = np.minimum(distance, LARGEST)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(best.astype(np.int32)), pa.array(distance.astype(np.int64))],
                names=["id", "cluster", "distance"],
            )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def cluster(
    table: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    *,
    size: int = 64,
    scale: float = 256.0,
    clusters: int = 40,
    rounds: int = 5,
    seed: str = "2",
) -> DataFrame:
    """Of each usable vector its id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors of another length, or with a component that is NULL, not finite, or 2^64 or more in size,
    are left out, as are NULL vectors. Components are floor(scale * x), all sums and means exact. The
    first centroids are the vectors whose ids' hashes are smallest (repeated ids: the smaller vector
    first); with fewer vectors than ``clusters`` each is one. Ties go to the smaller number. Repeated
    rows count each time, a NULL id is kept and comes last among the first centroids; an empty table
    gives an empty result; other columns are not read.

    A round is one pass over the vectors: a task looks up its vectors and sums them by cluster, so that
    ``clusters * (size + 1)`` numbers a task are shuffled, and as many in all reach the driver.
    """
    spark = table.sparkSession
    kept = table.where(usable(F.col(vector), size))
    vectors = kept.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    centroids = fit(vectors, size, scale, clusters, rounds, seed)
    assigned = written(assign(vectors, centroids, size, scale))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    inertia = {row["cluster"]: int(row["sum"]) for row in sums}
    rows = [
        (
            n,
            min(own, LARGEST),
            min(sum(inertia.values()), LARGEST),
            hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest(),
        )
        for n, own in inertia.items()
    ]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row for each cluster
    joined = assigned.join(F.broadcast(told), "cluster")
    return joined.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
