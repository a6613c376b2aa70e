"""Near-duplicates by SimHash: fingerprints, their links by multi-index hashing, and the classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.llm.components import component_of
from mascate.llm.frames import checkpointed, map_texts
from mascate.operators.lookup import lookup

SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HALF = 32
#: A bucket with more fingerprints than this links them by the points halfway between them.
PAIRED_BUCKET = 256
_BLOCK = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: bit b is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts))
    return int(bits.view(">i8")[0])


def fingerprints(
    docs: DataFrame, keep: list[str], text: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""

    def start():
        return lambda texts: [pa.array([fingerprint(t, shingle_words) for t in texts], pa.int64())]

    return map_texts(docs, keep, text, start, "fp long")


def _distance(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def _flips(width: int, most: int) -> list[int]:
    """The masks of at most ``most`` bits (0, 1 or 2) of ``width``."""
    ones = [1 << b for b in range(width)]
    twos = [a | b for a in ones for b in ones if a < b]
    signed = [0, *ones, *(twos if most > 1 else [])]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _ball(value: Column, width: int, most: int) -> Column:
    """An array of all values at most ``most`` flipped bits away."""
    masks = F.split(F.lit(" ".join(map(str, _flips(width, most)))), " ").cast("array<bigint>")
    return F.transform(masks, lambda m: m.bitwiseXOR(value))


def _near(fps: DataFrame) -> DataFrame:
    """(key, fp, flip): for each half of each fingerprint, the half and its neighbours at one bit.

    ``key`` holds the half's side and value in one long, ``flip`` the flipped bit from 1 on, 0 for none.
    """
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned("fp", HALF).bitwiseOR(F.lit(1 << HALF))
    halves = fps.select("fp", F.explode(F.array(low, high)).alias("half"))
    near = halves.select("fp", F.posexplode(_ball(F.col("half"), HALF, 1)).alias("flip", "key"))
    return near.select("key", "fp", "flip").repartition("key")


def links(fps: DataFrame, paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as differing in 4 bits or fewer does.

    Two such fingerprints differ in at most 2 bits of one half at least. So the Hamming ball of
    radius 1 is enumerated around each half, as table and as queries: halves at distance 2 or less
    meet in a common neighbour. Of the places where a pair meets one is kept, and the distance is
    compared over all 64 bits.

    A bucket of more than ``paired_bucket`` fingerprints would compare by the square. Its members
    enumerate the 64-bit ball of radius 2 instead (2,081 points): two of them share a point if,
    and only if, they differ in 4 bits or fewer, and those at a point are tied to the smallest. So
    no fingerprint costs more than a constant, and the classes are the same.

    Spark takes an exploded table to be as small as what it came from: it would make the points of
    a few thousand fingerprints in one task and broadcast them through the driver. So the number of
    tasks is given, and the join told to sort and merge; its sides share one shuffle of the points.
    """
    near = _near(fps.where(F.col("fp").isNotNull()))
    crowded = near.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    crowded = crowded.where(F.col("members") > paired_bucket).select("key")
    thin = near.join(crowded, "key", "left_anti")
    a, b = thin.alias("a"), thin.alias("b")
    meet = (F.col("b.flip") == 0) | ((F.col("a.flip") > 0) & (F.col("a.flip") < F.col("b.flip")))
    close = _distance(F.col("a.fp"), F.col("b.fp")) <= MAX_DISTANCE
    paired = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")) & meet & close)
    paired = paired.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    spark = fps.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dense = near.join(crowded, "key", "left_semi").select("fp").repartition(tasks, "fp").distinct()
    points = dense.select("fp", F.explode(_ball(F.col("fp"), 64, 2)).alias("point")).repartition("point")
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("members"))
    halfway = points.join(least.where("members > 1").drop("members").hint("merge"), "point")
    tied = halfway.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return paired.unionByName(tied).distinct()


def _classes(prints: DataFrame, paired_bucket: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint; root is the smallest one of its class."""
    first = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(component_of(links(first.select("fp"), paired_bucket))).withColumnRenamed("node", "fp")
    linked = roots.join(first, "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = lookup(roots, of_root, "root", "inner").select("fp", "root", "component_id")
    named = first.join(of_linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return named


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    paired_bucket: int = PAIRED_BUCKET,
) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    A NULL text counts as empty; texts without a word have the fingerprint zero and are linked as
    any other. Repeated rows keep a row each. A NULL doc_id is never the smallest of a class that
    has any other. No rows give no rows; other columns are not read.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = checkpointed(fingerprints(named, ["doc_id"], "text", shingle_words))
    found = lookup(prints, _classes(prints, paired_bucket).drop("root"), "fp", "inner")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each class the one with the smallest doc_id stays.

    Documents are told apart by doc_id and text. Of equal ids in a class one text stays, of
    repeated rows one; a NULL id stays only where a class has no other.
    """
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"))
    named = docs.select(key.alias("unit"), F.col(text).alias("text"))
    prints = checkpointed(fingerprints(named, ["unit"], "text"))
    prints = prints.withColumn("doc_id", F.col("unit.doc_id"))
    in_class = lookup(prints, _classes(prints, PAIRED_BUCKET).select("fp", "root"), "fp", "inner")
    units = in_class.groupBy("root", "unit").agg(F.count(F.lit(1)).alias("copies"))
    best = units.groupBy("root").agg(F.min(F.struct("unit", "copies")).alias("best"))
    best = checkpointed(best.select("best.unit.*", "best.copies"))
    row = F.struct(*[docs[name] for name in docs.columns])
    rows = docs.select(row.alias("row"), key.alias("unit")).select("row", "unit.*")
    same = [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.mark") == F.col("r.mark")]

    def kept(which: DataFrame) -> DataFrame:
        return rows.alias("l").join(which.alias("r"), same, "left_semi")

    once = kept(best.where("copies = 1"))
    repeated = kept(best.where("copies > 1")).dropDuplicates(["doc_id", "mark"])
    return once.unionByName(repeated).select("row.*")
