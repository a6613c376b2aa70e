"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by their common bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from mascate.llm.frames import map_texts

#: The two kinds of windows that every text has features of: their bytes, how many neighbouring windows
#: compete, and how often one must win. The long ones tell texts apart, the short ones find texts of a line or two
#: within others.
LONG, SHORT = (32, 32, 8), (12, 16, 1)
KINDS = (LONG, SHORT)
#: Steps of the entropy scale; windows under the least step hold too little to tell texts apart.
STEPS, LEAST_STEP = 1000, 200
#: Bits of a filter, bits a feature sets, features of a filter before the next one is begun.
BITS, HASHES, FULL = 2048, 5, 160
#: Documents of a bucket in the order by id, and the most buckets.
BUCKET, MOST_BUCKETS = 4096, 10_000
_BLOCK = 1 << 18
#: Pairs of filters that are compared at a time.
_PAIRS = 1 << 10
_FIXED = 1 << 20
_SUM = np.array([round(c * np.log2(c) * _FIXED) if c else 0 for c in range(LONG[0] + 1)], np.int64)


def entropy_steps(data: np.ndarray, window: int = LONG[0]) -> np.ndarray:
    """The entropy of each window of so many bytes, in steps from 0 to STEPS, in whole numbers throughout.

    The sum of c log c over a window's byte counts changes with the byte that leaves and the one
    that comes; both changes follow from how many of the other bytes after or before it equal it.
    """
    count = len(data) - window + 1
    if count < 1:
        return np.empty(0, np.int16)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, window):
        same = (data[:-k] == data[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    gone, come = ahead[: count - 1], behind[window:]
    change = _SUM[gone] - _SUM[gone + 1] + _SUM[come + 1] - _SUM[come]
    first = int(_SUM[np.bincount(data[:window], minlength=256)].sum())
    sums = np.concatenate(([first], first + np.cumsum(change)))
    most = int(_SUM[window])
    return ((most - sums) * STEPS // most).astype(np.int16)


def _blocks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in lists of about a block, so that many short ones share each numpy call."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _edges(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in block])
    return ends - [len(t) for t in block], ends


def count_steps(texts: list[bytes]) -> np.ndarray:
    """How often each entropy step occurs among the windows of the texts, a row for each kind of window."""
    counts = np.zeros((len(KINDS), STEPS + 1), np.int64)
    for kind, (window, _, _) in enumerate(KINDS):
        for block in _blocks(t for t in texts if len(t) >= window):
            steps = entropy_steps(np.frombuffer(b"".join(block), np.uint8), window)
            inside = np.ones(len(steps), bool)
            starts, _ = _edges(block)
            # windows over the end of one text and the start of the next one
            over = starts[1:, None] - np.arange(1, window)[None, :]
            inside[over.ravel()] = False
            counts[kind] += np.bincount(steps[inside], minlength=STEPS + 1)
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """For each kind the rank of each entropy step, the rarest first; steps of too little entropy come after all."""
    ranks = np.empty(counts.shape, np.int64)
    for own, of in zip(ranks, counts):
        own[np.lexsort((np.arange(STEPS + 1), of))] = np.arange(STEPS + 1)
        own[:LEAST_STEP] += STEPS + 1
    return ranks


def _chosen(block: list[bytes], ranks: np.ndarray, window: int, rivals: int, wins: int) -> list[np.ndarray]:
    """For each text of a block, which of its windows win against their neighbours often enough.

    A text of fewer windows than compete has one contest among them all. Where nobody wins often
    enough, or all windows hold too little entropy, the best one of each contest is taken.
    """
    steps = entropy_steps(np.frombuffer(b"".join(block), np.uint8), window)
    starts, ends = _edges(block)
    place = np.arange(len(steps), dtype=np.int64)
    least = ranks[steps] << 32 | place
    pad = np.full(rivals, np.iinfo(np.int64).max)
    least = np.concatenate((least, pad))
    width = 1
    while width < rivals:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    found = []
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        count = end - start - window + 1
        if count < rivals:
            own = ranks[steps[start : start + count]] << 32 | place[start : start + count]
            winners = own.min(keepdims=True)
        else:
            winners = least[start : start + count - rivals + 1]
        good = winners[winners >> 32 <= STEPS] & 0xFFFFFFFF
        often = np.empty(0, np.int64)
        if len(good):
            times = np.bincount(good - start)
            often = np.flatnonzero(times >= wins)
            if not len(often):
                often = np.flatnonzero(times == times.max())
        found.append(often if len(often) else np.unique(winners & 0xFFFFFFFF) - start)
    return found


def _hashes(data: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each window: its bytes in words of eight, mixed in one after the other."""
    wide = -(-window // 8) * 8
    shown = np.zeros((len(places), wide), np.uint8)
    shown[:, :window] = data[places[:, None] + np.arange(window)]
    words = shown.view("<u8").astype(np.uint64)
    value = np.full(len(places), window, np.uint64)
    for word in words.T:
        value = (value ^ word) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ value >> np.uint64(29)


def _filters(hashes: list[int]) -> bytes:
    """The hashes of features in chained filters: each feature sets HASHES bits of the filter it falls into."""
    features = np.array(list(dict.fromkeys(hashes)), np.uint64)
    count = -(-len(features) // FULL)
    bits = np.zeros(count * BITS, bool)
    filters = np.arange(len(features)) // FULL * BITS
    for n in range(HASHES):
        bits[filters + ((features >> np.uint64(11 * n)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """The digest of each text: its filters one after the other; none for an empty text.

    All texts are treated alike, whatever their size: they have their chosen long windows and their
    chosen short ones, in filters of their own. A text of fewer bytes than a short window is its own.
    """
    distinct = [text for text in dict.fromkeys(texts) if text]
    digest_of = dict.fromkeys(texts, b"")
    for (window, rivals, wins), own in zip(KINDS, ranks):
        for block in _blocks(t for t in distinct if len(t) >= window):
            chosen = _chosen(block, own, window, rivals, wins)
            starts, _ = _edges(block)
            counts = [len(places) for places in chosen]
            every = np.concatenate(chosen) + np.repeat(starts, counts)
            hashes = _hashes(np.frombuffer(b"".join(block), np.uint8), every, window).tolist()
            at = 0
            for text, count in zip(block, counts, strict=True):
                digest_of[text] += _filters(hashes[at : at + count])
                at += count
    for text in distinct:
        if not digest_of[text]:
            digest_of[text] = _filters([xxhash.xxh3_64_intdigest(text)])
    return [digest_of[text] for text in texts]


def likeness(left: bytes, right: bytes) -> float:
    """How alike two digests are, 0 to 1: each filter of the shorter one against its best match.

    Common bits count from what chance gives (0) to all bits of the emptier filter (1), and
    filters count by their bits. Equal digests have 1, an empty one against another 0.
    """
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    a, b = sorted(
        (np.frombuffer(d, np.uint64).reshape(-1, BITS // 64) for d in (left, right)),
        key=lambda d: (len(d), int(np.bitwise_count(d).sum())),
    )
    of_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    step = max(1, _PAIRS // len(b))
    for first in range(0, len(a), step):
        some = a[first : first + step]
        own = np.bitwise_count(some).sum(axis=1, dtype=np.int64)
        common = np.bitwise_count(some[:, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
        chance = own[:, None] * of_b / BITS
        room = np.maximum(np.minimum(own[:, None], of_b) - chance, 1e-9)
        total += float((own * np.clip((common - chance) / room, 0, 1).max(axis=1)).sum())
        weight += float(own.sum())
    return total / weight if weight else 0.0


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The ranks of the entropy steps from the windows of all texts; 1,001 counts for each kind reach the driver."""

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            counts = count_steps([t.encode("utf-8", "surrogatepass") for t in texts]).ravel()
            seen = np.flatnonzero(counts)
            none = [None] * (len(texts) - 1)
            steps = pa.array([seen.tolist(), *none][: len(texts)], pa.list_(pa.int32()))
            return [steps, pa.array([counts[seen].tolist(), *none][: len(texts)], pa.list_(pa.int64()))]

        return work

    counted = map_texts(docs.select(F.col(text).alias("text")), [], "text", start, "steps array<int>, counts array<long>")
    each = counted.where("steps is not null").select(F.explode(F.arrays_zip("steps", "counts")).alias("c"))
    sums = each.groupBy(F.col("c.steps").alias("step")).agg(F.sum("c.counts").alias("windows")).collect()
    counts = np.zeros(len(KINDS) * (STEPS + 1), np.int64)
    for row in sums:
        counts[row["step"]] = row["windows"]
    return rarity_ranks(counts.reshape(len(KINDS), STEPS + 1))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep`` and ``digest``, binary: equal texts have equal ones, NULL counts as empty."""
    ranks = corpus_ranks(docs, text) if ranks is None else ranks

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array(digests([t.encode("utf-8", "surrogatepass") for t in texts], ranks), pa.binary())]

        return work

    return map_texts(docs, keep, text, start, "digest binary")


def _in_buckets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, bucket, extra): the documents dealt out by ranges of descending ids.

    The first document after a bucket is put into it once more, as ``extra``, so that each
    document meets the next one. One row per bucket reaches the driver, to say which that is.
    """
    from pyspark.ml.feature import Bucketizer  # a large import that only this needs

    known = F.col(doc_id)
    if not isinstance(docs.schema[doc_id].dataType, NumericType):
        # the first six bytes as a number: in order, and exact as a double
        known = F.conv(F.rpad(F.hex(F.substring(known.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10)
    place = F.coalesce(known.cast("double"), F.lit(float("-inf")))
    named = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), place.alias("place"))
    rows, least = named.agg(F.count(F.lit(1)), F.min(F.when(F.col("place") > float("-inf"), F.col("place")))).first()
    count = max(1, min(MOST_BUCKETS, rows // BUCKET))
    shares = [n / count for n in range(1, count)]
    cuts = named.where("id is not null").approxQuantile("place", shares, 0.1 / count) if shares else []
    splits = [float("-inf"), *sorted({c for c in cuts if least is not None and c > least}), float("inf")]
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep").transform(named)
    else:
        dealt = named.withColumn("bucket", F.lit(0.0))
    dealt = dealt.withColumn("bucket", F.col("bucket").cast("int"))
    firsts = sorted(
        ((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.max("place").alias("first")).collect()),
        reverse=True,
    )
    after = [(firsts[n][0], firsts[(n + 1) % len(firsts)][1]) for n in range(len(firsts))]
    spark = docs.sparkSession
    tails = spark.createDataFrame(after, "into int, place double").groupBy("place").agg(F.collect_list("into").alias("into"))
    own = F.array(F.struct("bucket", F.lit(False).alias("extra")))
    others = F.transform("into", lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("extra")))
    copies = F.when(F.col("into").isNull(), own).otherwise(F.concat(own, others))
    # one row per bucket at most, so the broadcast is bounded by MOST_BUCKETS
    shown = dealt.join(F.broadcast(tails), "place", "left").select("id", "text", "place", F.inline(copies))
    order = ["bucket", "extra", F.desc("place"), F.desc_nulls_last("id"), F.xxhash64("text")]
    return shown.repartition(max(1, len(firsts)), "bucket").sortWithinPartitions(*order).drop("place")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with its digest, that of its edited text, and how alike both and the next one are.

    (doc_id, n_chars, edited_sha256, digest, edited_digest, near_edited, near_next). The next
    document is that of the next smaller doc_id, after the last one the first; NULL ids are last,
    equal ids in the order of a hash of their texts. Ids are numbers or strings. The edited text has the last third of the
    code points replaced by the first as many of the next document, or by all it has.

    Texts are moved once, to buckets of neighbouring ids that are read as streams; no more than a
    batch of texts is held at a time.
    """
    ranks = corpus_ranks(docs, text)
    fields = pa.schema(
        [
            ("doc_id", to_arrow_type(docs.schema[doc_id].dataType)),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("digest", pa.binary()),
            ("edited_digest", pa.binary()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )

    def judged(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [own.encode("utf-8", "surrogatepass") for _, own, _ in pairs]
        nexts = [after.encode("utf-8", "surrogatepass") for _, _, after in pairs]
        changed = []
        for _, own, after in pairs:
            third = len(own) // 3
            changed.append((own[: len(own) - third] + after[:third]).encode("utf-8", "surrogatepass"))
        n = len(pairs)
        every = digests(texts + nexts + changed, ranks)
        mine, theirs, edited = every[:n], every[n : 2 * n], every[2 * n :]
        columns = [
            [doc for doc, _, _ in pairs],
            [len(own) for _, own, _ in pairs],
            [hashlib.sha256(t).hexdigest() for t in changed],
            mine,
            edited,
            [likeness(a, b) for a, b in zip(mine, edited, strict=True)],
            [likeness(a, b) for a, b in zip(mine, theirs, strict=True)],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pairs, size = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "bucket", "extra")), strict=True):
                if last is not None and last[2] == row[2] and not last[3]:
                    pairs.append((last[0], last[1], row[1]))
                    size += len(last[1])
                    if size >= 8 * _BLOCK:
                        yield judged(pairs)
                        pairs, size = [], 0
                last = row
        if pairs:
            yield judged(pairs)

    schema = (
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_chars long, edited_sha256 string, digest binary, edited_digest binary, "
        "near_edited double, near_next double"
    )
    return _in_buckets(docs, doc_id, text).mapInArrow(run, schema)
