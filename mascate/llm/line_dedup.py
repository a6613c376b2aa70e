"""Repeated runs of lines: a suffix array by prefix doubling, its intervals, and the deletion of later copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from mascate.llm.frames import SPACE, checkpointed, whole_rows
from mascate.operators.lookup import lookup

#: A run counts as repeated if it has this many words. Each line has one at least, so it bounds the lines too.
MIN_WORDS = 4
_LINES = 10**10


def _unit(doc_id: str, text: str) -> list[Column]:
    """What tells documents apart; a NULL id is before all others."""
    return [F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark")]


def _sequences(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """(id, mark, seq, line, words, key): the lines with a word, counted by ``seq``; ``line`` is the place in the text.

    Two 64-bit hashes, with the white space at the ends cut off, stand for a line. ``words`` stops
    at ``min_words``, as no more is asked.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    clean = F.transform(
        lines, lambda line, at: F.struct(at.alias("line"), F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "").alias("s"))
    )
    worded = F.filter(clean, lambda line: line["s"] != "")
    each = docs.select(*_unit(doc_id, text), F.posexplode(worded).alias("seq", "at"))
    words = F.size(F.split("at.s", f"{SPACE}+", min_words + 1))
    return each.select(
        "id",
        "mark",
        "seq",
        F.col("at.line").alias("line"),
        F.least(words, F.lit(min_words)).alias("words"),
        F.xxhash64("at.s").alias("h1"),
        F.xxhash64(F.lit("second"), "at.s").alias("h2"),
    )


def _place(kind: DataType) -> Column:
    """Where a line stands among all lines, by id and place, NULL ids first: in one number if ids are numbers."""
    if not isinstance(kind, NumericType):
        return F.struct("id", "seq")
    number = F.coalesce(F.col("id"), F.lit(-(2**63))).cast("decimal(20,0)")
    return (number * F.lit(_LINES).cast("decimal(11,0)") + F.col("seq")).cast("decimal(38,0)")


def _ranked(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The rows whose keys occur twice or more, with the keys' ``rank`` in their order.

    Only repeated keys are sorted: a prefix that occurs once ends its suffix's part in any run.
    """
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(*keys)
    ordered = repeated.orderBy(*keys).withColumn(rank, F.monotonically_increasing_id())
    ordered = ordered.withColumn("both", F.struct(*keys)).select("both", rank)
    return lookup(rows.withColumn("both", F.struct(*keys)), checkpointed(ordered), "both", "inner").drop("both")


def _ahead(column: str, lines: int) -> Column:
    """The column's value so many lines further in the document; NULL if that line is not there."""
    return F.max(column).over(_document().rangeBetween(lines, lines))


def _document():
    return Window.partitionBy("id", "mark").orderBy("seq")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, mark, line, first): the lines to delete, each in a later copy of a repeated run of lines.

    Suffixes of the documents' line sequences are ranked by their first line, then by 2, 4, ...
    lines from the ranks at half the length, until a run of ``min_words`` words must be covered.
    The suffixes that share their first lines up to so many words are an interval of the suffix
    array; two ranks at the next smaller power of two name it. All of an interval but its first
    member are later copies. A longer run consists of such windows, each the shortest from its
    first or to its last line, and all are deleted in all copies but the first.

    ``first`` counts as earlier by id, then by place, also within a document. Rows that share an
    id and a text are one document. Nothing but (hash, rank, place) of lines is moved, repeated
    lines only after the first rank; the ranks of each round are checkpointed.
    """
    lines = checkpointed(_sequences(docs, doc_id, text, min_words).distinct())
    ranked = _ranked(lines, ["h1", "h2"], "rank0").drop("h1", "h2")
    power = 0
    ranks = checkpointed(ranked)
    while 2 << power <= min_words:
        half, power = f"rank{power}", power + 1
        pairs = ranks.withColumn("second", _ahead(half, 1 << (power - 1)))
        # a half without a rank is not repeated, and NULLs would count as equal
        both = pairs.where(F.col(half).isNotNull() & F.col("second").isNotNull())
        longer = _ranked(both, [half, "second"], f"rank{power}")
        longer = longer.select("id", "mark", "seq", f"rank{power}")
        same = [F.col("l.id").eqNullSafe(F.col("r.id")), F.col("l.mark") == F.col("r.mark"), F.col("l.seq") == F.col("r.seq")]
        joined = ranks.alias("l").join(longer.alias("r"), same, "left")
        ranks = checkpointed(joined.select("l.*", f"r.rank{power}"))
    return _later_copies(ranks, min_words)


def _later_copies(ranks: DataFrame, min_words: int) -> DataFrame:
    def run(first: int, last: int) -> Column:
        """The words from so many to so many lines ahead; NULL where a line is missing."""
        lines = F.count("words").over(_document().rangeBetween(first, last))
        return F.when(lines == last - first + 1, F.sum("words").over(_document().rangeBetween(first, last)))

    windows = []
    for size in range(1, min_words + 1):
        power = size.bit_length() - 1
        shorter = [run(1, size - 1), run(0, size - 2)] if size > 1 else [F.lit(0)]
        shortest = run(0, size - 1) >= min_words
        least = F.least(*shorter) if size > 1 else shorter[0]
        windows.append(
            F.when(
                shortest & (least < min_words),
                F.struct(
                    F.lit(size).alias("size"),
                    F.col(f"rank{power}").alias("head"),
                    _ahead(f"rank{power}", size - (1 << power)).alias("tail"),
                    F.array(*[_ahead("line", n) for n in range(size)]).alias("covered"),
                ),
            )
        )
    held = ranks.select("id", "mark", "seq", F.array(*windows).alias("windows"))
    found = held.select("id", "mark", "seq", F.explode("windows").alias("window"))
    found = found.where("window.head is not null and window.tail is not null")
    key = F.struct("window.size", "window.head", "window.tail")
    found = found.select("id", "mark", _place(ranks.schema["id"].dataType).alias("place"), key.alias("key"), "window.covered")
    first = found.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    later = lookup(found, first.where("first < last"), "key", "inner").where("place > first")
    return later.select("id", "mark", F.explode("covered").alias("line")).distinct()


def deletions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, mark, deleted): for each document that loses lines, their places in order."""
    lines = repeated_lines(docs, doc_id, text, min_words)
    return lines.groupBy("id", "mark").agg(F.array_sort(F.collect_set("line")).alias("deleted"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``row``, ``deleted`` (the places of the lines to delete, counted from 0) and ``cleaned``, the text without them.

    Every row stays; a NULL text stays NULL and an empty one empty. Repeated rows get equal
    answers. Extra columns are carried in ``row``.
    """
    unit = [F.col("row." + doc_id).alias("id"), F.xxhash64("row." + text).alias("mark")]
    rows = whole_rows(docs).select("row", *unit)
    found = deletions(docs, doc_id, text, min_words)
    same = [F.col("l.id").eqNullSafe(F.col("r.id")), F.col("l.mark") == F.col("r.mark")]
    joined = rows.alias("l").join(found.alias("r"), same, "left").select("row", "deleted")
    lines = F.split(F.col("row." + text), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "deleted")
    kept = F.concat_ws("\n", F.transform(places, lambda at: F.get(lines, at)))
    return joined.withColumn("cleaned", F.when(F.col("deleted").isNull(), F.col("row." + text)).otherwise(kept))


def drop_later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents, all columns, without their later copies; one that loses all its words goes.

    ``n_chars``, if there is such a column, follows the new text.
    """
    cleaned = dedup_lines(docs, doc_id, text)
    gone = F.col("deleted").isNotNull() & ~F.coalesce(F.col("cleaned"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    columns = []
    for name in docs.columns:
        value = F.col(f"row.{name}")
        if name == text:
            value = F.col("cleaned")
        elif name == n_chars:
            changed = F.length("cleaned").cast(docs.schema[name].dataType)
            value = F.when(F.col("deleted").isNotNull(), changed).otherwise(value)
        columns.append(value.alias(name))
    return cleaned.where(~gone).select(*columns)
