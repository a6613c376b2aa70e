"""Mixing: rake token weights to marginal targets, then sample documents by calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import whole_rows, words_of, written
from mascate.operators.lookup import lookup

DIMENSIONS = ("source", "lang", "topic")
#: Targets that are not given are the observed token shares to this power, so small ones gain.
TEMPER = 0.5
#: The share of all tokens that a sample is expected to have.
SHARE = 0.8
#: Rounds end when no cell has moved by more than this, or after so many.
TOLERANCE, MOST_ROUNDS = 1e-5, 500
#: Cells that are raked on the driver.
FEW_CELLS = 50_000
#: How far an expected share may be from its target to count as met.
SLACK = 1e-3
SEED = 20_260
NONE = "(none)"


def n_words(text: Column) -> Column:
    return F.size(words_of(text))


def form_topic(text: Column, words: Column) -> Column:
    """A topic by the text's form, for tables that have no topic: over the whole text, no model."""
    text = F.coalesce(text, F.lit(""))

    def share(characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    return (
        F.when(5 * share("|") > words, "table")
        .when(8 * share("0123456789") > F.length(text), "figures")
        .when(words < 100, "note")
        .when(words < 1000, "article")
        .otherwise("book")
    )


def prepared(docs: DataFrame, text: str = "text", topic: str | None = None) -> DataFrame:
    """``row`` and its three categories as strings (NULL: ``(none)``) and ``tokens``, its words."""
    row = whole_rows(docs)
    words = n_words(F.col(f"row.{text}"))
    named = [F.coalesce(F.col(f"row.{c}").cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")]
    counted = row.select("row", *named, words.cast("long").alias("tokens"))
    about = F.col(f"row.{topic}").cast("string") if topic else form_topic(F.col(f"row.{text}"), F.col("tokens"))
    return counted.withColumn("topic", F.coalesce(about, F.lit(NONE)))


def cells_of(rows: DataFrame) -> DataFrame:
    """A row for each combination of the categories that occurs, with its tokens."""
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")


def _targets(cells: DataFrame, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """(dimension, share): shares of the values that occur, adding up to 1; values not given get nothing."""
    seen = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        rated = seen.select(dimension, F.pow("tokens", F.lit(temper)).alias("raw"))
    else:
        asked = cells.sparkSession.createDataFrame(
            [(str(value), float(share)) for value, share in given.items()], f"{dimension} string, raw double"
        )
        rated = seen.join(asked, dimension).select(dimension, "raw")
    rated = rated.where("raw > 0")
    total = rated.agg(F.sum("raw")).first()[0]
    return rated.select(dimension, (F.col("raw") / F.lit(total)).alias("share"))


def rake(
    cells: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    share: float = SHARE,
    bound: float | None = 1.0,
) -> DataFrame:
    """The cells with ``expected``, the copies of each of their documents, and ``moved``.

    Iterative proportional fitting: each round scales the cells to one marginal after the other, all
    of them to ``share`` of all tokens. Under ``bound`` no cell gives more than that many copies of
    itself: a value that has too little scales up its cells that are not yet whole, one that has
    too much scales down all of its cells. So marginals that can be met together under the bound are met,
    and the others come as near as their cells allow (``shares`` tells which). Rounds end when no
    cell has moved by more than ``TOLERANCE``, or that part of its copies; ``moved`` is the largest
    move of the last round, over ``TOLERANCE`` if ``MOST_ROUNDS`` came first.

    Up to ``FEW_CELLS`` cells are raked as numpy arrays on the driver. More stay a table, whatever
    their number: each round's result is written, and only the largest move reaches the driver.
    Both do the same.
    """
    cells = written(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    now = cells.withColumn("expected", F.lit(float(share)))
    for d in DIMENSIONS:
        wanted = _targets(cells, d, (targets or {}).get(d), temper).withColumnRenamed("share", f"share_{d}")
        now = lookup(now, wanted, d, "inner")
    now = written(now.withColumn("moved", F.lit(0.0)))
    if now.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        return _raked_here(now, total * share, bound)
    for _ in range(MOST_ROUNDS):
        before = F.col("before")
        now = now.withColumn("before", F.col("expected"))
        for d in DIMENSIONS:
            given = F.col("tokens") * F.col("expected")
            whole = F.lit(False) if bound is None else F.col("expected") >= bound
            sums = now.groupBy(d).agg(
                F.sum(given).alias("given"), F.sum(F.when(whole, given).otherwise(0.0)).alias("whole")
            )
            wanted, left = F.col(f"share_{d}") * F.lit(total * share), F.col("given") - F.col("whole")
            factor = F.when(wanted <= F.col("given"), wanted / F.col("given")).when(
                left > 0, (wanted - F.col("whole")) / left
            )
            scaled = F.col("expected") * F.coalesce(factor, F.lit(1.0))
            now = lookup(now, sums, d, "inner").withColumn(
                "expected", scaled if bound is None else F.least(F.lit(float(bound)), scaled)
            )
            now = now.drop("given", "whole")
        now = written(now.withColumn("moved", F.abs(F.col("expected") - before) / F.greatest(before, F.lit(1.0))).drop("before"))
        largest = now.agg(F.max("moved")).first()[0]
        if largest is None or largest <= TOLERANCE:
            break
    last = now.agg(F.max("moved")).first()[0]
    return now.select(*DIMENSIONS, "tokens", "expected", F.lit(last).cast("double").alias("moved"))


def _raked_here(cells: DataFrame, asked: float, bound: float | None) -> DataFrame:
    """:func:`rake` for few cells."""
    rows = cells.orderBy(*DIMENSIONS).collect()
    tokens, expected = (np.array([row[c] for row in rows], float) for c in ("tokens", "expected"))
    most, moved = float("inf") if bound is None else bound, 0.0
    marginals = []
    for d in DIMENSIONS:
        values, place = np.unique([row[d] for row in rows], return_inverse=True)
        wanted = np.zeros(len(values))
        wanted[place] = [row[f"share_{d}"] * asked for row in rows]
        marginals.append((place, wanted))
    for _ in range(MOST_ROUNDS if rows else 0):
        before = expected
        for place, wanted in marginals:
            own = tokens * expected
            given = np.bincount(place, own)
            whole = np.bincount(place, np.where(expected >= most, own, 0.0))
            left = given - whole
            up = np.where(left > 0, (wanted - whole) / np.where(left > 0, left, 1.0), 1.0)
            expected = np.minimum(most, expected * np.where(wanted <= given, wanted / given, up)[place])
        moved = float((np.abs(expected - before) / np.maximum(before, 1.0)).max())
        if moved <= TOLERANCE:
            break
    kind = ", ".join(f"{d} string" for d in DIMENSIONS) + ", tokens double, expected double, moved double"
    raked = [(*[row[d] for d in DIMENSIONS], row["tokens"], float(e), moved) for row, e in zip(rows, expected)]
    return cells.sparkSession.createDataFrame(raked, kind)


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    topic: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    share: float = SHARE,
    repeats: bool = False,
) -> DataFrame:
    """A row per document: ``row``, the categories, tokens, probability, whether it is sampled, expected copies and copies.

    ``targets`` gives shares of tokens by category value for source, lang or topic; a marginal that
    is not given is tempered; ``share`` of all tokens is asked for. Documents are taken by a hash of
    id and text, uniform over 0 to 1, that is under their cell's calibrated probability: the
    same document always gets the same answer, and repeated rows share it. No document is taken
    twice, so targets beyond what cells have are missed; ``shares`` tells which and by how much.

    With ``repeats`` cells with too little repeat their documents instead and all targets are met:
    ``copies`` is the whole part of ``expected``, and one more if the hash is under the rest. NULL
    categories are a category of their own. Documents without a token, or of a value without a
    target, have probability 0. ``moved`` tells whether raking has settled. Other columns are in
    ``row``, where no name clashes. An empty table gives no rows.
    """
    rows = prepared(docs, text, topic)
    cell = F.concat_ws("\x1f", *DIMENSIONS)
    raked = rake(cells_of(rows), targets, temper, share, None if repeats else 1.0)
    chances = written(raked.select(cell.alias("cell"), "expected", "moved"))
    rated = lookup(rows.withColumn("cell", cell), chances, "cell").drop("cell")
    # 52 bits of the hash, so that the quotient is exact and under 1
    point = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), f"row.{doc_id}", f"row.{text}"), 12) / F.lit(float(1 << 52))
    expected = F.when(F.col("tokens") > 0, F.coalesce("expected", F.lit(0.0))).otherwise(F.lit(0.0))
    rated = rated.withColumn("expected", expected)
    rated = rated.withColumn("probability", F.least(F.lit(1.0), F.col("expected")))
    rated = rated.withColumn("sampled", point < F.col("probability"))
    whole = F.floor("expected")
    copies = whole + (point < F.col("expected") - whole).cast("long")
    names = ["row", *DIMENSIONS, "tokens", "probability", "sampled", "expected"]
    return rated.select(*names, copies.alias("copies"), "moved")


def shares(
    mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER
) -> DataFrame:
    """(dimension, value, target, expected, reached, met, settled): of each category value the shares of tokens.

    ``target`` is NULL for a value without one. ``expected`` follows from the probabilities,
    ``reached`` from the documents taken. ``met`` is whether ``expected`` is the target within
    ``SLACK``, ``settled`` whether raking came to rest: where both are false, more rounds might
    have met the target; where only ``met`` is, the cells cannot. ``targets`` and ``temper`` are
    those given to ``mix``.
    """
    given = [F.sum(F.col("tokens") * F.col(c)).cast("double").alias(c) for c in ("expected", "copies")]
    given.append(F.max("moved").alias("moved"))
    cells = written(mixed.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"), *given).where("tokens > 0"))
    every = cells.agg(
        F.sum("expected").alias("expected"), F.sum("copies").alias("copies"), F.max("moved").alias("moved")
    ).first()
    parts = []
    for d in DIMENSIONS:
        wanted = _targets(cells, d, (targets or {}).get(d), temper).withColumnRenamed("share", "target")
        sums = cells.groupBy(d).agg(F.sum("expected").alias("expected"), F.sum("copies").alias("copies"))
        parts.append(
            sums.join(wanted, d, "left").select(
                F.lit(d).alias("dimension"),
                F.col(d).alias("value"),
                "target",
                (F.col("expected") / F.lit(every["expected"] or 1.0)).alias("expected"),
                (F.col("copies") / F.lit(every["copies"] or 1.0)).alias("reached"),
            )
            .withColumn("met", F.abs(F.col("expected") - F.col("target")) <= SLACK)
            .withColumn("settled", F.lit(every["moved"] is not None and every["moved"] <= TOLERANCE))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sample(docs: DataFrame, copies: str | None = None, **options) -> DataFrame:
    """The sampled documents, all columns, each once.

    ``copies`` names a column that tells how often each of them is to be repeated; only with it are
    documents repeated at all. They are encoded and stored once, whoever reads them repeats them.
    """
    mixed = mix(docs, repeats=copies is not None, **options).where("copies > 0")
    return mixed.select("row.*", *([F.col("copies").alias(copies)] if copies else []))
