"""Small tables with the odd rows that every operator must stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use for itself.
CLASHING = "fp long, tokens string, word string, row string, key string, seq int, spans string, score double"

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau."


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text) if text is not None else None)


ODD = [
    document(1, LONG),
    document(2, LONG),
    document(2, LONG),
    document(3, None, None, None),
    document(4, ""),
    document(5, " \t\n "),
    document(None, "A text without an id, of some ten words or perhaps eleven.", None),
    document(None, None),
    document(6, "word " * 30_000),
    document(7, "a" * 50_000),
    document(8, "\x00     é 日本語 \U0001f600 ß"),
    document(9, "one\n\n two \none\n\ntwo\nthree four five six\nthree four five six\n"),
]


def table(spark: SparkSession, rows, schema=SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def odd(spark: SparkSession) -> DataFrame:
    """The odd rows, with columns that clash."""
    names = [part.split()[0] for part in CLASHING.split(", ")]
    rows = [(*row, *[None] * len(names)) for row in ODD]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
