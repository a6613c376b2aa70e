"""From raw documents to tokens: quality rules, line dedup, near-dedup, mixing, and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mascate.llm import line_dedup, mixing, quality_rules, simhash
from mascate.llm.frames import written
from mascate.llm.queries import bpe_digests


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that consist of nothing else."""
    return line_dedup.drop_later_copies(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to tempered shares of sources, languages and topics."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digests of ids and decoded text."""
    return bpe_digests(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Neither the automaton nor the hashes can be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
