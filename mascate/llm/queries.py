"""Each operator over its whole table with production parameters, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mascate.llm import (
    bpe,
    digest,
    line_dedup,
    mixing,
    periodic_runs,
    pii,
    quality_bayes,
    quality_rules,
    secrets,
    simhash,
    table_kmeans,
    toxicity,
    url_filter,
)
from mascate.llm.frames import sha256_hex, words_of
from mascate.llm.oracles import ORACLES as ORACLES

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.withColumn("score", F.round("score", 6))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [kind.name for kind in pii.KINDS if kind.always]
    kinds = F.col("spans.kind")
    counts = {f"n_{k}": F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in base}
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[value.cast("long").alias(name) for name, value in counts.items()],
        sha256_hex(pii.joined(of_base)).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"),
    )


def bpe_digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the token ids, and the digests of the ids and of the decoded text."""
    encoded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), keep, decoded="decoded")
    return encoded.select(
        *keep,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        sha256_hex(F.col("ids")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
        "ids",
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), ["doc_id"]).drop("ids")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = digest.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("digest")).alias("fingerprint"),
        F.lower(F.hex("edited_digest")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "row.doc_id",
        F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.concat_ws(",", F.col("deleted").cast("array<string>")), F.lit("")).alias("deleted"),
        F.col("cleaned").alias("text"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    base = quality_rules.passes("base")
    return judged.withColumns({"base_failed": ~base, "kept": base & quality_rules.passes(quality_rules.POLICY)})


def op8_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.policy_report(quality_rules.ledger(table(spark, sf_dir, "documents"), ["doc_id"]))


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumns({c: F.round(c, 6) for c in ("evidence", "site_rate", "score")})


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    chance = F.round("probability", 9).alias("probability")
    return mixed.select("row.doc_id", "source", "lang", "topic", "tokens", chance, "sampled", "copies")


def op10_mixing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.shares(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.withColumns({c: F.round(c, 9) for c in ("target", "expected", "reached")})


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents, of which one in ten by a hash of its id repeats some of its words up to its end."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = words_of(F.col("text"))
    n = F.size(words)
    turn = F.floor(mark / 10)
    begin = F.pmod(turn, n).cast("int")
    period = (1 + F.floor((n - begin) / (3 + F.pmod(turn, F.lit(8))))).cast("int")
    again = F.array_repeat(F.slice(words, begin + 1, period), F.ceil((n - begin) / period).cast("int"))
    tail = F.slice(F.concat(F.slice(words, F.lit(1), begin), F.flatten(again)), F.lit(1), n)
    edited = F.when((mark % 10 == 0) & (n > 0), F.array_join(tail, " ")).otherwise(F.col("text"))
    return docs.select("doc_id", edited.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_periodic_tails(table(spark, sf_dir, "documents")), ["doc_id"])
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    # by start, then period: of equal ones the first stays
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.try_element_at("runs", F.lit(1)),
        lambda most, run: F.when(run["length"] * most["period"] > most["length"] * run["period"], run).otherwise(most),
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha256_hex(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        sha256_hex(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"), ["doc_id"])
    kinds = F.col("spans.kind")
    counts = {f"n_{kind}": F.size(kinds) - F.size(F.array_remove(kinds, kind)) for kind in secrets.FORMS}
    base = F.filter("spans", lambda s: s["kind"].isin(list(secrets.FORMS)))
    return found.select(
        "doc_id",
        *[value.cast("long").alias(name) for name, value in counts.items()],
        sha256_hex(pii.joined(base)).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op8_rule_ablation": op8_rule_ablation,
    "op9_quality_bayes": op9_quality_bayes,
    "op10_mixing": op10_mixing,
    "op10_mixing_shares": op10_mixing_shares,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secrets": op12_secrets,
    "op13_centroid_clusters": op13_centroid_clusters,
}
