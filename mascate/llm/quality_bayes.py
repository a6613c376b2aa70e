"""Quality by hierarchical empirical Bayes: what a document shows, and what its path and host have shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import written
from mascate.llm.quality_rules import ledger
from mascate.operators.lookup import lookup

#: One label in so many is held out: it trains nothing, so the result can be measured on it.
FOLDS = 5
#: Pseudo-labels that each value of a feature starts with.
SMOOTHING = 1.0
#: What a site's labels are weighed against, between these, as the spread of the sites asks for.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: A document is kept from this probability on.
THRESHOLD = 0.5
NONE = "(none)"


def _steps(value: Column, limits: tuple[float, ...]) -> Column:
    """How many limits the value reaches."""
    return reduce(lambda a, b: a + b, [F.when(value >= limit, 1).otherwise(0) for limit in limits])


def evidence_features() -> dict[str, Column]:
    """What the classifier looks at, each in a few steps, out of the rule ledger's measurements."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "length": _steps(F.col("n_words"), (1, 5, 10, 20, 50, 100, 300, 1000, 3000)),
        "word_size": _steps(F.col("word_chars") / words, (2, 3, 4, 5, 6, 7, 9, 12)),
        "repeats": _steps(F.col("n_repeat_words") / words, (0.01, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9)),
        "symbols": _steps(F.col("n_symbols") / words, (0.01, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
        "capitals": _steps(F.col("n_upper") / letters, (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
        "line_copies": _steps(F.col("n_dup_lines") / lines, (0.01, 0.1, 0.2, 0.35, 0.5, 0.8)),
    }


def _logit(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def _strength(sites: DataFrame, parent_rate: Column) -> float:
    """How many labels the parent's rate is worth, by the method of moments.

    The spread of the sites' rates beyond what chance gives, weighted by labels, over the spread of
    one label. One row reaches the driver.
    """
    n, rate = F.col("labels"), F.col("good") / F.col("labels")
    spread, chance, weight, squares = (
        sites.where("labels > 0")
        .agg(
            F.sum(n * F.pow(rate - parent_rate, F.lit(2.0))),
            F.sum(parent_rate * (1 - parent_rate)),
            F.sum(n),
            F.sum(n * parent_rate * (1 - parent_rate)),
        )
        .first()
    )
    if not weight or not squares or spread is None:
        return MOST_STRENGTH
    share = (spread - chance) / squares
    return MOST_STRENGTH if share <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / share - 1))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    label: str = "quality",
) -> DataFrame:
    """A row per document: ``doc_id``, ``host``, ``path``, ``evidence``, ``site_rate``, ``score``, ``kept``, ``held_out``.

    ``evidence`` is the sum of the log-likelihood ratios of a document's features, from counts over
    all labelled documents. ``site_rate`` is the share of good documents expected of the path: its
    own labels weighed against the host's rate, that against the rate of all, each by a strength
    that the spread between sites gives. A document's own label is taken out of its site first.
    ``score`` joins both by Bayes' rule.

    Host and path may be NULL, which is a site of its own; a site without labels has its parent's
    rate. A NULL text counts as empty. Several labels of a document count as their majority (even:
    good), NULL labels and labels of unknown documents not at all. Without labels every rate is
    one half. Hot sites are summed before they are moved and looked up by ``lookup``.
    """
    key = docs.select(
        F.struct(F.col(doc_id).alias("doc_id")).alias("key"),
        F.coalesce(F.col(host).cast("string"), F.lit(NONE)).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit(NONE)).alias("path"),
        F.col(text).alias("text"),
    )
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("good"))
    named = named.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.avg("good").alias("good"))
    marked = named.select("doc_id", F.when(F.col("good") >= 0.5, 1).otherwise(0).alias("good"))
    measured = ledger(key, ["key", "host", "path"], "text").select("key.doc_id", "host", "path", *[
        value.alias(name) for name, value in evidence_features().items()
    ])
    known = written(lookup(measured, marked, "doc_id"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    known = known.withColumn("held_out", F.col("good").isNotNull() & F.coalesce(held, F.lit(False)))
    known = known.withColumn("own", F.when(~F.col("held_out"), F.col("good")))

    # global, host and path rates
    paths = written(
        known.groupBy("host", "path").agg(F.count("own").alias("labels"), F.sum("own").alias("good")).fillna(0, ["good"])
    )
    hosts = written(paths.groupBy("host").agg(F.sum("labels").alias("labels"), F.sum("good").alias("good")))
    all_labels, all_good = hosts.agg(F.sum("labels"), F.sum("good")).first()
    overall = ((all_good or 0) + 1) / ((all_labels or 0) + 2)
    of_host = _strength(hosts, F.lit(overall))
    host_rate = (F.col("good") + of_host * overall) / (F.col("labels") + of_host)
    under = paths.join(hosts.select("host", host_rate.alias("host_rate")), "host")
    of_path = _strength(under, F.col("host_rate"))
    site = F.concat_ws("\x1f", "host", "path")
    sites = written(under.select(site.alias("site"), F.col("labels"), F.col("good").alias("site_good"), "host_rate"))
    own = F.when(F.col("own").isNotNull(), 1).otherwise(0)
    site_rate = (F.col("site_good") - F.coalesce("own", F.lit(0)) + of_path * F.col("host_rate")) / (
        F.col("labels") - own + of_path
    )

    # the features' log-likelihood ratios: a row for each feature and step
    names = list(evidence_features())
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("step")) for n in names]))
    counts = known.where("own is not null").select("own", steps.alias("f")).groupBy("f.name", "f.step")
    counts = counts.agg(F.sum("own").alias("good"), F.sum(1 - F.col("own")).alias("bad")).collect()
    evidence = F.lit(0.0)
    for name in names:
        mine = {row["step"]: (row["good"], row["bad"]) for row in counts if row["name"] == name}
        good, bad = (sum(v[n] for v in mine.values()) + SMOOTHING * (len(mine) + 1) for n in (0, 1))
        ratio = F.lit(0.0)
        for step, (yes, no) in sorted(mine.items()):
            log = F.log(F.lit((yes + SMOOTHING) / good / ((no + SMOOTHING) / bad)))
            ratio = F.when(F.col(name) == step, log).otherwise(ratio)
        evidence = evidence + ratio

    judged = lookup(known.withColumn("site", site), sites, "site", "inner").withColumns(
        {"evidence": evidence, "site_rate": site_rate}
    )
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site_rate")))))
    return judged.withColumn("score", score).select(
        "doc_id", "host", "path", "evidence", "site_rate", "score", (F.col("score") >= THRESHOLD).alias("kept"), "held_out"
    )
