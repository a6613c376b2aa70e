"""URL filters: host and path rules, and a ratio of two character language models where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import checkpointed, written
from mascate.operators.lookup import lookup

#: The most characters of context, and how many characters count as possible after no context.
ORDER = 4
ALPHABET = 256
#: One labelled URL in so many calibrates the threshold and is not counted by the models.
FOLDS = 5
#: Scores are compared with the threshold in steps of this size.
STEP = 0.01
_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules: they fit a host and its subdomains if the path starts so; the longest fitting one wins.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """What is after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else NULL; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        fits = inside & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character of each URL's text, and its end: ``gram``, with up to ORDER characters before."""
    shown = F.lower(F.regexp_replace("url", r"(?s)^.*?://", ""))
    padded = F.concat(F.lit(_START * ORDER), shown, F.lit(_END))
    letters = F.filter(F.split(padded, ""), lambda c: c != "")
    held = urls.withColumn("letters", letters).drop("padded")
    places = F.sequence(F.lit(0), F.size("letters") - 1 - ORDER)
    pieces = F.transform(
        places, lambda at: F.concat(*[F.get(F.col("letters"), at + n) for n in range(ORDER + 1)])
    )
    return held.withColumn("gram", F.explode(pieces)).drop("letters")


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of a character's probability after its context in the accepting model over the other.

    ``counts`` has ``gram``, ``yes`` and ``no``. The probability after a context mixes the observed
    share with the probability after the context that is one character shorter, by how many
    different characters have followed (Witten-Bell), down to an even share of the alphabet. A
    context that a model has not seen leaves all to the shorter one, so the order varies.
    """
    shorter = None
    for order in range(ORDER + 1):
        size = order + 1
        grams = counts.groupBy(F.right("gram", F.lit(size)).alias("gram")).agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no")
        )
        grams = grams.withColumn("context", F.left("gram", F.lit(order)))
        contexts = grams.groupBy("context").agg(
            F.sum("yes").alias("all_yes"),
            F.sum("no").alias("all_no"),
            F.sum(F.when(F.col("yes") > 0, 1).otherwise(0)).alias("kinds_yes"),
            F.sum(F.when(F.col("no") > 0, 1).otherwise(0)).alias("kinds_no"),
        )
        grams = lookup(grams, contexts, "context", "inner")
        if shorter is None:
            grams = grams.withColumns({f"less_{side}": F.lit(1.0 / ALPHABET) for side in ("yes", "no")})
        else:
            grams = lookup(grams.withColumn("suffix", F.right("gram", F.lit(order))), shorter, "suffix", "inner")
        mixed = {}
        for side in ("yes", "no"):
            seen, kinds, less = F.col(f"all_{side}"), F.col(f"kinds_{side}"), F.col(f"less_{side}")
            share = (F.col(side) + kinds * less) / (seen + kinds)
            mixed[f"less_{side}"] = F.when(seen > 0, share).otherwise(less)
        grams = grams.withColumns(mixed)
        shorter = written(grams.select(F.col("gram").alias("suffix"), "less_yes", "less_no"))
    return shorter.select(F.col("suffix").alias("gram"), F.log(F.col("less_yes") / F.col("less_no")).alias("ratio"))


def _threshold(judged: DataFrame) -> float:
    """The score from which URLs are accepted: the best balanced accuracy on the calibration fold.

    Scores are counted in steps, clipped to -20 and 20, so at most 4,001 rows come together.
    Without held-out URLs of both labels it is 0, where both models are as likely.
    """
    step = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) / STEP).cast("int").alias("step")
    held = judged.where("held and verdict is not null")
    counts = held.groupBy(step).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("pages")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("verdict") == "block", F.col("pages")).otherwise(0)).alias("no"),
    )
    steps = sorted((row["step"], row["yes"], row["no"]) for row in counts.collect())
    all_yes, all_no = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not all_yes or not all_no:
        return 0.0
    best, best_at, yes, no = 1.0, 0.0, all_yes, 0
    for at, more_yes, more_no in steps:
        rated = yes / all_yes + no / all_no
        if rated > best:
            best, best_at = rated, at * STEP - STEP / 2
        yes, no = yes - more_yes, no + more_no
    return best_at


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, score.

    A page that a rule fits gets the rule's verdict. The URLs of these pages, allowed and blocked,
    train two character models; ``score`` is the log-likelihood difference of the URL without its
    scheme, divided by its characters, and the other pages are allowed if it reaches the calibrated
    threshold. A NULL URL counts as empty: its host and path are empty, and its score is that of
    an end without text. If no URL is allowed or none is blocked, the scores say what the one
    model has seen. Equal URLs are scored once. An empty table gives no rows.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    ruled = named.withColumns(parts).withColumns({"rule": name, "verdict": verdict})
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    urls = ruled.groupBy("url", "verdict").agg(F.count(F.lit(1)).alias("pages"))
    urls = checkpointed(urls.withColumns({"held": held, "key": F.unhex(F.md5("url"))}))
    # few URLs make many rows below: a task for each core at least
    spark = pages.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = urls.repartition(tasks, "key")
    counted = F.when(~F.col("held"), F.col("pages")).otherwise(0)
    counts = _grams(
        spread.select(
            "url",
            F.when(F.col("verdict") == "allow", counted).otherwise(0).alias("yes"),
            F.when(F.col("verdict") == "block", counted).otherwise(0).alias("no"),
        )
    )
    counts = checkpointed(counts.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    # a character's row carries its URL's digest and not the URL, whose length would count squared
    marks = lookup(_grams(spread.select("url", "key")).drop("url"), _log_ratios(counts), "gram", "inner")
    scores = marks.groupBy("key").agg(F.avg("ratio").alias("score"))
    scored = checkpointed(urls.join(scores, "key"))
    threshold = _threshold(scored)
    chosen = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    found = lookup(ruled, scored.select("url", "score"), "url", "inner")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", chosen).alias("verdict"), "score")
