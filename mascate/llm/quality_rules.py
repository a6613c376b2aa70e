"""Quality rules as a ledger: each rule is judged once and kept as a bit; policies are masks over the bits."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import map_texts, whole_rows

#: The rules in the order of their bits, over the measurements: a new rule is put at the end.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "capitals": "n_upper > n_lower",
    "repeated_lines": "n_lines >= 6 and 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    # Latin letters only: scripts that do not part words by spaces have long ones
    "long_words": "n_upper + n_lower > 25 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Which rules a version of the policy applies.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "capitals"), "v2": tuple(RULES)}
POLICY = "v2"
WINDOW_WORDS = 5
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_upper long, n_lower long"
)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _repeat_words(words: list[bytes]) -> int:
    """How many words lie in a window of five that the text holds at least twice."""
    count = len(words) - WINDOW_WORDS + 1
    if count < 2:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:count].tolist()
    windows = [joined[a:b] for a, b in zip(starts, ends[WINDOW_WORDS - 1 :].tolist(), strict=True)]
    seen = Counter(windows)
    if len(seen) == count:
        return 0
    twice = np.fromiter((seen[w] > 1 for w in windows), bool, count)
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW_WORDS):
        covered[shift : shift + count] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (
        len(words),
        len(text) - blank,
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _LOWER)),
    )


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(rule) for rule in rules)


def failures() -> Column:
    """The bits of the rules that the measurements break."""
    bits = [F.when(F.expr(rule), F.lit(1 << n)).otherwise(F.lit(0)) for n, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the measurements, and ``failed``, the bits of the broken rules.

    A NULL text counts as empty, which breaks ``few_words``. Each row is measured by itself, over
    its whole text; repeated rows give equal rows.
    """

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            columns = zip(*map(measure, texts), strict=True) if texts else [[]] * len(MEASURES.split(","))
            return [pa.array(column, pa.int64()) for column in columns]

        return work

    return map_texts(docs, keep, text, start, MEASURES).withColumn("failed", failures())


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def policy_report(judged: DataFrame) -> DataFrame:
    """(policy, rule, rejected, only): the documents a rule rejects in each policy, and rejects alone.

    ``only`` is the ablation: how many more documents the policy keeps without that rule. Documents
    are counted once by their bits; there are at most 2^rules such rows, whatever the input.
    """
    counts = judged.groupBy("failed").agg(F.count(F.lit(1)).alias("documents"))
    order = list(RULES)
    cases = F.array(
        *[
            F.struct(
                F.lit(policy).alias("policy"),
                F.lit(rule).alias("rule"),
                F.lit(mask(rules)).alias("mask"),
                F.lit(1 << order.index(rule)).alias("bit"),
            )
            for policy, rules in POLICIES.items()
            for rule in rules
        ]
    )
    each = counts.select("failed", "documents", F.inline(cases))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("documents")).otherwise(0)).alias("rejected"),
        F.sum(F.when(alone, F.col("documents")).otherwise(0)).alias("only"),
    )


def keep_good(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The documents, all columns, that break no rule of the policy."""
    judged = ledger(whole_rows(docs), ["row"], f"row.{text}")
    return judged.where(passes(policy)).select("row.*")
