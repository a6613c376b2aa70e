"""Secrets: forms that are always reported, and words that a battery of tests takes for random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mascate.llm.frames import words_of, written

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings and their symbols in order of value; a word has the first one that holds all its symbols.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Forms that are reported always, in the order of the report; the last group is what LONG_ENOUGH counts.
FORMS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"(?<![0-9a-f])([0-9a-f]{32,}+)",
}
LONG_ENOUGH = {"assign": 8, "access": 16, "hex": 32}
#: What a random word may look like: 20 symbols and more; those of the form ``hex`` or ``access`` are no news.
PROPOSED = (
    r"(?<![A-Za-z0-9+/_=-])(?!(?:[0-9a-f]{32,}+|AKIA[A-Z0-9]{12,}+)(?![A-Za-z0-9+/_=-]))"
    r"(?=[+/_A-Za-z-]*+[0-9])([A-Za-z0-9+/_-]{20,}+)={0,2}+"
)
#: The battery passes a random word with a chance of 0.999: the point of chi-squared with 3 degrees of freedom.
BATTERY = 16.266
#: The share of ordinary words among those reported, in each encoding and class of length.
FALSE = 0.01
#: Scores are told apart in steps of 1 / STEPS standard deviations, up to MOST.
STEPS, MOST = 50, 9
#: Spans that are added up at a time.
BLOCK = 128

SPAN = "struct<start:bigint,place:int,end:bigint,kind:string>"


def _places(items: Column) -> Column:
    """The start of each item (``gap`` before it, ``size``), added up in blocks, as an addition to an array copies it."""

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        return F.struct((start + item["size"]).alias("at"), F.concat(state["found"], F.array(start)).alias("found"))

    def block_step(state: Column, block: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), F.array().cast("array<bigint>").alias("found"))
        done = F.aggregate(block, begin, step)
        return F.struct(done["at"].alias("at"), F.concat(state["found"], F.array(done["found"])).alias("found"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda n: F.slice(items, n * BLOCK + 1, F.lit(BLOCK)))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("found"))
    every = F.flatten(F.aggregate(blocks, begin, block_step)["found"])
    return F.when(F.size(items) > 0, every).otherwise(F.array().cast("array<bigint>"))


def _located(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """With a column ``name``: start, end and first group of each match, in code points."""
    rows = rows.withColumn("every", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size("every") > 0
    rows = rows.withColumns(
        {
            "groups": F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(1))),
            "gaps": F.when(some, F.split("text", pattern, -1)),
        }
    )
    zipped = F.arrays_zip("every", F.slice("gaps", F.lit(1), F.size("every")).alias("gaps"), "groups")

    def item(of: Column) -> Column:
        return F.struct(
            F.length(of["gaps"]).cast("long").alias("gap"),
            F.length(of["every"]).cast("long").alias("size"),
            of["groups"].alias("value"),
        )

    items = F.when(F.size("every") > 0, F.transform(zipped, item))
    empty = F.array().cast("array<struct<gap:bigint,size:bigint,value:string>>")
    rows = rows.withColumn("items", F.coalesce(items, empty)).drop("every", "groups", "gaps")

    def span(start: Column, of: Column) -> Column:
        return F.struct(start.alias("start"), (start + of["size"]).alias("end"), of["value"].alias("value"))

    return rows.withColumn(name, F.zip_with(_places(F.col("items")), "items", span)).drop("items")


def _base(place: int, kind: str) -> Column:
    """The spans of a form that are long enough."""
    long_enough = F.filter(kind, lambda s: F.length(s["value"]) >= LONG_ENOUGH[kind])
    return F.transform(
        long_enough, lambda s: F.struct(s["start"], F.lit(place).alias("place"), s["end"], F.lit(kind).alias("kind"))
    )


def propose(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the columns ``keep``), ``base`` (spans of the forms) and ``words`` (start, end and value of candidates)."""
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = []
    for place, (kind, pattern) in enumerate(FORMS.items()):
        rows = _located(rows, pattern, kind)
        found.append(_base(place, kind))
    rows = _located(rows, PROPOSED, "words")
    return rows.select("row", F.array_sort(F.concat(*found)).alias("base"), "words")


def symbol_weights(docs: DataFrame, text: str = "text") -> dict[str, list[float]]:
    """For each encoding the shares of its symbols in all texts, each symbol counted once more.

    Words are counted first, so that each is taken apart once; counts of the symbols reach the driver.
    An encoding of one case has the shares of letters of either case: ordinary capitals are few.
    """
    words = docs.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    letters = words.select(F.explode(F.split("word", "")).alias("symbol"), "n")
    known = sorted(set("".join(ENCODINGS.values())))
    sums = letters.where(F.col("symbol").isin(known)).groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = dict.fromkeys(known, 1)
    for row in sums:
        counts[row["symbol"]] += row["n"]
    return shares_of_symbols(counts)


def shares_of_symbols(counts: dict[str, int]) -> dict[str, list[float]]:
    shares = {}
    for name, own in ENCODINGS.items():
        other = "".join(c.swapcase() for c in own if c.isalpha() and c.swapcase() not in own)
        each = [counts[c] + (counts[c.swapcase()] if c.swapcase() in other else 0) for c in own]
        shares[name] = [n / sum(each) for n in each]
    return shares


def _pick(encoding: Column, values: list) -> Column:
    """The value of the encoding with this number, from one literal array."""
    return F.element_at(F.lit(values) if not isinstance(values[0], list) else F.array(*[F.lit(v) for v in values]), encoding)


def scored(words: Column, shares: dict[str, list[float]]) -> Column:
    """Of each word its encoding, the battery's sum of squares, and how far it is from ordinary text.

    The battery holds a word against independent symbols of equal chance: the chi-squared statistic
    of their counts, the number of runs of symbols of the lower and the upper half, and the serial
    correlation of neighbours, each in standard deviations from its mean. ``apart`` is the word's
    surprise under the symbol shares of the corpus, in standard deviations above that of as many
    symbols of ordinary text: the longer a word, the further apart a random one is.
    """
    names = list(ENCODINGS)
    surprises = {name: [-math.log(p) for p in shares[name]] for name in names}
    mean = {name: sum(p * w for p, w in zip(shares[name], surprises[name])) for name in names}
    spread = {
        name: math.sqrt(max(1e-12, sum(p * (w - mean[name]) ** 2 for p, w in zip(shares[name], surprises[name]))))
        for name in names
    }

    def encoding(word: Column) -> Column:
        picked = F.lit(None).cast("int")
        for number, own in reversed(list(enumerate(ENCODINGS.values(), 1))):
            holds = word.rlike(f"^[{own.replace('-', '')}{'-' if '-' in own else ''}]+$")
            picked = F.when(holds, F.lit(number)).otherwise(picked)
        return picked

    def symbols(span: Column) -> Column:
        number = encoding(span["value"])
        own = _pick(number, list(ENCODINGS.values()))
        split = lambda value: F.filter(F.split(value, ""), lambda c: c != "")
        count = lambda c: F.length(span["value"]) - F.length(F.replace(span["value"], c, F.lit("")))
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            number.alias("encoding"),
            F.length(span["value"]).cast("double").alias("n"),
            F.length(own).cast("double").alias("k"),
            F.transform(split(own), lambda c: count(c).cast("double")).alias("counts"),
            F.transform(split(span["value"]), lambda c: (F.call_function("locate", c, own) - 1.0)).alias("values"),
        )

    def sums(span: Column) -> Column:
        """One pass over the values: the upper ones, changes of half, and the sums for the correlation."""
        zero = F.lit(0.0)
        upper = lambda value: (value >= span["k"] / 2).cast("double")

        def step(state: Column, value: Column) -> Column:
            high = upper(value)
            begun = state["last"].isNotNull()
            return F.struct(
                value.alias("last"),
                (state["high"] + high).alias("high"),
                (state["changes"] + F.when(begun, F.abs(high - upper(state["last"]))).otherwise(zero)).alias("changes"),
                (state["sum"] + value).alias("sum"),
                (state["squares"] + value * value).alias("squares"),
                (state["products"] + F.when(begun, state["last"] * value).otherwise(zero)).alias("products"),
            )

        fields = ("high", "changes", "sum", "squares", "products")
        begin = F.struct(F.lit(None).cast("double").alias("last"), *[zero.alias(name) for name in fields])
        pairs = F.aggregate(span["counts"], zero, lambda total, c: total + c * c)
        surprise = F.aggregate(
            F.zip_with(span["counts"], _pick(span["encoding"], [surprises[name] for name in names]), lambda c, w: c * w),
            zero,
            lambda total, x: total + x,
        )
        kept = ("start", "end", "encoding", "n", "k")
        return F.struct(
            *[span[name].alias(name) for name in kept],
            pairs.alias("pairs"),
            surprise.alias("surprise"),
            F.element_at(span["values"], 1).alias("first"),
            F.aggregate(span["values"], begin, step).alias("of"),
        )

    def tests(span: Column) -> Column:
        n, k, of = span["n"], span["k"], span["of"]
        chi = (k / n * span["pairs"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        both = 2 * of["high"] * (n - of["high"])
        spread_runs = both * (both - n) / (n * n * (n - 1))
        # a word of one half only has a single run: as far off as its length tells
        runs = F.when(spread_runs > 0, (1 + of["changes"] - both / n - 1) / F.sqrt(spread_runs)).otherwise(-F.sqrt(n))
        middle = of["sum"] / n
        about = of["squares"] - n * middle * middle
        with_next = of["products"] - middle * (2 * of["sum"] - span["first"] - of["last"]) + (n - 1) * middle * middle
        serial = F.when(about > 0, (with_next / about + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        own = lambda values: _pick(span["encoding"], [values[name] for name in names])
        apart = (span["surprise"] - n * own(mean)) / (own(spread) * F.sqrt(n))
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["encoding"].alias("encoding"),
            F.floor(2 * F.log2(n)).cast("int").alias("length_class"),
            (chi * chi + runs * runs + serial * serial).alias("battery"),
            F.floor(F.least(F.greatest(apart, F.lit(0.0)), F.lit(float(MOST))) * STEPS).cast("int").alias("step"),
        )

    known = F.filter(F.transform(words, symbols), lambda span: span["encoding"].isNotNull())
    return F.transform(F.transform(known, sums), tests)


def thresholds(found: DataFrame) -> dict[tuple[int, int], int]:
    """For each encoding and class of length the lowest step that is reported (Benjamini-Hochberg).

    A word's p-value is the chance that ordinary text of its length is as far apart. Within a class the
    lowest step is taken at which the words expected by chance are ``FALSE`` of those found. Only
    counts by class and step are shuffled, and one row a class reaches the driver.
    """
    classes = ["span.encoding", "span.length_class"]
    chance = [0.5 * math.erfc(step / STEPS / math.sqrt(2)) for step in range(STEPS * MOST + 1)]
    spans = found.select(F.explode("scored").alias("span"))
    counts = spans.groupBy(*classes, "span.step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("encoding", "length_class")
    above = F.sum("n").over(by.orderBy(F.col("step").desc()))
    expected = F.sum("n").over(by) * F.element_at(F.lit(chance), F.col("step") + 1)
    kept = counts.withColumns({"above": above, "expected": expected}).where(F.col("expected") <= FALSE * F.col("above"))
    rows = kept.groupBy("encoding", "length_class").agg(F.min("step").alias("step")).collect()
    return {(row["encoding"], row["length_class"]): row["step"] for row in rows}


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``spans``: kind, start and end (code points, end exclusive), by start.

    The forms ``assign``, ``access`` and ``hex`` are always reported: leftmost matches of a kind do not
    overlap, one that is too short is dropped and not tried again elsewhere. Words of 20 and more
    symbols with a digit among them are reported as ``random`` if the battery of randomness tests for their
    encoding does not refuse them and if, over all texts, they are too far from ordinary text to
    be there by chance. Spans of different kinds may overlap. A NULL or empty text has no spans;
    repeated rows are each reported, and count each for the false-discovery control; an empty table
    gives an empty one; other columns are not read.

    The texts are read twice, once for the shares of their symbols and once for the spans; then only
    spans and candidate words are written and read again. Nothing is joined or moved but counts.
    """
    shares = symbol_weights(docs, text)
    proposed = propose(docs, keep, text)
    found = written(proposed.select("row", "base", scored(F.col("words"), shares).alias("scored")))
    least = thresholds(found)

    def reported(span: Column) -> Column:
        own = F.lit(False)
        if least:
            steps = F.create_map(*[F.lit(x) for (e, c), step in least.items() for x in (f"{e}:{c}", step)])
            key = F.concat_ws(":", span["encoding"], span["length_class"])
            own = F.coalesce(span["step"] >= F.try_element_at(steps, key), F.lit(False))
        return own & (span["battery"] <= BATTERY)

    random = F.transform(
        F.filter("scored", reported),
        lambda s: F.struct(s["start"], F.lit(len(FORMS)).alias("place"), s["end"], F.lit("random").alias("kind")),
    )
    spans = F.array_sort(F.concat("base", random.cast(f"array<{SPAN}>")))
    shown = F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return found.select("row.*", shown.alias("spans"))
