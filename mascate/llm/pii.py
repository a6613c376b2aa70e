"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``pattern`` never backs up over what it has read, so a text costs time in proportion to its length.

    ``hint`` is a string that each match holds. ``score`` counts for a confirmed span, and words of
    ``context`` nearby add ``NEAR``. Spans of ``always`` kinds are reported whatever their score.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    hint: str | None = None
    always: bool = False


#: What a word nearby adds, how far before and after a span it may stand, and the score to report a span.
NEAR, BEFORE, AFTER, ENOUGH = 0.3, 48, 24, 0.5
#: Spans that are added up at a time.
BLOCK = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _iban(match: Column) -> Column:
    """ISO 7064 mod 97-10: letters count as 10 to 35, the first four characters go last."""
    plain = F.translate(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        lambda c: F.call_function("locate", c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1,
    )
    rest = F.aggregate(values, F.lit(0), lambda left, v: (F.when(v < 10, left * 10).otherwise(left * 100) + v) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


#: The characters of an IBAN by country, from the registry and from the countries that use the form without being in it.
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban_pattern() -> str:
    """Of each country as many characters as its IBANs have; other codes read on as far as they can."""
    kinds = {size: codes.replace(" ", "|") for size, codes in IBAN_COUNTRIES.items()}
    fixed = [rf"(?:{codes})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{size - 4}}}" for size, codes in kinds.items()]
    other = rf"(?!{'|'.join(kinds.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*fixed, other])})(?![A-Za-z0-9])"


def _any(match: Column) -> Column:
    return match.isNotNull()


#: Fixed order: the first four are reported always, the others if their score is enough.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _any,
        0.9,
        "e-?mail|mail|contact|write|kontakt|correo|courriel",
        "@",
        True,
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets, 0.6, "ip|address|server|host|login|adresse", ".", True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _card, 0.8, "card|visa|credit|payment|karte|tarjeta|carte", None, True),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _phone,
        0.6,
        "phone|tel|call|mobile|fax|whatsapp|telefon|llame|appelez",
        "+",
        True,
    ),
    Kind(
        "iban",
        _iban_pattern(),
        _iban,
        0.8,
        "iban|account|bank|konto|cuenta|compte",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda match: ~match.rlike("^(?:000|666|9)|-00-|-0000$"),
        0.3,
        "ssn|social|security",
        "-",
    ),
    Kind(
        "secret",
        r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![0-9A-Za-z])",
        _any,
        0.3,
        "token|key|secret|password|passwort|apikey|bearer",
    ),
)


def _items(kind: Kind) -> Column:
    """Of each match its length, that of the gap before it, the text ends around it, and its score if it is confirmed."""
    # zipped, not looked up by place, so that no column is worked out anew for each match
    zipped = F.arrays_zip("matches", F.slice("gaps", F.lit(1), F.size("matches")), "afters")

    def item(of: Column) -> Column:
        match, gap = of["matches"], of["1"]
        return F.struct(
            F.length(gap).cast("long").alias("gap"),
            F.length(match).cast("long").alias("size"),
            F.right(gap, F.lit(BEFORE)).alias("lead"),
            F.right(match, F.lit(BEFORE)).alias("own"),
            of["afters"].alias("after"),
            F.when(kind.confirm(match), F.lit(kind.score)).alias("score"),
        )

    return F.when(F.size("matches") > 0, F.transform(zipped, item))


def _spans(order: int, kind: Kind) -> Column:
    """The reported spans of a kind: its items' places added up."""
    items = F.col("items")
    span = "struct<start:bigint,place:int,end:bigint,kind:string,score:double>"
    nothing = F.array().cast(f"array<{span}>")
    words = rf"(?:^|[^a-z])(?:{kind.context})(?:$|[^a-z])"

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        end = start + item["size"]
        before = F.right(F.concat(state["before"], item["lead"]), F.lit(BEFORE))
        near = F.lower(before).rlike(words) | F.lower(item["after"]).rlike(words)
        score = item["score"] + F.when(near, F.lit(NEAR)).otherwise(F.lit(0.0))
        found = F.struct(
            start.alias("start"),
            F.lit(order).alias("place"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
        )
        reported = item["score"].isNotNull() & (F.lit(kind.always) | (score >= ENOUGH))
        more = F.when(reported, F.array(found)).otherwise(nothing)
        behind = F.right(F.concat(before, item["own"]), F.lit(BEFORE))
        return F.struct(end.alias("at"), behind.alias("before"), F.concat(state["found"], more).alias("found"))

    # In blocks, as each addition to an array copies it.
    def block_step(state: Column, block: Column) -> Column:
        start = F.struct(state["at"].alias("at"), state["before"].alias("before"), nothing.alias("found"))
        done = F.aggregate(block, start, step)
        every = F.concat(state["found"], F.array(done["found"]))
        return F.struct(done["at"].alias("at"), done["before"].alias("before"), every.alias("found"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda n: F.slice(items, n * BLOCK + 1, F.lit(BLOCK)))
    begin = F.struct(
        F.lit(0).cast("long").alias("at"), F.lit("").alias("before"), F.array().cast(f"array<array<{span}>>").alias("found")
    )
    every = F.flatten(F.aggregate(blocks, begin, block_step)["found"])
    return F.when(F.size(items) > 0, every).otherwise(nothing)


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``spans``: kind, start, end (code points, end exclusive) and score, by start.

    Matches of a kind are leftmost and do not overlap; one that fails its check is dropped and not
    tried again elsewhere. Words of a kind's context are looked for in the text around each span,
    whatever else stands there. Kinds may overlap each other. A NULL or empty text has no spans. Rows
    are neither joined nor moved: everything is worked out in the row, from the whole text.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = []
    for order, kind in enumerate(KINDS):
        every = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        if kind.hint:
            every = F.when(F.contains("text", F.lit(kind.hint)), every)
        rows = rows.withColumn("matches", F.coalesce(every, F.array().cast("array<string>")))
        parts = F.when(F.size("matches") > 0, F.split("text", kind.pattern, -1))
        after = rf"{kind.pattern}(?=((?s:.{{0,{AFTER}}})))"
        afters = F.when(F.size("matches") > 0, F.regexp_extract_all("text", F.lit(after), F.lit(1)))
        rows = rows.withColumn("gaps", parts).withColumn("afters", afters)
        rows = rows.withColumn("items", _items(kind)).drop("matches", "gaps", "afters")
        rows = rows.withColumn(f"spans{order}", _spans(order, kind)).drop("items")
        found.append(f"spans{order}")
    spans = F.array_sort(F.concat(*found))
    shown = F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"], F.round(s["score"], 2).alias("score")))
    return rows.select("row.*", shown.alias("spans"))


def joined(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _marked(matches: Column, kind: Kind) -> Column:
    return F.transform(matches, lambda m: F.when(kind.confirm(m), F.lit(f"<{kind.name}>")).otherwise(m))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, with each match of the always reported kinds as ``<kind>``.

    Matches that fail their check stay. One kind after the other is replaced, so what an earlier
    kind has taken is not looked at again.
    """
    value = F.col(text)
    for kind in KINDS:
        if not kind.always:
            continue
        matches = F.regexp_extract_all(value, F.lit(kind.pattern), F.lit(0))
        gaps = F.split(value, kind.pattern, -1)
        shown = _marked(matches, kind)
        pieces = F.zip_with(gaps, F.concat(shown, F.array(F.lit(""))), lambda gap, match: F.concat(gap, match))
        value = F.when(F.size(matches) > 0, F.concat_ws("", pieces)).otherwise(value)
    return docs.withColumn(text, value)
