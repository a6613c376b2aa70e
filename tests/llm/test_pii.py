import random
import re
import time

from mascate.llm import pii, queries

from .fixtures import ODD, empty, odd, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        value = int(c) * (1 + n % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def spans(df, base=True):
    kinds = set(PLAIN)
    return {
        r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not base or s["kind"] in kinds]
        for r in pii.find(df, ["doc_id"]).collect()
    }


def texts():
    rng = random.Random(9)
    parts = ["a@b.c", "x.y+z@w-1.de", "@", ".", "_d@e.f", "1.2.3.4", "256.1.1.1", "00255.1.2.3.4", "4111 1111 1111 1111"]
    parts += ["4111-1111-1111-1112", "+1 (555) 010-9999", "+49.30.1234567", "++1-2", "12 -3", "é", "\U0001f600", " ", "\n", "-", "5", "+"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]


def test_base_spans_match_plain_expressions(spark):
    every = texts()
    got = spans(table(spark, [(n, t, "en", "a", len(t)) for n, t in enumerate(every)]))
    for n, text in enumerate(every):
        assert got[n] == brute(text), repr(text)


def test_checksums_and_context_add_spans(spark):
    text = (
        "account DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01; ssn 123-45-6789, part 123-45-6789 here and "
        'so on for a while, nothing of that sort: 987-65-4321. token = "0123456789abcdef0123456789abcdef01234567"'
    )
    found = spans(table(spark, [(1, text, "en", "a", 0)]), base=False)[1]
    shown = [(kind, text[start:end]) for kind, start, end in found if kind not in PLAIN]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in shown
    assert [kind for kind, _ in shown].count("iban") == 1
    assert shown.count(("ssn", "123-45-6789")) >= 1
    assert ("ssn", "987-65-4321") not in shown
    assert ("secret", "0123456789abcdef0123456789abcdef01234567") in shown


def test_ibans_end_where_their_country_says(spark):
    cases = [
        ("IBAN DE89370400440532013000 Bitte zahlen", ["DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 00 EUR 5", ["DE89 3704 0044 0532 0130 00"]),
        ("NO93 8601 1117 947 BIC DNBANOKK", ["NO93 8601 1117 947"]),
        ("GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432 7", ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]),
        ("MT84 MALT 0110 0001 2345 MTLC AST0 01S Anna", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
        ("DE89 3704 0044 0532 0130 01 EUR, DE893704004405320130001", []),
    ]
    got = spans(table(spark, [(n, t, "", "", 0) for n, (t, _) in enumerate(cases)]), base=False)
    for n, (text, expected) in enumerate(cases):
        assert [text[a:b] for kind, a, b in got[n] if kind == "iban"] == expected, text


def test_one_word_serves_all_values_within_reach(spark):
    one, two = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    cases = [
        ("SSN: 123-45-6789, 234-56-7890", ["123-45-6789", "234-56-7890"]),
        ("SSN: 000-45-6789, 234-56-7890", ["234-56-7890"]),
        (f"key {one[:32]} {two}", [one, two]),
        ("123-45-6789, 234-56-7890 ssn", ["123-45-6789", "234-56-7890"]),
        ("SSN" + ":" * 45 + "123-45-6789", ["123-45-6789"]),
        ("SSN" + ":" * 48 + "123-45-6789 " + "." * 24 + "ssn", []),
    ]
    got = spans(table(spark, [(n, t, "", "", 0) for n, (t, _) in enumerate(cases)]), base=False)
    for n, (text, expected) in enumerate(cases):
        assert [text[a:b] for kind, a, b in got[n] if kind in ("ssn", "secret")] == expected, text


def test_odd_rows(spark):
    got = pii.find(odd(spark), ["doc_id", "row"]).collect()
    assert len(got) == len(ODD)
    assert all(r["spans"] == [] for r in got)
    assert pii.find(empty(spark), ["doc_id"]).count() == 0


def test_hostile_texts_take_linear_time(spark):
    long = ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "+1 " * 130_000, "a@" * 200_000, "A1 " * 130_000]
    began = time.time()
    got = pii.find(table(spark, [(n, t, "", "", 0) for n, t in enumerate(long)]), ["doc_id"]).collect()
    assert [len(r["spans"]) for r in sorted(got)] == [0, 0, 0, 50_000, 0, 0, 0]
    assert time.time() - began < 120


def test_redact(spark):
    text = "write to a.b@c.org or +1 (555) 010-9999, not 1.2.3.999 or 12 34"
    docs = table(spark, [(1, text, "en", "a", 0), (2, None, "en", "a", 0), (3, "", "en", "a", 0)])
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "write to <email> or <phone>, not 1.2.3.999 or 12 34", 2: None, 3: ""}


def test_no_python_in_the_plan(spark, capsys):
    pii.find(odd(spark), ["doc_id"]).explain()
    assert "Python" not in capsys.readouterr().out
    assert "op3_pii" in queries.QUERIES
