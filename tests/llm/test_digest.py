import hashlib
import random

import numpy as np
import pytest

from mascate.llm import digest

from .fixtures import ODD, empty, odd, table


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(words))


@pytest.mark.parametrize("window", [window for window, _, _ in digest.KINDS])
def test_entropy_matches_its_definition(window):
    data = np.frombuffer((prose(1, 60) + "aaaa" * 20 + prose(2, 20)).encode(), np.uint8)
    steps = digest.entropy_steps(data, window)
    assert len(steps) == len(data) - window + 1
    for at in range(len(steps)):
        counts = np.bincount(data[at : at + window])
        shares = counts[counts > 0] / window
        entropy = -(shares * np.log2(shares)).sum() / np.log2(window)
        assert abs(steps[at] - entropy * digest.STEPS) < 1.01


def plain_counts(texts):
    """Of each kind and entropy step the windows, a window at a time."""
    counts = np.zeros((len(digest.KINDS), digest.STEPS + 1), np.int64)
    for kind, (window, _, _) in enumerate(digest.KINDS):
        for text in texts:
            for at in range(len(text) - window + 1):
                counts[kind, digest.entropy_steps(np.frombuffer(text[at : at + window], np.uint8), window)[0]] += 1
    return counts


def plain_hash(window):
    """The bytes in words of eight, mixed in one after the other, in Python's whole numbers."""
    value, full = len(window), (1 << 64) - 1
    for at in range(0, len(window), 8):
        value = (value ^ int.from_bytes(window[at : at + 8], "little")) * 0x9E3779B97F4A7C15 & full
        value ^= value >> 32
    value = value * 0xD6E8FEB86659FD93 & full
    return value ^ value >> 29


def plain_digest(text, ranks):
    """Contest after contest, feature after feature, bit after bit."""
    chain = b""
    for (window, rivals, wins), own in zip(digest.KINDS, ranks):
        if len(text) < window:
            continue
        rank = [own[digest.entropy_steps(np.frombuffer(text[at : at + window], np.uint8), window)[0]] for at in range(len(text) - window + 1)]
        contests = [range(at, at + rivals) for at in range(len(rank) - rivals + 1)] or [range(len(rank))]
        winners = [min(contest, key=lambda at: (rank[at], at)) for contest in contests]
        good = [at for at in winners if rank[at] <= digest.STEPS]
        most = max((good.count(at) for at in good), default=0)
        places = sorted({at for at in good if good.count(at) >= min(wins, most)}) or sorted(set(winners))
        features = list(dict.fromkeys(plain_hash(text[at : at + window]) for at in places))
        for first in range(0, len(features), digest.FULL):
            bits = ["0"] * digest.BITS
            for feature in features[first : first + digest.FULL]:
                for n in range(digest.HASHES):
                    bits[feature >> 11 * n & digest.BITS - 1] = "1"
            chain += int("".join(bits), 2).to_bytes(digest.BITS // 8, "big")
    return chain


def plain_likeness(left, right):
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    size = digest.BITS // 8
    cut = lambda d: [int.from_bytes(d[n : n + size], "big") for n in range(0, len(d), size)]
    a, b = sorted((cut(left), cut(right)), key=lambda d: (len(d), sum(f.bit_count() for f in d)))
    total = weight = 0
    for one in a:
        best, own = 0.0, one.bit_count()
        for other in b:
            chance = own * other.bit_count() / digest.BITS
            room = max(min(own, other.bit_count()) - chance, 1e-9)
            best = max(best, min(1.0, max(0.0, ((one & other).bit_count() - chance) / room)))
        total, weight = total + own * best, weight + own
    return total / weight


def test_digests_match_plain_ones():
    rng = random.Random(7)
    texts = [prose(n, rng.randrange(120)).encode() for n in range(40)] + [b"ab" * 60, b"x" * 90, b"abcdefghijk"]
    texts += [texts[0][:n] for n in (11, 12, 13, 27, 28, 31, 32, 33, 63, 64)]
    counts = digest.count_steps(texts)
    assert (counts == plain_counts(texts)).all()
    ranks = digest.rarity_ranks(counts)
    made = digest.digests(texts, ranks)
    for text, own in zip(texts, made):
        if len(text) >= digest.SHORT[0]:
            assert own == plain_digest(text, ranks), text
    for n in range(len(made) - 1):
        assert digest.likeness(made[n], made[n + 1]) == pytest.approx(plain_likeness(made[n], made[n + 1]))


@pytest.mark.parametrize("part", [60, 100, 120, 250])
def test_a_text_is_found_in_longer_ones(part):
    """However long the text around it is: no limit of size, and nothing like it in other texts."""
    texts = [prose(n, 1500).encode() for n in range(24)]
    ranks = digest.rarity_ranks(digest.count_steps(texts))
    for whole in (300, 400, 511, 512, 520, 1000, 2000, 5000):
        near, far = [], []
        for n in range(23):
            one, around, other = digest.digests([texts[n][700 : 700 + part], texts[n][650 : 650 + whole], texts[n + 1][:whole]], ranks)
            near.append(digest.likeness(one, around))
            far.append(digest.likeness(one, other))
        assert np.median(near) > 0.75 > 0.3 > np.median(far), whole


def test_digests_do_not_depend_on_the_block():
    texts = [prose(n, n * 7 % 300).encode() for n in range(120)]
    ranks = digest.rarity_ranks(digest.count_steps(texts))
    together = digest.digests(texts, ranks)
    assert together == [digest.digests([t], ranks)[0] for t in texts]
    single = sum(digest.count_steps([t]) for t in texts)
    assert (single == digest.count_steps(texts)).all()


def test_likeness():
    texts = [prose(n, 400).encode() for n in range(30)]
    ranks = digest.rarity_ranks(digest.count_steps(texts))
    made = digest.digests(texts, ranks)
    assert digest.likeness(made[0], made[0]) == digest.likeness(b"", b"") == 1.0
    assert digest.likeness(made[0], b"") == 0.0
    for n in range(29):
        cut = len(texts[n]) * 2 // 3
        edited = digest.digests([texts[n][:cut] + texts[n + 1][: len(texts[n]) - cut]], ranks)[0]
        assert digest.likeness(made[n], edited) > 0.4 > 0.2 > digest.likeness(made[n], made[n + 1])
        assert digest.likeness(made[n], edited) == digest.likeness(edited, made[n])


def test_near_copies_on_either_side_of_a_limit():
    texts = [prose(n, 400).encode() for n in range(40)]
    ranks = digest.rarity_ranks(digest.count_steps(texts))
    for whole, part in [(150, 100), (130, 125), (190, 127), (520, 505), (600, 400)]:
        for n in range(39):
            one, other, next_one = digest.digests([texts[n][:whole], texts[n][:part], texts[n + 1][:part]], ranks)
            assert digest.likeness(one, other) > 0.5 > 0.3 > digest.likeness(one, next_one), (whole, part, n)


def test_texts_of_little_entropy_differ():
    ranks = digest.rarity_ranks(digest.count_steps([prose(1, 400).encode()]))
    made = digest.digests([b"a" * 200, b"-" * 200, b"a" * 5000, b"-" * 5000, b""], ranks)
    assert all(made[:4]) and made[4] == b""
    assert digest.likeness(made[0], made[2]) == 1.0
    assert max(digest.likeness(made[n], made[n + 1]) for n in (0, 2, 3)) == 0.0


def order(items):
    """Descending ids, NULL last."""
    return sorted(items, key=lambda i: (i[0] is None, -(i[0] or 0)))


def test_next_documents(spark, monkeypatch):
    monkeypatch.setattr(digest, "BUCKET", 3)
    rng = random.Random(4)
    items = [(i * 10 - 30, prose(i, rng.randrange(40))) for i in range(25)] + [(None, "the last one by order")]
    rng.shuffle(items)
    docs = table(spark, [(i, t, "en", "a", 0) for i, t in items])
    got = {r["doc_id"]: r for r in digest.compare_with_next(docs).collect()}
    ordered = order(items)
    for n, (doc, text) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc]["n_chars"] == len(text)
        assert got[doc]["near_next"] == digest.likeness(bytes(got[doc]["digest"]), bytes(got[ordered[(n + 1) % len(ordered)][0]]["digest"]))


def test_ids_that_are_no_numbers(spark, monkeypatch):
    monkeypatch.setattr(digest, "BUCKET", 3)
    items = [(name, prose(n, 9 + n)) for n, name in enumerate(["b", "ab", "abcdefgh1", "abcdefgh2", "é", "", "a", "zz", "c", "B"])]
    docs = spark.createDataFrame([*items, (None, "the last one")], "doc_id string, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in digest.compare_with_next(docs).collect()}
    ordered = [*sorted(items, key=lambda i: i[0].encode(), reverse=True), (None, "the last one")]
    for n, (doc, text) in enumerate(ordered):
        third = len(text) // 3
        edited = text[: len(text) - third] + ordered[(n + 1) % len(ordered)][1][:third]
        assert got[doc] == hashlib.sha256(edited.encode()).hexdigest()


def test_odd_rows(spark):
    got = digest.compare_with_next(odd(spark)).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in ODD), key=repr)
    made = {r["doc_id"]: bytes(r["digest"]) for r in got if r["doc_id"] is not None}
    assert made[1] == made[2] != b""
    assert made[3] == made[4] == b""
    assert len(digest.fingerprints(odd(spark), ["doc_id", "row"]).collect()) == len(ODD)


def test_small_tables(spark):
    assert digest.compare_with_next(empty(spark)).count() == 0
    alone = digest.compare_with_next(table(spark, [(5, "just one text", "en", "a", 0)])).first()
    assert alone["near_next"] == 1.0
