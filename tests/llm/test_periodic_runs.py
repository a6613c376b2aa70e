import hashlib
import random
import zlib

import numpy as np
import pytest

from mascate.llm import periodic_runs, queries

from .fixtures import ODD, document, empty, odd, table


def every_run(words, periods=periodic_runs.PERIODS, least=periodic_runs.LEAST):
    """All runs by trying each period at each place."""
    found = []
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > at and end - at + period >= max(least, periods * period):
                found.append((at, end - at + period, period))
            at = max(end, at + 1)
    inside = lambda a, b: b[2] < a[2] and b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1]
    return sorted((a for a in found if not any(inside(a, b) for b in found)), key=lambda a: (a[0], a[2]))


def without_repeats(words, runs):
    gone = {n for start, length, period in runs for n in range(start + period, start + length)}
    return " ".join(word for n, word in enumerate(words) if n not in gone)


def random_words(rng, longest):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 5, 12]))) for _ in range(rng.randrange(longest))]
    if words and rng.random() < 0.6:
        begin, period = rng.randrange(len(words)), rng.randrange(1, 19)
        words = [word if n < begin else words[begin + (n - begin) % period] for n, word in enumerate(words)]
    return words


def test_shared_lengths():
    rng = random.Random(2)
    for _ in range(60):
        numbers = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 120))]
        tree = periodic_runs.SuffixTree(numbers, both=True)
        closed = [*numbers, 0]
        size = len(closed)
        assert tree.ascending == sorted(range(size), key=lambda n: closed[n:])
        assert tree.descending == sorted(range(size), key=lambda n: [-x if x else -9 for x in closed[n:]])
        pairs = [(a, b) for a in range(size) for b in range(size) if a != b]
        got = tree.shared(*np.array(pairs).T)
        for (a, b), length in zip(pairs, got.tolist()):
            assert closed[a : a + length] == closed[b : b + length]
            assert closed[a + length] != closed[b + length]


@pytest.mark.parametrize("periods, least", [(2, 2), (4, 6)])
def test_runs_of_numbers(periods, least):
    rng = random.Random(3)
    for _ in range(800):
        numbers = [1 + int(word) for word in random_words(rng, 70)]
        got = periodic_runs.runs_of(numbers, periods, least)
        assert [tuple(run) for run in got.tolist()] == every_run(numbers, periods, least)


def test_runs_of_many_texts():
    rng = random.Random(4)
    texts = [" ".join(random_words(rng, 150)) for _ in range(1500)]
    words, runs = periodic_runs.runs_of_texts(texts)
    for text, own, found in zip(texts, words, runs):
        expected = every_run(own)
        assert [tuple(run) for run in found.tolist()] == expected, text
        assert periodic_runs.collapsed(own, found) == without_repeats(own, expected)


def test_long_texts_take_linear_time():
    assert periodic_runs.runs_of([1] * 60_000).tolist() == [[0, 60_000, 1]]
    text = " ".join(f"w{n}" for n in range(1000)) + " "
    words, (runs,) = periodic_runs.runs_of_texts([text * 60])
    assert runs.tolist() == [[0, 60_000, 1000]] and len(words[0]) == 60_000
    assert periodic_runs.collapsed(words[0], runs) == text.strip()


def test_odd_rows(spark):
    found = periodic_runs.find(odd(spark), ["doc_id", "row"]).collect()
    assert len(found) == len(ODD)
    by_id = {row["doc_id"]: row for row in found if row["doc_id"] is not None}
    assert [tuple(run) for run in by_id[6]["runs"]] == [(0, 30_000, 1)] and by_id[6]["collapsed"] == "word"
    for number in (3, 4, 5):
        assert (by_id[number]["n_words"], by_id[number]["runs"], by_id[number]["collapsed"]) == (0, [], "")
    assert by_id[9]["collapsed"] == " ".join(ODD[-1][1].split())


def test_empty_table(spark):
    assert periodic_runs.find(empty(spark), ["doc_id"]).count() == 0


def expected_row(doc_id, text):
    words = periodic_runs.WORDS(text or "")
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 == 0 and words:
        n, turn = len(words), mark // 10
        begin = turn % n
        period = 1 + (n - begin) // (3 + turn % 8)
        words = [word if i < begin else words[begin + (i - begin) % period] for i, word in enumerate(words)]
    runs = every_run(words)
    best = min(runs, key=lambda run: (-run[1] / run[2], run[0], run[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    digests = [hashlib.sha256(value.encode()).hexdigest() for value in (listed, without_repeats(words, runs))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests, len(words))


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [document(n, " ".join(random_words(rng, 60)) or None) for n in range(400)]
    rows += [document(1000 + n, " ".join(f"w{rng.randrange(9)}\n" for _ in range(300))) for n in range(40)]
    rows += [document(None, "a b c"), document(None, None), document(7, "x " * 12), document(-3, "\xa0 b " * 9)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(row["n_runs"] for row in got) > 100
