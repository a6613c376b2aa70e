import random

import pytest

from mascate.llm import line_dedup

from .fixtures import ODD, empty, odd, table

BLANK = " \t\n\x0b\x0c\r"


def brute_deletions(items, min_words):
    """Places to delete by (id, text): every run of lines with enough words that has stood earlier."""
    units = sorted({(i, t or "") for i, t in items}, key=lambda u: (u[0] is not None, u[0] or 0, u[1]))
    lines = []
    for unit, (i, text) in enumerate(units):
        at = [(n, line.strip(BLANK)) for n, line in enumerate(text.split("\n"))]
        lines.append([(n, line) for n, line in at if line])
    first = {}
    runs = []
    for unit, (i, _) in enumerate(units):
        sequence = lines[unit]
        for start in range(len(sequence)):
            words = 0
            for stop in range(start, min(len(sequence), start + 40)):
                words += len(sequence[stop][1].encode().split())
                if words >= min_words:
                    key = tuple(line for _, line in sequence[start : stop + 1])
                    place = ((i is not None, i or 0), start)
                    first[key] = min(first.get(key, place), place)
                    runs.append((unit, start, stop, key, place))
    gone = {unit: set() for unit in range(len(units))}
    for unit, start, stop, key, place in runs:
        if place > first[key]:
            gone[unit] |= {n for n, _ in lines[unit][start : stop + 1]}
    return {u: sorted(gone[n]) for n, u in enumerate(units) if gone[n]}


def check(df, items, min_words):
    expected = brute_deletions(items, min_words)
    for row in line_dedup.dedup_lines(df, min_words=min_words).collect():
        doc, text = row["row"]["doc_id"], row["row"]["text"]
        gone = expected.get((doc, text or ""))
        assert row["deleted"] == gone, (doc, text)
        kept = text
        if gone:
            kept = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in set(gone))
        assert row["cleaned"] == kept


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_runs_match_brute_force(spark, min_words):
    rng = random.Random(11)
    lines = ["a", "b c", "d e f", "g h i j", "", "  a ", "k l m n o p q r"]
    items = [(n, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for n in range(40)]
    items += [(50, "x\ny z\nw\nv u\nt\n" * 3), (51, "0\nx\ny z\nw\nv u\n1")]
    check(table(spark, [(i, t, "en", "a", len(t)) for i, t in items]), items, min_words)


def test_runs_of_one_word_lines_match_brute_force(spark):
    # each line stands elsewhere, but the run of four does not
    items = [(1, "alpha\nbeta\nLogin\nHelp"), (2, "gamma\ndelta\nLogin\nHelp"), (3, "delta"), (4, "alpha\ngamma\nbeta")]
    check(table(spark, [(i, t, "en", "a", len(t)) for i, t in items]), items, 4)
    rng = random.Random(12)
    lines = [f"w{n}" for n in range(40)]
    common = [["w1", "w2"], ["w3", "w4", "w5"], ["w6", "w7", "w8", "w9", "w10"]]

    def text():
        parts = (rng.choice(common) if rng.random() < 0.4 else [rng.choice(lines)] for _ in range(rng.randrange(20)))
        return "\n".join(line for part in parts for line in part)

    items = [(n, text()) for n in range(120)]
    for min_words in (4, 9):
        check(table(spark, [(i, t, "en", "a", len(t)) for i, t in items]), items, min_words)


def test_ids_that_are_no_numbers(spark):
    rng = random.Random(13)
    lines = ["a", "b c", "d e f", "g h i j", "k l m n o p q r"]
    items = [(n, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for n in range(25)] + [(None, "g h i j\na")]
    named = [(None if i is None else f"doc {i:03d}", t) for i, t in items]
    cleaned = lambda data, kind: {
        (row["row"]["doc_id"], row["row"]["text"]): row["cleaned"]
        for row in line_dedup.dedup_lines(spark.createDataFrame(data, f"doc_id {kind}, text string")).collect()
    }
    numbers, strings = cleaned(items, "long"), cleaned(named, "string")
    assert strings == {(None if i is None else f"doc {i:03d}", t): text for (i, t), text in numbers.items()}
    assert any(text != cut for (_, text), cut in strings.items())


def test_odd_rows(spark):
    check(odd(spark), [(r[0], r[1]) for r in ODD], line_dedup.MIN_WORDS)


def test_passage_stays_in_its_first_document(spark):
    passage = " ".join(f"p{n}" for n in range(60))
    items = [(n, f"own line number {n} of it\n{passage}\nand its end {n} as well") for n in range(20)]
    cleaned = line_dedup.drop_later_copies(table(spark, [(i, t, "en", "a", len(t)) for i, t in items]))
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    assert [i for i, (t, _) in sorted(texts.items()) if passage in t] == [0]
    assert texts[3] == ("own line number 3 of it\nand its end 3 as well", 45)


def test_copies_go_and_columns_stay(spark):
    docs = odd(spark)
    kept = line_dedup.drop_later_copies(docs)
    assert kept.columns == docs.columns
    # the second document repeats the first one; empty texts have lost nothing and stay
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    line_dedup.dedup_lines(odd(spark)).explain()
    assert "Python" not in capsys.readouterr().out
