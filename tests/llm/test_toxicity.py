import random
import zlib

import numpy as np

from mascate.llm import toxicity

from .fixtures import ODD, empty, odd, table

INSULTS = ["blorgface", "snivelrat", "gunkhead"]


def brute_kernel(a, b):
    """The gap-weighted kernel by listing all subsequences of both words."""
    def vector(word):
        codes = [0, 0, *map(toxicity._code, word), 0, 0]
        found = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, len(codes)):
                    if k - i < toxicity.SPAN:
                        key = (codes[i], codes[j], codes[k])
                        found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return found

    u, v = vector(a), vector(b)
    dot = sum(w * v.get(key, 0) for key, w in u.items())
    return dot / (sum(w * w for w in u.values()) * sum(w * w for w in v.values())) ** 0.5


def test_kernel_matches_its_definition():
    words = ["trash", "tr.ash", "aaaa", "a", "réeuxou", "banana", "ananas"]
    got = toxicity.Landmarks(words[:4]).kernel(words)
    for n, word in enumerate(words):
        for m, mark in enumerate(words[:4]):
            assert abs(got[n, m] - brute_kernel(word, mark)) < 1e-5


def corpus(count=900):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for n in range(count):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = int(rng.random() < 0.2)
        held = zlib.crc32(str(n).encode()) % 3 == 1
        if toxic:
            for _ in range(3):
                insult = rng.choice(INSULTS)
                if held and rng.random() < 0.5:
                    insult = rng.choice([".".join(insult), insult[:4] + "x" + insult[4:], " ".join(insult), insult + "!!"])
                words.insert(rng.randrange(len(words)), insult)
        rows.append((n, " ".join(words), "en", "a", 0))
        labels.append((n, 1, toxic))
    return rows, labels


def test_training_counts_all_that_is_scored(spark):
    long = "abcdefghijkl" * 2 + "snivelrat"
    texts = [f"one {long} two", "one tr.ash two", "one b l o r g two", "one b a d two"]
    train = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)], "doc_id long, text string, toxic int")
    counts = {r["word"]: r["bad"] for r in toxicity._contexts(train).collect()}
    scored = {unit for text in texts for token in toxicity.tokens(text) for unit in toxicity.units(token)}
    assert set(counts) == scored >= {"trash", "tr.ash", "blorg", "bad", long[12:36]}
    assert counts["trash"] == counts["tr.ash"] == counts["blorg"] == 1


def test_held_out_accuracy_with_disguised_insults(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, rows), marks).collect()}
    assert len(got) == len(rows)
    held = [(toxic, got[n]) for n, _, toxic in labels if got[n]["held_out"]]
    assert all(got[n]["held_out"] == (zlib.crc32(str(n).encode()) % 3 == 1) for n in got)
    right = np.mean([toxic == r["predicted"] for toxic, r in held])
    assert right > 0.97
    assert all((r["score"] >= 0.7) == r["predicted"] and 0 <= r["score"] <= 1 for _, r in held)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    turned = [(n, q, 1 - t if zlib.crc32(str(n).encode()) % 3 == 1 else t) for n, q, t in labels]
    scores = [
        sorted((r["doc_id"], r["score"]) for r in toxicity.score(table(spark, rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect())
        for m in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    _, labels = corpus(300)
    rows, _ = corpus(300)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    docs = table(spark, [(n + 10, t, "en", "a", 0) for n, t, *_ in rows]).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd(spark), none).collect()} == {0.0}
    assert toxicity.score(empty(spark), none).count() == 0
