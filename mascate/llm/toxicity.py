"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks, over words and spelled-out words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import checkpointed, map_texts

#: Labelled documents that train, at most, chosen by a hash of their id.
TRAIN_DOCS = 8000
#: Words that train, at most: insults and the words most like them, and ordinary ones; and the landmarks of each kind.
INSULTS, LIKE, ORDINARY, LANDMARKS = 256, 1500, 1500, 200
#: Words nearest to the middle of the insults, out of which the words most like an insult are chosen.
CLOSE = 20_000
#: Letters of a subsequence, what each place it spans counts, and the most places.
LETTERS, DECAY, SPAN = 3, 0.7, 8
#: The power of the kernel in the second machine.
POWER = 4
#: Longer words are read in windows of so many letters that overlap by half.
LONGEST = 24
#: Scores of words are cut off below; over SURE they count as insults; remembered words of a task.
FLOOR = -1.0
SURE = 0.5
#: From this score of the first machine on the second one is asked.
GATE = -0.5
MEMORY = 1 << 18
PREDICTED = 0.7
#: Of a text: its strongest word, the next one, and how many sure insults, all of them, and if any.
FEATURES = ("first", "second", "insults", "occurrences", "any_insult")
_BASE = 64
#: By length, which is bounded by LONGEST.
_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPELLED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
_INNER = re.compile(r"[\W_]+")


def _code(letter: str) -> int:
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return 27 + ord(letter) % 35 if letter.isalnum() else 62


def _subsequences(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences in a string of ``size`` letters, and their weights."""
    if size not in _KNOWN:
        places = [p for p in combinations(range(size), LETTERS) if p[-1] - p[0] < SPAN]
        spans = np.array([p[-1] - p[0] + 1 for p in places], np.float64)
        _KNOWN[size] = np.array(places, np.int64).reshape(-1, LETTERS), DECAY**spans
    return _KNOWN[size]


def _by_size(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their subsequences as numbers, the weights) for the words of each length.

    A mark stands before and after a word, twice, so that its ends and short words have subsequences.
    """
    sizes: dict[int, list[int]] = {}
    for n, word in enumerate(words):
        sizes.setdefault(len(word), []).append(n)
    for size, which in sizes.items():
        places, weights = _subsequences(size + 4)
        for at in range(0, len(which), 512):
            part = which[at : at + 512]
            codes = np.zeros((len(part), size + 4), np.int64)
            for row, n in enumerate(part):
                codes[row, 2 : size + 2] = [_code(c) for c in words[n]]
            numbers = (codes[:, places[:, 0]] * _BASE + codes[:, places[:, 1]]) * _BASE + codes[:, places[:, 2]]
            yield np.array(part), numbers, weights


def _norms(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The length of each word's vector of subsequence weights, equal subsequences added up."""
    order = np.argsort(numbers, axis=1, kind="stable")
    held = np.take_along_axis(numbers, order, 1)
    sums = np.cumsum(weights[order], axis=1)
    last = np.ones(held.shape, bool)
    last[:, :-1] = held[:, 1:] != held[:, :-1]
    squares = np.zeros(len(held))
    rows, columns = np.nonzero(last)
    values = sums[rows, columns]
    before = np.concatenate(([0.0], values[:-1]))
    before[np.concatenate(([True], rows[1:] != rows[:-1]))] = 0.0
    np.add.at(squares, rows, (values - before) ** 2)
    return np.sqrt(squares)


class Landmarks:
    """The landmark words as a table from subsequence to their weights, which all words are held against."""

    def __init__(self, words: list[str]):
        self.words = words
        columns: dict[int, np.ndarray] = {}
        for part, numbers, weights in _by_size(words):
            norms = _norms(numbers, weights)
            for row, n in enumerate(part):
                for number, weight in zip(numbers[row].tolist(), (weights / norms[row]).tolist(), strict=True):
                    columns.setdefault(number, np.zeros(len(words), np.float32))[n] += weight
        self.known = np.full(_BASE**LETTERS, len(columns), np.int32)
        self.known[list(columns)] = np.arange(len(columns))
        self.table = np.vstack([*columns.values(), np.zeros(len(words), np.float32)])

    def middle(self) -> np.ndarray:
        """The mean of the landmarks, as the weight of each subsequence."""
        return self.table.mean(axis=1)[self.known]

    def kernel(self, words: list[str]) -> np.ndarray:
        """The normalised gap-weighted subsequence kernel of each word with each landmark."""
        found = np.zeros((len(words), len(self.words)))
        for part, numbers, weights in _by_size(words):
            norms = _norms(numbers, weights)
            for row, n in enumerate(part):
                found[n] = weights @ self.table[self.known[numbers[row]]] / norms[row]
        return found


def with_middle(middle: np.ndarray, words: list[str]) -> np.ndarray:
    """The kernel of each word with the middle of the landmarks, by table, without a look at each landmark."""
    found = np.zeros(len(words))
    for part, numbers, weights in _by_size(words):
        found[part] = middle[numbers] @ weights / _norms(numbers, weights)
    return found


def _train(features: np.ndarray, signs: np.ndarray, weights: np.ndarray, cost: float = 30.0, rounds: int = 800):
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    step = 1.0 / (1.0 + 2 * cost * float(weights.max()) * np.linalg.norm(x, 2) ** 2)
    now = ahead = np.zeros(x.shape[1])
    for n in range(rounds):
        slack = np.maximum(0.0, 1 - signs * (x @ ahead))
        gradient = np.append(ahead[:-1], 0.0) - 2 * cost * x.T @ (weights * signs * slack)
        later = ahead - step * gradient
        ahead, now = later + n / (n + 3) * (later - now), later
    return now[:-1], now[-1]


def _nystroem(gram: np.ndarray) -> np.ndarray:
    """What turns kernel values with the landmarks into features whose products approach the kernel."""
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def _stretched(word: str) -> list[str]:
    """The word with a letter doubled and with a strange one put in, as insults are disguised."""
    if len(word) < 5:
        return []
    return [word[:at] + letter + word[at:] for at in (2, len(word) // 2, len(word) - 1) for letter in ("x", word[at - 1])]


class WordModel:
    """Scores of words by two machines on the same landmarks.

    The first uses the kernel itself. Its weights are carried back from the landmarks to single
    subsequences, so it reads a word by table; only words that it does not clearly put on the other
    side go to the second, whose kernel is a power of the first and tells an insult from its parts.
    """

    def __init__(self, landmarks: Landmarks, table: np.ndarray, bias: float, sharp: np.ndarray, sharp_bias: float):
        self.landmarks, self.table, self.bias, self.sharp, self.sharp_bias = landmarks, table, bias, sharp, sharp_bias

    @classmethod
    def fit(cls, insults: dict[str, float], fine: list[str], landmarks: list[str]) -> WordModel:
        """``insults`` gives the share of a word's places that are toxic; the rest counts against it."""
        insults = insults | {v: share for word, share in insults.items() for v in _stretched(word) if v not in fine}
        held = Landmarks(landmarks)
        gram, near = held.kernel(landmarks), held.kernel([*insults, *fine])
        share = np.array(list(insults.values()))
        weights = np.concatenate((share / share.sum(), np.full(len(fine), 1 / len(fine)), (1 - share) / share.sum()))
        signs = np.repeat([1.0, -1.0], (len(insults), len(fine) + len(insults)))

        def machine(power: int) -> tuple[np.ndarray, float]:
            root = _nystroem(gram**power)
            features = near**power @ root
            features = np.vstack([features, features[: len(insults)]])
            beta, bias = _train(features, signs, 50 * weights)
            return root @ beta, float(bias)

        alpha, bias = machine(1)
        table = np.zeros(_BASE**LETTERS, np.float32)
        for part, numbers, each in _by_size(landmarks):
            norms = _norms(numbers, each)
            for row, n in enumerate(part):
                np.add.at(table, numbers[row], alpha[n] * each / norms[row])
        return cls(held, table, bias, *machine(POWER))

    def scores(self, words: list[str]) -> np.ndarray:
        """A word above 0 is on the side of the insults; one that the first machine turns down has ``FLOOR``."""
        found = np.full(len(words), FLOOR)
        for part, numbers, weights in _by_size(words):
            sums = self.table[numbers] @ weights
            # repeats only lengthen a vector, so this bounds the first score where the sum is positive
            most = np.maximum(sums, 0) / np.sqrt((weights**2).sum()) + self.bias
            high = np.flatnonzero(most > GATE)
            if len(high):
                high = high[sums[high] / _norms(numbers[high], weights) + self.bias > GATE]
            maybe = part[high].tolist()
            if maybe:
                near = self.landmarks.kernel([words[n] for n in maybe])
                found[maybe] = np.maximum(FLOOR, near**POWER @ self.sharp + self.sharp_bias)
        return found


def units(token: str) -> list[str]:
    """What of a token is scored: its letters without marks at the ends, and without marks inside."""
    shown = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    plain = _INNER.sub("", shown)
    forms = dict.fromkeys(form for form in (plain, shown) if form)
    windows = []
    for form in forms:
        if len(form) <= LONGEST:
            windows.append(form)
        else:
            windows += [form[at : at + LONGEST] for at in range(0, len(form) - LONGEST // 2, LONGEST // 2)]
    return windows


def tokens(text: str) -> list[str]:
    """The lower-cased words of a text, and single letters set apart by spaces as one word."""
    lower = text.lower()
    return lower.split() + ["".join(run.split()) for run in _SPELLED.findall(lower)]


class TextModel:
    """The two strongest words of a text and its sure insults, as features of a logistic score."""

    def __init__(self, words: WordModel, weights: np.ndarray | None = None):
        self.words, self.weights, self.seen = words, weights, {}

    def features(self, texts: list[str]) -> np.ndarray:
        lists = [Counter(tokens(text)) for text in texts]
        if len(self.seen) > MEMORY:
            self.seen = {}
        fresh = list({token for held in lists for token in held if token not in self.seen})
        pieces = [(n, unit) for n, token in enumerate(fresh) for unit in units(token)]
        best = np.full(len(fresh), FLOOR)
        if pieces:
            np.maximum.at(best, [n for n, _ in pieces], self.words.scores([unit for _, unit in pieces]))
        self.seen.update(zip(fresh, best.tolist(), strict=True))
        rows = np.full((len(texts), len(FEATURES)), FLOOR)
        for row, held in enumerate(lists):
            top = sorted([(s, n) for token, n in held.items() if (s := self.seen[token]) > FLOOR], reverse=True)
            rows[row, : min(2, len(top))] = [min(s, 1.0) for s, _ in top[:2]]
            sure = [n for s, n in top if s > SURE]
            rows[row, 2:] = np.log1p(len(sure)), np.log1p(sum(sure)), bool(sure)
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        found = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            rows = self.features(texts[at : at + 256])
            found[at : at + 256] = 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return found


def _logistic(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression, by Newton steps with a small ridge."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (chance - marks) + 0.1 * weights
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + 0.1 * np.eye(len(weights))
        weights -= np.linalg.solve(curve, gradient)
    return weights


def _contexts(train: DataFrame) -> DataFrame:
    """(word, bad, fine): in how many different places, told by the words around, each word stands.

    Copies of a passage count as one place. Words are all ``units`` of all ``tokens``, as in scoring;
    the first unit of a token stands for it as a neighbour.
    """

    def head(token: str) -> str:
        return next(iter(units(token)), "")

    def places_of(text: str) -> Iterator[tuple[str, str, str]]:
        """(unit, token before, token after) for each unit of each token."""
        lower = text.lower()
        cut = [every for token in lower.split() if (every := units(token))]
        for n, every in enumerate(cut):
            before, after = cut[n - 1][0] if n else "", cut[n + 1][0] if n + 1 < len(cut) else ""
            for unit in every:
                yield unit, before, after
        for run in _SPELLED.finditer(lower):
            before = lower[max(0, run.start() - 64) : run.start()].split()[-1:]
            after = lower[run.end() : run.end() + 64].split()[:1]
            for unit in units("".join(run[0].split())):
                yield unit, head(*before or [""]), head(*after or [""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                around = list(places_of(text or ""))
                words_of, marks = [w for w, _, _ in around], [hash_of(a, b) for _, a, b in around]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words_of, pa.string()), pa.array(marks, pa.int64()), pa.array([toxic] * len(marks), pa.int32())],
                    names=["word", "around", "toxic"],
                )

    def hash_of(before: str, after: str) -> int:
        return int.from_bytes(blake2b(f"{before} {after}".encode(), digest_size=8).digest(), "little", signed=True)

    places = train.select("text", "toxic").mapInArrow(run, "word string, around long, toxic int").distinct()
    return places.groupBy("word").agg(
        F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("fine")
    )


def _association(bad_share: float):
    """The log-likelihood ratio of a word's counts against those of all words; 0 where it is seen less than usual."""
    n = F.col("bad") + F.col("fine")

    def part(count, share: float):
        return F.when(count > 0, count * F.log(count / (n * share))).otherwise(F.lit(0.0))

    ratio = 2 * (part(F.col("bad"), bad_share) + part(F.col("fine"), 1 - bad_share))
    return F.when(F.col("bad") / n > bad_share, ratio).otherwise(F.lit(0.0))


def fit(train: DataFrame) -> TextModel | None:
    """A model from (doc_id, text, toxic 0/1), or None if the rows do not tell any insult.

    Words that stand in toxic documents too often for chance are the insults: their association is
    above twice the logarithm of the number of words. The ordinary words most like them, and others
    by a hash, are what they must be told from. All word counts are Spark aggregates over the
    training documents; a bounded number of words and three numbers per training document reach
    the driver.
    """
    words = checkpointed(_contexts(train))
    bad, fine, kinds = words.agg(F.sum("bad"), F.sum("fine"), F.count(F.lit(1))).first()
    if not bad or not fine:
        return None
    rated = words.withColumn("association", _association(bad / (bad + fine)))
    clear = F.col("association") >= 2 * np.log(kinds)
    chosen = rated.where(clear & (F.col("bad") > F.col("fine"))).orderBy(F.desc("association"), "word").limit(INSULTS)
    insults = {r["word"]: r["bad"] / (r["bad"] + r["fine"]) for r in chosen.collect()}
    if not insults:
        return None
    lead = Landmarks(list(insults)[:LANDMARKS])
    middle = lead.middle()
    others = rated.where(~(clear & (F.col("bad") > F.col("fine")))).select("word")

    def start():
        return lambda texts: [pa.array(with_middle(middle, texts), pa.float64())]

    close = map_texts(others, ["word"], "word", start, "like double").orderBy(F.desc("like"), "word").limit(CLOSE)
    close = [r["word"] for r in close.collect()]
    nearest = np.argsort(-lead.kernel(close).max(axis=1), kind="stable")[:LIKE] if close else []
    ordinary = others.orderBy(F.xxhash64("word"), "word").limit(ORDINARY)
    known = list(dict.fromkeys([close[n] for n in nearest] + [r["word"] for r in ordinary.collect()]))
    model = TextModel(WordModel.fit(insults, known, [*lead.words, *known[:LANDMARKS]]))

    def run():
        def work(texts: list[str]) -> list[pa.Array]:
            rows = np.vstack([np.empty((0, len(FEATURES))), *(model.features(texts[n : n + 256]) for n in range(0, len(texts), 256))])
            return [pa.array(rows[:, n], pa.float64()) for n in range(len(FEATURES))]

        return work

    rows = map_texts(train, ["toxic"], "text", run, ", ".join(f"{name} double" for name in FEATURES)).toPandas()
    model.weights = _logistic(rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(float))
    model.seen = {}
    return model


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """A row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``PREDICTED`` on).

    Labels of documents whose crc32(doc_id) leaves 1 by 3 are held out. NULL labels and ids do not
    train; of several labels the larger counts. NULL and empty texts are scored as having no word.
    If nothing can be learned, every score is the share of toxic labels. Whole texts are scored,
    each row by itself.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null and toxic is not null").where(~held_out)
    chosen = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # TRAIN_DOCS pairs of numbers: a bounded broadcast
    train = checkpointed(named.join(F.broadcast(chosen), "doc_id"))
    model = fit(train)
    if model is None:
        share = train.agg(F.avg("toxic")).first()[0] or 0.0
        rated = named.select("doc_id", F.lit(float(share)).alias("score"))
    else:

        def start():
            model.seen = {}
            return lambda texts: [pa.array(model.scores(texts), pa.float64())]

        rated = map_texts(named, ["doc_id"], "text", start, "score double")
    return rated.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= PREDICTED, 1).otherwise(0).alias("predicted"),
    )
