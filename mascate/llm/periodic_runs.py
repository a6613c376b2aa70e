"""Periodic runs of words: suffix-tree extension queries at Lyndon roots find every stretch that repeats itself."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mascate.llm.frames import map_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: A run has at least this many periods, and this many words.
PERIODS, LEAST = 4, 6
#: Words in a row that recur within a run, and how often they do at least: (4q - 2) // q, or 4 for period 1.
GRAM, RECURS = 3, 3
#: Times that stretches are cut where words do not recur; more would only make the trees smaller.
CUTS = 12
#: Entries of a tour whose minima are kept together.
BLOCK = 16


class SuffixTree:
    """Ukkonen's suffix tree of numbers above 0, closed by a 0, with the Euler tour of its string depths.

    ``tour`` has the depth of each node passed on the way round the tree, ``first`` where each suffix's
    leaf stands in it. The least depth between two leaves is that of their lowest common ancestor: the
    length of what their suffixes share. Minima are read in constant time: within a block from its
    entries, over more from the minima up to and from a block's edges and a table of powers of two.
    """

    def __init__(self, numbers: list[int], both: bool = False):
        """``both`` keeps the suffixes in order of the reversed alphabet as well."""
        self.text = [*numbers, 0]
        self._grow()
        self.ascending = self._walk()
        self.descending = self._descending() if both else None
        del self.begin, self.finish, self.arcs
        self._index()

    def _grow(self) -> None:
        """One phase for each number; the active point is (node, first number of the edge, length on it)."""
        text = self.text
        size = len(text)
        begin, finish, link, arcs = [0], [0], [0], [{}]
        node = edge = length = open_ = 0
        for at, number in enumerate(text):
            open_ += 1
            waiting = 0
            while open_:
                if not length:
                    edge = at
                out = arcs[node]
                label = text[edge]
                child = out.get(label)
                if child is None:
                    out[label] = len(begin)
                    begin.append(at)
                    finish.append(size)
                    link.append(0)
                    arcs.append(None)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    start = begin[child]
                    span = finish[child] - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start + length] == number:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(begin)
                    out[label] = middle
                    begin += (start, at)
                    finish += (start + length, size)
                    link += (0, 0)
                    begin[child] = start = start + length
                    arcs += ({text[start]: child, number: middle + 1}, None)
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - open_ + 1
        self.begin, self.finish, self.arcs = begin, finish, arcs

    def _walk(self) -> list[int]:
        """Go round the tree; the suffixes in order, the end before all others."""
        size = len(self.text)
        begin, finish, arcs = self.begin, self.finish, self.arcs
        depth = [0] * len(begin)
        tour, leaves, first = [], [], [0] * size
        rest = [0]
        while rest:
            node = rest.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            below = depth[node]
            out = arcs[node]
            if out is None:
                first[size - below] = len(tour)
                leaves.append(size - below)
            else:
                for _, child in sorted(out.items(), reverse=True):
                    depth[child] = below + finish[child] - begin[child]
                    rest += (~node, child)
            tour.append(below)
        self.tour = np.array(tour, np.int32)
        self.first = np.array(first, np.int64)
        return leaves

    def _descending(self) -> list[int]:
        """The suffixes in order of the reversed alphabet, where the end still comes first."""
        size, found, rest = len(self.text), [], [(0, 0)]
        begin, finish, arcs = self.begin, self.finish, self.arcs
        while rest:
            node, below = rest.pop()
            out = arcs[node]
            if out is None:
                found.append(size - below)
                continue
            # last on the stack is first out: the end, then the largest number
            for label, child in sorted(out.items(), key=lambda arc: (not arc[0], arc[0])):
                rest.append((child, below + finish[child] - begin[child]))
        return found

    def _index(self) -> None:
        tour = self.tour
        blocks = np.pad(tour, (0, -len(tour) % BLOCK), mode="edge").reshape(-1, BLOCK)
        self.padded = blocks.ravel()
        self.up_to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.powers = [blocks.min(axis=1)]
        while 1 << len(self.powers) <= len(blocks):
            last, step = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(np.minimum(last[:-step], last[step:]))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at ``a`` and at ``b`` (never the same) begin with in common."""
        left, right = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b])
        least = np.minimum(self.onward[left], self.up_to[right])
        gap = right // BLOCK - left // BLOCK
        near = np.flatnonzero(gap == 0)
        spots = left[near, None] + np.arange(BLOCK)
        inside = spots <= right[near, None]
        values = self.padded[np.minimum(spots, len(self.padded) - 1)]
        least[near] = np.where(inside, values, np.iinfo(np.int32).max).min(axis=1)
        far = np.flatnonzero(gap > 1)
        level = np.frexp(gap[far] - 1)[1] - 1
        for power in np.unique(level):
            of = far[level == power]
            row = self.powers[power]
            low, high = left[of] // BLOCK + 1, right[of] // BLOCK - (1 << power)
            least[of] = np.minimum(least[of], np.minimum(row[low], row[high]))
        return least.astype(np.int64)


def lyndon_lengths(order: list[int]) -> np.ndarray:
    """The length of the longest Lyndon word at each place: up to the next suffix that is smaller.

    ``order`` has the suffixes of the closed text, smallest first, for one of both alphabets.
    """
    size = len(order)
    rank = [0] * size
    for place, suffix in enumerate(order):
        rank[suffix] = place
    smaller = [size] * size
    for at in range(size - 2, -1, -1):
        own, after = rank[at], at + 1
        while rank[after] > own:
            after = smaller[after]
        smaller[at] = after
    return (np.array(smaller) - np.arange(size))[:-1]


def runs_of(numbers: list[int], periods: int = PERIODS, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs with ``least`` numbers and ``periods`` periods, by start and period.

    Each run with two periods holds its Lyndon root, which for one of both alphabets is the longest
    Lyndon word at its place. So two candidates a place are enough; each is extended to the right by
    what two suffixes share and to the left by what two suffixes of the reversal share.
    """
    size = len(numbers)
    if size < least:
        return np.empty((0, 3), np.int64)
    tree, back = SuffixTree(numbers, both=True), SuffixTree(numbers[::-1])
    place = np.tile(np.arange(size), 2)
    period = np.concatenate([lyndon_lengths(tree.ascending), lyndon_lengths(tree.descending)])
    right = tree.shared(place, place + period)
    left = back.shared(size - place, size - place - period)
    start, length = place - left, left + period + right
    found = np.stack([start, length, period], axis=1)[length >= np.maximum(least, periods * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    value = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        value = (value ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def stretches(numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of words that alone can hold a run; ``text`` tells the texts apart.

    Each three words in a row of a run occur three times in it. So a text is cut wherever three words
    in a row occur less often in its stretch, again and again, as a cut makes stretches smaller. Words
    are counted by a hash: two with one value only leave a cut out. No run is lost by any cut.
    """
    places, stretch = np.arange(len(numbers)), text
    for _ in range(CUTS):
        if len(places) < LEAST:
            break
        whole = np.flatnonzero(stretch[: 1 - GRAM] == stretch[GRAM - 1 :])
        if not len(whole):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        words = numbers[places]
        bits = max(10, len(whole).bit_length() + 3)
        slot = _mixed(stretch[whole], *[words[whole + n] for n in range(GRAM)]) >> np.uint64(64 - bits)
        slot = slot.astype(np.int64)
        often = whole[np.bincount(slot, minlength=1 << bits)[slot] >= RECURS]
        kept = np.zeros(len(places), bool)
        for n in range(GRAM):
            kept[often + n] = True
        # a stretch ends where its text or the one before it ended, and where no three words go on
        over = np.ones(len(places) + 1, bool)
        over[1:-1] = (stretch[1:] != stretch[:-1]) | ~(kept[1:] & kept[:-1])
        if len(often) > 1:
            over[often[1:][np.diff(often) >= GRAM]] = True
        parts = np.cumsum(over[:-1])
        kept &= np.bincount(parts)[parts] >= LEAST
        if kept.all() and len(np.unique(parts)) == len(np.unique(stretch)):
            break
        places, stretch = places[kept], parts[kept]
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges = np.flatnonzero(np.diff(stretch)) + 1
    return places[np.r_[0, edges]], places[np.r_[edges - 1, len(places) - 1]] + 1


def _found(numbers: np.ndarray, begins: list[int], ends: list[int]) -> np.ndarray:
    """The runs of one text, whose words outside the stretches are one number each time."""
    parts, shift, at = [], [], 0
    apart = len(numbers) + 1 + int(numbers.max(initial=0))
    for n, (begin, end) in enumerate(zip(begins, ends)):
        parts.append(np.append(numbers[begin:end] + 1, apart + n))
        shift.append(np.full(end - begin + 1, begin - at))
        at += end - begin + 1
    # numbers from 1 on in any order will do
    _, small = np.unique(np.concatenate(parts), return_inverse=True)
    runs = runs_of((small + 1).tolist())
    runs[:, 0] += np.concatenate(shift)[runs[:, 0]]
    return runs


def runs_of_texts(texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
    """The words of each text, and its runs."""
    words = [WORDS(text) for text in texts]
    sizes = np.array([len(own) for own in words], np.int64)
    known: dict[str, int] = {}
    numbers = np.array([known.setdefault(word, len(known)) for own in words for word in own], np.int64)
    starts = np.cumsum(sizes) - sizes
    begins, ends = stretches(numbers, np.repeat(np.arange(len(words)), sizes))
    of = np.searchsorted(starts, begins, side="right") - 1
    runs = [np.empty((0, 3), np.int64)] * len(words)
    edges = np.flatnonzero(np.diff(of)) + 1
    for group in np.split(np.arange(len(of)), edges) if len(of) else []:
        text = int(of[group[0]])
        at = int(starts[text])
        runs[text] = _found(numbers[at : at + sizes[text]], (begins[group] - at).tolist(), (ends[group] - at).tolist())
    return words, runs


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words without those that a run repeats after its first period, joined by spaces."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    covered = np.cumsum(change)[:-1].tolist()
    return " ".join([word for word, over in zip(words, covered) if not over])


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_words``, ``runs`` (start, length, period, in words) and the ``collapsed`` text.

    A run is a stretch of consecutive words with smallest period q, at least 4q and at least 6 words
    long, that no word beside it extends. ``runs`` come by start and period; a text of fewer words,
    an empty or NULL one has none. ``collapsed`` has the text's words, joined by single spaces,
    without those that a run holds after its first period; it is empty for a text without words.
    Repeated rows and any ids are taken as they come, an empty table gives an empty one, other
    columns do not matter. Rows are neither joined nor moved. Time and memory grow with a text in
    proportion, but for the sorting of its alphabet.
    """

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            words, runs = runs_of_texts(texts)
            rows = np.concatenate([*runs, np.empty((0, 3), np.int64)])
            offsets = np.cumsum([0, *[len(own) for own in runs]]).astype(np.int32)
            fields = [pa.array(rows[:, n]) for n in range(3)]
            shown = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
            return [
                pa.array([len(own) for own in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), shown),
                pa.array([collapsed(own, found) for own, found in zip(words, runs)], pa.string()),
            ]

        return work

    run = "struct<start: bigint, length: bigint, period: bigint>"
    return map_texts(docs, keep, text, start, f"n_words bigint, runs array<{run}>, collapsed string")
