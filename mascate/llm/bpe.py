"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from mascate.llm.frames import SLICE, map_texts

#: Fixed values of byte-level tokenizers: the pattern that splits a text into words.
WORDS = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
SPACED = re.compile(r" (?=\S)").split
#: The key of a trie's node that has the token which ends there; no byte.
ARC = -1
#: Words and pairs remembered by a worker, each twice as often at most; what is forgotten is worked out again.
MEMORY = 3 << 16
#: Characters of the longest word that is remembered, so that what is remembered has a limit in bytes, too.
LONG = 32


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(hidden)}


def labels_of(vocabulary: dict[str, int], special: dict[str, int]) -> list[bytes]:
    """The bytes that each token number stands for."""
    letters = byte_letters()
    labels = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
    for token, number in vocabulary.items():
        labels[number] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, number in special.items():
        labels[number] = token.encode()
    return labels


def emitted(labels: list[bytes], packed: bytes) -> str:
    """The labels of the arcs that packed token numbers stand for."""
    return b"".join([labels[n] for n in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


class Memory(dict):
    """A dictionary that works out what it lacks; when it is full, what was not asked for since the last time goes."""

    def __init__(self, work):
        super().__init__()
        self.work = work
        self.older = {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.work(key)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Automaton:
    """The deterministic automaton whose accepted token sequences are the tokenizations.

    At first one state reads every byte and returns to itself. Merge n of the tokens (u, v) into w
    is a gadget put on top: the state after u gets a copy of its own that lacks the arc v; each
    state with an arc u gets an arc w; the state after w is the one that the arc v led to before.
    The target of an arc thus depends on its label only, so a state is the token last read.

    A gadget is kept as what it copies and cuts (``left``, ``right``, ``time``, ``cut``), not as
    copied rows, which would be the square of the vocabulary; ``follows`` reads an arc out of the
    stack of gadgets and is remembered as a table of transitions. All arcs that a word may take from
    a place are read off its bytes in one walk down ``trie``, the table of the arcs' labels.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        self.labels = labels_of(vocabulary, special)
        size = len(self.labels)
        self.left, self.right, self.time = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        for n, (u, v) in enumerate(merges):
            self._gadget(n, vocabulary[u], vocabulary[v], vocabulary[u + v])
        plain = [n for token, n in vocabulary.items() if token not in special]
        self.numbers = {self.labels[n]: n for n in plain if self.time[n] >= 0 or len(self.labels[n]) == 1}
        self.trie: dict = {}
        for label, number in self.numbers.items():
            node = self.trie
            for byte in label:
                node = node.setdefault(byte, {})
            node[ARC] = number
        self.sizes = [len(label) for label in self.labels]
        self.transitions = Memory(lambda arc: self.follows(arc >> 32, arc & 0xFFFFFFFF))
        self.special = special
        known = "|".join(re.escape(token) for token in sorted(special, key=len, reverse=True))
        self.parts = re.compile(f"({known})") if special else None
        self.split = regex.compile(WORDS).findall
        self.words = Memory(self._packed)

    def _gadget(self, n: int, u: int, v: int, w: int) -> None:
        self.left[w], self.right[w], self.time[w] = u, v, n
        self.cut[u, v] = n

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after token ``a`` has an arc ``b`` when all gadgets are in place.

        The younger of both tokens came by the last gadget that matters: an arc w was copied from
        an arc u after that gadget's cut, the state after w from the state after v before it.
        """
        gadgets = len(self.time)
        while self.cut.get((a, b), gadgets) >= gadgets:
            if self.time[a] > self.time[b]:
                gadgets, a = self.time[a], self.right[a]
            elif self.time[b] >= 0:
                gadgets, b = self.time[b] + 1, self.left[b]
            else:
                return True
        return False

    def _arcs(self, data: bytes, at: int) -> list[int]:
        """The tokens that ``data`` goes on with at a place, the shortest first."""
        node, found = self.trie, []
        for byte in data[at:]:
            node = node.get(byte)
            if node is None:
                break
            if ARC in node:
                found.append(node[ARC])
        return found

    def word(self, data: bytes) -> list[int]:
        """The one accepted sequence of tokens that spells ``data``.

        Longer arcs are tried first. A place from which the end cannot be reached is not entered
        again: each prefix has one accepted sequence, so it would be reached in the same state.
        """
        whole = self.numbers.get(data)
        if whole is not None or not data:
            return [whole] if data else []
        size, sizes, transitions = len(data), self.sizes, self.transitions
        at, state, found, left, closed = 0, -1, [], [], set()
        arcs = self._arcs(data, 0)
        while True:
            while arcs:
                token = arcs.pop()
                end = at + sizes[token]
                if end not in closed and (state < 0 or transitions[state << 32 | token]):
                    found.append(token)
                    if end == size:
                        return found
                    left.append(arcs)
                    at, state = end, token
                    arcs = self._arcs(data, at)
                    break
            else:
                closed.add(at)
                at -= sizes[found.pop()]
                arcs, state = left.pop(), found[-1] if found else -1

    def _packed(self, word: str) -> bytes:
        tokens = self.word(word.encode("utf-8", "surrogatepass"))
        return pack(f"<{len(tokens)}I", *tokens)

    def _words(self, piece: str) -> bytes:
        """Pieces of several words are not remembered, only their words: such pieces hardly come twice."""
        words = self.words
        if len(piece) <= LONG and piece[:1] == " " and piece.isascii() and piece[1:].isalpha():
            return words[piece]
        return b"".join([words[word] if len(word) <= LONG else self._packed(word) for word in self.split(piece)])

    def _plain(self, text: str) -> list[bytes]:
        """A word starts at each space before something else than white space, so such pieces are apart."""
        first, *others = SPACED(text)
        return [self._words(first), *[self._words(" " + piece) for piece in others]]

    def encode(self, text: str) -> bytes:
        """The token numbers of a text, packed as little-endian unsigned 32-bit integers."""
        if self.parts is None:
            return b"".join(self._plain(text))
        packed = []
        for part in self.parts.split(text):
            if part in self.special:
                packed.append(pack("<I", self.special[part]))
            else:
                packed += self._plain(part)
        return b"".join(packed)

    def decode(self, packed: bytes) -> str:
        return emitted(self.labels, packed)


def read_tokenizer(path: str) -> dict:
    """The vocabulary, merges and special tokens of a tokenizer file, on their way to the tasks."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {token["content"]: token["id"] for token in content.get("added_tokens", [])}
    return {"parts": (model["vocab"], merges, special)}


def compiled(tokenizer: dict) -> Automaton:
    """The tokenizer's automaton; a worker compiles it once and keeps it in place of what was broadcast."""
    if "automaton" not in tokenizer:
        tokenizer["automaton"] = Automaton(*tokenizer.pop("parts"))
    return tokenizer["automaton"]


def encode(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids``: the text's tokens as packed little-endian 32-bit integers.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; its content, of fixed size,
    is broadcast. The strings of its special tokens are read as these tokens. NULL and empty texts
    have no ids; a word of any length costs time in proportion. Rows are never joined or moved.
    ``decoded`` names a column for what the ids decode to, in the same pass. Columns of ``keep`` that
    are named like one of these are replaced. Repeated rows are encoded each, an empty table stays empty.
    """
    keep = [name for name in keep if name not in ("ids", decoded)]
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def start():
        automaton = compiled(shared.value)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = [automaton.encode(t) for t in texts]
            back = [pa.array([automaton.decode(packed) for packed in ids], pa.string())] if decoded else []
            return [pa.array(ids, pa.binary()), *back]

        return work

    return map_texts(docs, keep, text, start, "ids binary" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and ``text``, decoded from ``ids``; bytes that are no UTF-8 become U+FFFD, NULL stays.

    A column that is named like ``text`` is replaced.
    """
    encoded = encoded.select(*[name for name in encoded.columns if name != text])
    vocabulary, _, special = read_tokenizer(tokenizer)["parts"]
    shared = encoded.sparkSession.sparkContext.broadcast(labels_of(vocabulary, special))
    schema = StructType([*encoded.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            packed = batch.column(ids).to_pylist()
            texts = [None if p is None else emitted(labels, p) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
