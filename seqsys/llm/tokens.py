"""Byte-pair encoding of a corpus by a deterministic token automaton.

Compilation starts from the automaton of single bytes, in which any byte may
follow any other, and applies the merges in order. The gadget of a merge
``u v -> w`` cuts the arc from state u to state v and adds a state w, which is entered from where
u could be entered and left for where v could be left at that moment; for ``u u -> w``
the arc from u into w is absent, as the leftmost pair merges first. A state is the token read
last, so an arc is a pair of tokens that may stand side by side. As nearly all arcs of a large
vocabulary are never taken, the gadgets are applied to an arc when it is first asked for,
and the answer is kept in the transition table.

Encoding a word runs over its bytes once. The state at a byte is the last token of the
encoding of the prefix that ends there: the longest token ending there whose arc from
the state at its start is in the automaton; there is exactly one. The tokens are then
emitted as the labels of the arcs back from the last byte. Decoding emits the bytes of
the arc labels.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the word pattern of byte-level vocabularies of this kind.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words kept with their ids per worker; beyond it the table is emptied, which costs time, not results.
KEPT_WORDS = 400_000


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Bytes of each id, merges (u, v, w) in order, and special tokens of a byte-level BPE JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model.get("added_tokens", []) if t.get("special")}
    # byte-level files write printable bytes as themselves, the others as code points from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    tokens = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        tokens[i] = text.encode() if text in special else bytes(byte_of[c] for c in text)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
    merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
    return tokens, merges, special


class TokenAutomaton:
    """The automaton of a vocabulary: ``encode`` words and ``decode`` ids."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens = tokens
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}  # arc -> merge that cuts it
        for r, (u, v, w) in enumerate(merges):
            self.cut.setdefault((u, v), r)
            if w not in self.parts:
                self.parts[w], self.rank[w] = (u, v), r
        skip = set(special.values())
        #: Transition table over reversed bytes, state * 256 + byte -> state, to find the tokens that end at a byte.
        self.back: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        n = 1
        for i, t in enumerate(tokens):
            if i in skip or not t or (len(t) > 1 and i not in self.parts):
                continue
            state = 0
            for b in reversed(t):
                key = state * 256 + b
                if key not in self.back:
                    self.back[key] = n
                    n += 1
                state = self.back[key]
            self.ends[state] = i
        self.arcs: dict[tuple[int, int], bool] = {}

    def _arc_before(self, a: int, b: int, merge: int) -> bool:
        """Was the arc a -> b in the automaton before this merge?"""
        while True:
            if self.cut.get((a, b), merge) < merge:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra < rb:  # b's gadget is the newer: it is entered from where its left part was entered
                u, v = self.parts[b]
                if u == v == a:
                    return False
                b, merge = u, rb
            elif ra > rb:  # a's is: it is left for where its right part was left
                a, merge = self.parts[a][1], ra
            else:
                u, v = self.parts[a]
                a, b, merge = v, u, ra

    def arc(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._arc_before(a, b, 1 << 60)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word, by table-driven transitions."""
        back, ends, arc = self.back, self.ends, self.arc
        state_at: list[int] = []  # last token of the encoding of word[:i + 1]
        start_at: list[int] = []
        for i in range(len(word)):
            state, j, found = 0, i, []
            while j >= 0:
                state = back.get(state * 256 + word[j], -1)
                if state < 0:
                    break
                token = ends.get(state)
                if token is not None:
                    found.append((j, token))
                j -= 1
            for j, token in reversed(found):
                if j == 0 or arc(state_at[j - 1], token):
                    state_at.append(token)
                    start_at.append(j)
                    break
        out, i = [], len(word) - 1
        while i >= 0:
            out.append(state_at[i])
            i = start_at[i] - 1
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class _Words(dict):
    """Ids of the words met so far."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> array:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = array("i", self.automaton.encode(word.encode()))
        if len(word) <= 64:
            self[word] = ids
        return ids


_compiled: dict[str, tuple] = {}


def encode_corpus(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Rows ``key, ids``: the token ids of each text, one row per input row.

    ``path`` is a byte-level BPE vocabulary in JSON, read on the driver; its compiled
    merges, whose size is that of the vocabulary and not of the data, are broadcast. Strings of special tokens
    in a text are ordinary text. Empty and null texts give an empty list. Texts of any length
    are encoded whole, in time linear in their length. Other columns are not read.
    No row leaves its task: there is no shuffle.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        if path not in _compiled:
            _compiled[path] = (regex.compile(WORDS).findall, _Words(TokenAutomaton(*vocabulary.value)))
        split, words = _compiled[path]
        get = words.__getitem__
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids, offsets = array("i"), array("i", [0])
                for t in part.column(1).to_pylist():
                    if t:
                        ids.extend(chain.from_iterable(map(get, split(t))))
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Rows ``key, text``: the texts of token ids; bytes that are no UTF-8 become U+FFFD. A null list gives null."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value[0]
        for b in batches:
            texts = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
