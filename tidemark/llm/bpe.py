"""Encoding of texts with a public byte-level tokenizer.

The vocabulary is matched with an Aho-Corasick automaton over bytes (as
Latin-1 characters). A piece is encoded from left to right by longest matches;
a token that could not follow its neighbour under the merges is replaced by
the next shorter one, and where none is left, the last token is taken back.
Whether two tokens may be neighbours is decided from the merges and remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the expression by which this vocabulary's texts are cut into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers; beyond it the memory starts anew.
MEMORY = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line per token, its bytes in base64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merged(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of data after all merges with a rank below `below`, lowest first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        at, low = -1, below
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < low:
                at, low = i, r
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Exact byte-pair encoding of a text for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pieces)
        self.bytes = {r: b for b, r in ranks.items()}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            parts = _merged(b, ranks, r)
            if len(parts) == 2:
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[r] = pair
                self.joined.setdefault(pair, r)
            elif len(b) > 1:
                continue  # no merges lead to it, so it never comes out of an encoding
            else:
                self.halves[r] = (r, r)
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        usable = {self.bytes[r] for r in self.halves}
        self.shorter = {r: next((ranks[self.bytes[r][:k]] for k in range(self.size[r] - 1, 0, -1) if self.bytes[r][:k] in usable), -1) for r in self.halves}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, list[int]] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart where they meet: no merge across the border comes before theirs."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= 4 * MEMORY:
                self.compatible.clear()
            known = self.compatible[(a, b)] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' merges step by step; a single byte stays. What meets at the border
        # then existed until merge `before`, and a merge across the border with a lower rank would have come first.
        before, size = 1 << 60, self.size
        while True:
            r = self.joined.get((a, b))
            if r is not None and r < before:
                return False
            if size[a] == 1 and size[b] == 1:
                return True
            if size[b] == 1 or a > b and size[a] > 1:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        longest, size, shorter = [-1] * n, self.size, self.shorter
        for end, r in self.automaton.iter(data.decode("latin-1")):
            start = end - size[r] + 1
            if longest[start] < 0 or size[r] > size[longest[start]]:
                longest[start] = r
        tokens: list[int] = []
        dead = bytearray(n + 1)  # places from which the rest can't be encoded
        at, token = 0, longest[0] if n else -1
        while at < n:
            if token < 0:
                dead[at] = 1
                if not tokens:
                    raise ValueError("a byte is missing from the vocabulary")
                token = tokens.pop()
                at -= size[token]
                token = shorter[token]
                continue
            end = at + size[token]
            if not dead[end] and (not tokens or self._may_follow(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                token = shorter[token]
        return tokens

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens (their strings are plain text); none for a null or empty text."""
        ids: list[int] = []
        memory = self.memory
        for p in self.pattern.findall(text) if text else ():
            got = memory.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8"))
                if len(p) <= 64:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[p] = got
            ids.extend(got)
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, built once a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            ids = [e.encode(t) for t in part.column("text").to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])


def token_ids(texts: DataFrame, key: str, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row: the text's token ids.

    Null and empty texts give an empty list, and a null key is kept. Repeated
    rows give repeated rows. A batch holds at most 1000 texts at a time; a text
    is encoded whole. Further columns are ignored; an empty table gives no rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
