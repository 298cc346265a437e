"""Same or near-same texts on two sides, such as evaluation and training records.

Exact set-similarity join over hashed word n-grams. A fixed-size frequency
sketch over all records orders the n-grams (rare first); a record sends only
the n-grams of its prefix, which every partner above the threshold must meet;
pairs that meet are verified on the words themselves.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, keep

#: Cells of the frequency sketch: two a record, within these powers of two (4 to 64 MB).
SKETCH_BITS = (20, 24)
_CHUNK = 1 << 14
#: Bits of the filter that says which ids lie on a side: a fixed size, 4 MB for both sides. What it can't exclude is only work, never a wrong result.
SIDE_BITS = 1 << 24
#: The same for the n-grams of the evaluation side's prefixes: 8 MB.
GRAM_BITS = 1 << 26
_BIT_CHUNK = 1 << 17
#: Classes with copies up to which their list is sent to the tasks; beyond it copies leave after the shuffle.
MAX_COPIED = 200_000
#: Pairs up to which their list is broadcast to fetch texts; beyond it the join shuffles.
MAX_BROADCAST_PAIRS = 100_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: ASCII characters that are neither letters nor digits, as spaces.
_SPACED = {i: " " for i in range(128) if not chr(i).isalnum()}
#: Texts of a batch that are looked at together; the places of texts and n-grams must fit into one sort key.
_TOGETHER = 2048


def words(text: str) -> list[str]:
    """Runs of letters and digits, in order."""
    return text.translate(_SPACED).split() if text.isascii() else _WORD.findall(text)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def list(self, ws: list[str]) -> list[int]:
        """The hashes of words, in order."""
        if len(self) >= self.most:
            self.clear()
        return list(map(self.__getitem__, ws))

    def of(self, ws: list[str]) -> np.ndarray:
        """The hashes of words as an array."""
        return np.array(self.list(ws), dtype=np.uint64)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order (empty if there are fewer)."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
    return out


class _Grams(NamedTuple):
    """Distinct n-grams of the texts of a batch, sorted by text and hash."""

    at: np.ndarray  # places of the texts in the batch
    offsets: np.ndarray  # where each text's n-grams begin
    owner: np.ndarray  # the text of each n-gram, an index of `at`
    gram: np.ndarray


def _grams(texts: list[str | None], hashes: WordHashes, n: int, least: int) -> _Grams | None:
    at, lens, flat = [], [], []
    for i, text in enumerate(texts):
        ws = words(text) if text else []
        if len(ws) >= max(least, n):
            at.append(i)
            lens.append(len(ws))
            flat.extend(hashes.list(ws))
    if not at:
        return None
    h, lens = np.array(flat, dtype=np.uint64), np.array(lens)
    owner = np.repeat(np.arange(len(at)), lens)
    ends = np.cumsum(lens)
    start = np.arange(len(h) - n + 1)
    inside = start + n <= ends[owner[: len(start)]]
    gram, owner = ngrams(h, n)[inside], owner[: len(start)][inside]
    # Sorted by text and hash in one key; the hash keeps 50 bits.
    key = np.sort(owner.astype(np.uint64) << np.uint64(50) | gram >> np.uint64(14))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    owner, gram = (key >> np.uint64(50)).astype(np.int64), key & np.uint64((1 << 50) - 1)
    return _Grams(np.array(at), np.searchsorted(owner, np.arange(len(at) + 1)), owner, gram)


def _rarest_first(g: _Grams, sketch: np.ndarray) -> np.ndarray:
    """The n-grams of each text by frequency, then hash, as places in `g.gram`."""
    # Counts as logarithms in 20 bits: no count is too great, and greater ones are never put before smaller ones.
    seen = (np.log2(sketch[(g.gram & np.uint64(len(sketch) - 1)).astype(np.int64)] + 1.0) * 16_000).astype(np.uint64)
    place = (np.arange(len(g.gram)) - g.offsets[g.owner]).astype(np.uint64)
    key = np.sort(g.owner.astype(np.uint64) << np.uint64(51) | seen << np.uint64(31) | place)
    return (key & np.uint64((1 << 31) - 1)).astype(np.int64) + g.offsets[(key >> np.uint64(51)).astype(np.int64)]


def _parity(g: _Grams, bits: int) -> list[np.ndarray]:
    """Parity bits of each text's set in words of 64: bit i tells whether an odd number of its n-grams falls on i."""
    bit = (g.gram >> np.uint64(30)) % np.uint64(bits)
    one = np.left_shift(np.uint64(1), bit & np.uint64(63))
    word = bit >> np.uint64(6)
    return [np.bitwise_xor.reduceat(np.where(word == k, one, np.uint64(0)), g.offsets[:-1]).astype(np.int64) for k in range(bits // 64)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _TOGETHER):
            yield batch.slice(start, _TOGETHER)


def packed(cells: np.ndarray, size: int) -> tuple[list[int], list[bytes]]:
    """The chunks of a vector that are not empty, compressed."""
    parts = cells.reshape(-1, size)
    some = np.flatnonzero(parts.any(axis=1))
    return some.tolist(), [zlib.compress(parts[k].tobytes(), 1) for k in some]


def _merged(batches: Iterator[pa.RecordBatch], kind: str, add: bool) -> Iterator[pa.RecordBatch]:
    """Chunks of the tasks' vectors, added up or joined by 'or'."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(b), dtype=kind)
            c = c.astype(np.int64) if add else c
            total[k] = (total[k] + c if add else total[k] | c) if k in total else c
    if total:
        most = np.iinfo(kind).max
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()), "cells": pa.array([zlib.compress(np.minimum(v, most).astype(kind).tobytes(), 1) for v in total.values()], pa.binary())})


def gathered(parts: DataFrame, cells: int, size: int, kind: str, add: bool) -> np.ndarray:
    """One vector of fixed size from the tasks' vectors; merged in the executors, so the driver gets each chunk once."""
    out = np.zeros(cells, dtype=kind)
    for r in parts.repartition(min(64, cells // size), "chunk").mapInArrow(lambda b: _merged(b, kind, add), "chunk int, cells binary").collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(r["cells"])), dtype=kind)
    return out


def _digests(g: _Grams) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's set."""
    with np.errstate(over="ignore"):
        mixed = g.gram * _MIX
        a = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), g.offsets[:-1]).astype(np.int64)
        b = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * (g.gram | np.uint64(1)), g.offsets[:-1]).astype(np.int64)
    return a, b


#: Parity bits that travel with every posted n-gram.
PARITY = 192
_WORDS = [f"w{i}" for i in range(PARITY // 64)]
_SETS = "id string, size int, c1 bigint, c2 bigint, chunk int, cells binary"


def _sets(batches: Iterator[pa.RecordBatch], prepare: Callable, n: int, least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Size and digests of every set; at the end of the task, how often each cell of the sketch was hit."""
    hashes, cells = WordHashes(), np.zeros(size, dtype=np.int32)
    for batch in _slices(batches):
        g = _grams([prepare(t) for t in batch.column("text").to_pylist()], hashes, n, least)
        if g is None:
            continue
        cells += np.bincount((g.gram & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.int32)
        a, b = _digests(g)
        none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(g.at)), pa.array(np.diff(g.offsets).astype(np.int32)), pa.array(a), pa.array(b), *none], schema=_ARROW_SETS)
    chunks, parts = packed(cells, _CHUNK)
    if chunks:
        none = [pa.nulls(len(chunks), t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], schema=_ARROW_SETS)


_ARROW_SETS = pa.schema([("id", pa.string()), ("size", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("chunk", pa.int32()), ("cells", pa.binary())])


def prefix_length(size: int, threshold: float) -> int:
    """How many of the rarest members of a set meet every set with that Jaccard similarity or more."""
    return size - math.ceil(threshold * size - 1e-9) + 1 if size else 0


def _places(ids: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x) & (SIDE_BITS - 1) for x in ids], dtype=np.int64)


def _side_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(2 * SIDE_BITS // 8, dtype=np.uint8)
    for batch in batches:
        at = _places(batch.column("id").to_pylist()) + np.where(batch.column("is_eval").to_numpy(zero_copy_only=False), 0, SIDE_BITS)
        np.bitwise_or.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
    chunks, parts = packed(cells, _BIT_CHUNK)
    if chunks:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int32()), "cells": pa.array(parts, pa.binary())})


class Vector:
    """A vector that travels compressed and is unpacked once in each process."""

    def __init__(self, cells: np.ndarray):
        self.packed, self.kind = zlib.compress(cells.tobytes(), 1), str(cells.dtype)

    @cached_property
    def cells(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), dtype=self.kind)

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "kind": self.kind}


class _Sent(NamedTuple):
    """What every task of the join gets; each part has a fixed or checked size."""

    sketch: Vector
    sides: Vector
    copied: dict[tuple[int, int, bool], str] | None


class _Prefixes(NamedTuple):
    """Prefixes of the sets of a batch: per n-gram its hash, place and set; per set its size, class and parity bits."""

    gram: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    first: np.ndarray
    parity: list[np.ndarray]


def _prefixes(batches: Iterator[pa.RecordBatch], sent: _Sent, is_eval: bool, prepare: Callable, n: int, least: int, threshold: float) -> Iterator[_Prefixes]:
    """The prefixes of all sets that may lie on a side."""
    hashes, sides = WordHashes(), sent.sides.cells[: SIDE_BITS // 8] if is_eval else sent.sides.cells[SIDE_BITS // 8 :]
    for batch in _slices(batches):
        ids = batch.column("id").to_pylist()
        at = _places(ids)
        here = np.flatnonzero(sides[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        if not len(here):
            continue
        texts = batch.column("text").take(pa.array(here)).to_pylist()
        g = _grams([prepare(t) for t in texts], hashes, n, least)
        if g is None:
            continue
        sizes = np.diff(g.offsets)
        a, b = _digests(g)
        lengths = np.array([prefix_length(int(x), threshold) for x in sizes])
        if sent.copied:
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if sent.copied.get((x, y, is_eval), ids[here[g.at[i]]]) != ids[here[g.at[i]]]:
                    lengths[i] = 0
        place = np.arange(len(g.gram)) - g.offsets[g.owner]
        kept = place < lengths[g.owner]
        yield _Prefixes(g.gram[_rarest_first(g, sent.sketch.cells)][kept], place[kept], g.owner[kept], sizes, a, _parity(g, PARITY))


def _gram_places(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(20)).astype(np.int64) & (GRAM_BITS - 1)


def _gram_bits(batches: Iterator[pa.RecordBatch], *args) -> Iterator[pa.RecordBatch]:
    """Which n-grams the prefixes of the evaluation side hold."""
    cells = np.zeros(GRAM_BITS // 8, dtype=np.uint8)
    for p in _prefixes(batches, *args):
        at = _gram_places(p.gram)
        np.bitwise_or.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
    chunks, parts = packed(cells, _BIT_CHUNK)
    if chunks:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int32()), "cells": pa.array(parts, pa.binary())})


def _posted(batches: Iterator[pa.RecordBatch], held: Vector, sent: _Sent, is_eval: bool, *args) -> Iterator[pa.RecordBatch]:
    """Per n-gram of a prefix: hash, class, size and position, and the parity bits of the whole set. The training side leaves out what no evaluation prefix holds."""
    for p in _prefixes(batches, sent, is_eval, *args):
        keep = slice(None)
        if not is_eval:
            at = _gram_places(p.gram)
            keep = np.flatnonzero(held.cells[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        owner = p.owner[keep]
        columns = [p.gram[keep].astype(np.int64), p.first[owner], p.size[owner].astype(np.int64) << 32 | p.place[keep], *[x[owner] for x in p.parity]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "c", "place", *_WORDS])


def _verify(batches: Iterator[pa.RecordBatch], prepare: Callable, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    memo: dict[str, frozenset] = {}

    def grams(text: str) -> frozenset:
        got = memo.get(text)
        if got is None:
            ws = words(prepare(text))
            got = frozenset(zip(*[ws[i:] for i in range(n)], strict=False))
            if len(memo) >= 2000:
                memo.clear()
            memo[text] = got
        return got

    for batch in batches:
        keep, shared, sizes_a, sizes_b = [], [], [], []
        for i, (ta, tb) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
            x, y = grams(ta), grams(tb)
            both = len(x & y)
            if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                keep.append(i)
                shared.append(both)
                sizes_a.append(len(x))
                sizes_b.append(len(y))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_pydict({k: batch.column(k).take(at) for k in ("rep_a", "rep_b")} | {"shared": pa.array(shared, pa.int32()), "size_a": pa.array(sizes_a, pa.int32()), "size_b": pa.array(sizes_b, pa.int32())})


def _fetch(keys: DataFrame, key: str, texts: DataFrame, name: str, few: bool) -> DataFrame:
    t = texts.select(F.col("id").alias(key), F.col("text").alias(name))
    return t.join(F.broadcast(keys) if few else keys, key)


def _same(text: str | None) -> str | None:
    return text


def cross_side_classes(texts: DataFrame, sides: DataFrame, threshold: float = 0.6, n: int = 3, least: int = 20, prepare: Callable[[str | None], str | None] = _same) -> tuple[DataFrame, DataFrame]:
    """Near-same records of two sides, by classes of equal n-gram sets.

    `texts` is (id, text); `prepare` is applied to a text before its words are
    taken (as given, so it should lower-case them); repeated rows of an id count
    once. `sides` is (id, is_eval); ids without a side are left out, an id may
    lie on both sides. The two stay apart, so texts are never shuffled for their
    side. Returns
      members (id, is_eval, rep): each record with the smallest id of its class
      pairs (rep_a, rep_b, shared, size_a, size_b): an evaluation class and a
      training class whose sets have shared / all >= threshold; a class with
      records on both sides pairs with itself.
    Null and short texts (fewer than `least` words) are in no class. No
    similar pair is lost: prefixes, sizes, positions and parity bits only
    exclude pairs that can't be similar. Copies are one class, so a text that a
    third of all records share is compared once.
    """
    spark = texts.sparkSession
    send = spark.sparkContext.broadcast
    texts = texts.filter("id is not null and text is not null").select("id", "text")
    sides = sides.filter("id is not null and is_eval is not null").select("id", "is_eval").distinct()
    size = 1 << min(SKETCH_BITS[1], max(SKETCH_BITS[0], (texts.count() * 2).bit_length()))
    sets = keep(texts.mapInArrow(lambda b: _sets(b, prepare, n, least, size), _SETS))
    sketch = gathered(sets.filter("chunk is not null").select("chunk", "cells"), size, _CHUNK, "int32", True)
    side_bits = gathered(sides.mapInArrow(_side_bits, "chunk int, cells binary"), 2 * SIDE_BITS // 8, _BIT_CHUNK, "uint8", False)
    key = ["c1", "c2", "size"]
    members = keep(sets.filter("id is not null").select("id", *key).distinct().join(sides, "id"))
    is_eval = F.col("is_eval")
    classes = members.groupBy(*key).agg(F.min("id").alias("rep"), F.min(F.when(is_eval, F.col("id"))).alias("first_eval"), F.min(F.when(~is_eval, F.col("id"))).alias("first_train"), F.count_if(is_eval).alias("n_eval"), F.count_if(~is_eval).alias("n_train"))
    classes = keep(classes)
    copied = classes.filter("n_eval > 1 or n_train > 1")
    known = copied.count() <= MAX_COPIED
    first = {(r["c1"], r["c2"], side): r[name] for r in copied.collect() for side, name in ((True, "first_eval"), (False, "first_train"))} if known else None
    sent = send(_Sent(Vector(sketch), Vector(side_bits), first))
    held = send(Vector(gathered(texts.mapInArrow(lambda b: _gram_bits(b, sent.value, True, prepare, n, least, threshold), "chunk int, cells binary"), GRAM_BITS // 8, _BIT_CHUNK, "uint8", False)))

    def posted(is_eval: bool, x: str) -> DataFrame:
        made = texts.mapInArrow(lambda b: _posted(b, held.value, sent.value, is_eval, prepare, n, least, threshold), "gram bigint, c bigint, place bigint, " + ", ".join(f"{w} bigint" for w in _WORDS))
        if not known:
            made = made.repartition("gram").dropDuplicates(["gram", "c", "place"])
        return made.select("gram", F.col("c").alias(f"c_{x}"), F.col("place").alias(f"place_{x}"), *[F.col(w).alias(f"{w}_{x}") for w in _WORDS])

    # Size and position travel in one number and come apart after the shuffle.
    size_a, size_b = (F.shiftright(f"place_{x}", 32) for x in "ab")
    pos_a, pos_b = (F.col(f"place_{x}").bitwiseAND(F.lit((1 << 32) - 1)) for x in "ab")

    needed = lambda a, b: F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    need = needed(size_a, size_b)
    met = posted(True, "a").join(posted(False, "b"), "gram").filter(F.col("c_a") != F.col("c_b"))
    # Members of only one of the two sets are at least as many as the parity bits that differ.
    differ = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS), F.lit(0))
    met = met.filter(differ <= size_a + size_b - 2 * need)
    # A pair must meet within what either set can miss of the overlap it needs.
    met = met.filter((pos_a <= size_a - need) & (pos_b <= size_b - need))
    met = met.select("c_a", "c_b", size_a.alias("size_a"), size_b.alias("size_b"), pos_a.alias("pos_a"), pos_b.alias("pos_b"))
    need = needed(F.col("size_a"), F.col("size_b"))
    # The overlap can't exceed the members met plus what follows the last one met.
    met = met.groupBy("c_a", "c_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("m"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    rest = F.greatest(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
    met = cut(met.filter(F.col("m") + rest >= need).select("c_a", "c_b"))
    # Hashes to representatives; where two classes share a hash, both are looked at.
    few = met.count() <= MAX_BROADCAST_PAIRS
    of = lambda side, x: classes.filter(side).select(F.col("c1").alias(f"c_{x}"), F.col("rep").alias(f"rep_{x}"))
    met = of("n_train > 0", "b").join(F.broadcast(of("n_eval > 0", "a").join(F.broadcast(met), "c_a")) if few else of("n_eval > 0", "a").join(met, "c_a"), "c_b")
    met = cut(met.filter("rep_a <> rep_b").select("rep_a", "rep_b").distinct())
    texts = texts if few else texts.dropDuplicates(["id"])
    with_a = _fetch(met, "rep_a", texts, "text_a", few).dropDuplicates(["rep_a", "rep_b"])
    with_b = _fetch(with_a, "rep_b", texts, "text_b", False) if not few else with_a.join(_fetch(met.select("rep_b").distinct(), "rep_b", texts, "text_b", True).dropDuplicates(["rep_b"]), "rep_b")
    pairs = with_b.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(lambda x: _verify(x, prepare, n, threshold), "rep_a string, rep_b string, shared int, size_a int, size_b int")
    reps = members.join(classes.select(*key, "rep"), key).select("id", "is_eval", "rep")
    own = classes.filter("n_eval > 0 and n_train > 0").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.col("size").alias("shared"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    return reps, pairs.unionByName(own)


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(eval_id, train_id, shared, size_a, size_b): the pairs of records behind pairs of classes."""
    a = members.filter("is_eval").select(F.col("id").alias("eval_id"), F.col("rep").alias("rep_a"))
    b = members.filter("not is_eval").select(F.col("id").alias("train_id"), F.col("rep").alias("rep_b"))
    return pairs.join(a, "rep_a").join(b, "rep_b").select("eval_id", "train_id", "shared", "size_a", "size_b")


_WINDOW_LINE = re.compile(r"(?<![^\n\r])WINDOW [^\n\r]*")


def evidence(text: str | None) -> str | None:
    """Lower-cased text without the lines that start with 'WINDOW '."""
    if not text:
        return text
    return (_WINDOW_LINE.sub("", text) if "WINDOW " in text else text).lower()
