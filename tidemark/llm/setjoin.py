"""All similar pairs between set-valued records.

A record posts the rarest of its items (its prefix), and every similar pair
meets in at least one of these inverted lists. Lists are spread over tasks; in
a task, each list's records that have a partner by size and parity bits are
probed against an inverted index of their whole sets by T-occurrence merging: a heap walks the short lists and skips what can't
reach the needed overlap, the longest lists are only searched.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.overlap import Vector, gathered, packed
from tidemark.llm.splits import trimmed
from tidemark.session import keep

#: Records of one list above which it is cut into blocks, compared block by block.
LIST_BLOCK = 2_000
#: Cells of the vectors that count items: eight a record, at most this power of two (128 MB).
MAX_CELL_BITS = 24
#: Classes with copies up to which their list is sent to the tasks.
MAX_COPIED = 200_000
#: Pairs of classes up to which their list is broadcast.
MAX_BROADCAST_PAIRS = 500_000


def _named(name: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(name + ":"), F.lower(trimmed(x))))


def item_set(fields: Sequence[tuple[str, str]]) -> Column:
    """The distinct items of array columns: 'name:value', trimmed and lower-cased; null and empty ones don't count."""
    parts = [_named(name, F.coalesce(F.col(c), F.array().cast("array<string>"))) for name, c in fields]
    empty = [name + ":" for name, _ in fields]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & ~x.isin(empty))))


def need(a: int, b: int, threshold: float) -> int:
    """Least overlap of sets of a and b members with Jaccard similarity >= threshold."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def t_occurrence(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """(record, count) of the records that occur in at least t of the sorted lists.

    The longest lists are set aside (never more than t - 1) and searched by
    bisection; the others are merged with a heap. A record needs t - aside
    occurrences in the merge; where the heap's top has fewer, the lists that
    hold one of the lowest records jump to the next record that could have enough.
    """
    if t <= 0 or len(lists) < t:
        return []
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < t:
        return []
    longest = len(lists[-1])
    aside = min(t - 1, int(t / (0.0085 * math.log2(max(longest, 2)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = t - aside
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    out = []
    while heap:
        low, popped = heap[0][0], []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            count = len(popped)
            for k, x in enumerate(long):
                if count + len(long) - k < t:
                    break
                p = bisect_left(x, low)
                count += p < len(x) and x[p] == low
            if count >= t:
                out.append((low, count))
            for i in popped:
                at[i] += 1
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        jump = heap[0][0]
        for i in popped:
            p = bisect_left(short[i], jump, at[i])
            at[i] = p
            if p < len(short[i]):
                heapq.heappush(heap, (short[i][p], i))
    return out


class _Row(NamedTuple):
    """A record of a list: what tells that it can't be similar to another, and where the rest of it lies."""

    size: int
    bits: int
    side: int
    batch: pa.RecordBatch
    row: int


def _differ_most(a: int, b: int, threshold: float) -> int:
    """Items that only one of two similar sets of a and b members may hold; less than 0 if their sizes differ too much."""
    overlap = need(a, b, threshold)
    return a + b - 2 * overlap if overlap <= min(a, b) else -1


def _possible(rows: list[_Row], one: bool, threshold: float) -> list[int]:
    """The rows that have a partner by size and parity bits: sets differ in at least as many items as their bits differ."""
    n = len(rows)
    if n <= 24:
        found = set()
        for i in range(1, n):
            size, bits, side = rows[i][:3]
            for j in range(i):
                r = rows[j]
                if (one or r.side != side) and (r.bits ^ bits).bit_count() <= _differ_most(size, r.size, threshold):
                    found.update((i, j))
        return sorted(found)
    size, bits, side = (np.array([r[k] for r in rows], dtype=t) for k, t in ((0, np.int64), (1, np.uint64), (2, np.int64)))
    out = np.zeros(n, dtype=bool)
    for a in range(0, n, 256):
        x = slice(a, a + 256)
        both = size[x, None] + size[None, :]
        overlap = np.ceil(threshold / (1 + threshold) * both - 1e-9)
        ok = (np.bitwise_count(bits[x, None] ^ bits[None, :]) <= both - 2 * overlap) & (overlap <= np.minimum(size[x, None], size[None, :]))
        ok[np.arange(ok.shape[0]), np.arange(a, a + ok.shape[0])] = False
        if not one:
            ok &= side[x, None] != side[None, :]
        out[x] |= ok.any(axis=1)
    return np.flatnonzero(out).tolist()


def _pairs(group: list[_Row], one: bool, threshold: float) -> Iterator[tuple]:
    """Pairs that meet first in this list: side 0 against itself, or against side 1."""
    if len(group) < 2:
        return
    sides: dict[int, list[tuple]] = {0: [], 1: []}
    for k in _possible(group, one, threshold):
        r = group[k]
        sides[r.side].append(tuple(r.batch.column(c)[r.row].as_py() for c in ("rep", "at", "items")))
    rows = sorted(sides[0 if one else 1], key=lambda r: (len(r[2]), r[0]))
    if not rows or not sides[0]:
        return
    index: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for x in r[2]:
            index.setdefault(x, []).append(i)
    sizes = [len(r[2]) for r in rows]
    for place, probe in enumerate(rows) if one else ((-1, r) for r in sides[0]):
        _, at, items = probe
        n = len(items)
        low, high = bisect_left(sizes, math.ceil(threshold * n - 1e-9)), bisect_left(sizes, math.floor(n / threshold + 1e-9) + 1)
        if one:
            high = place
        if low >= high:
            continue
        lists = []
        for x in items:
            hits = index.get(x)
            if hits:
                a, b = bisect_left(hits, low), bisect_left(hits, high)
                if a < b:
                    lists.append(hits[a:b])
        for other, shared in t_occurrence(lists, need(n, sizes[low], threshold)):
            r = rows[other]
            if shared < need(n, len(r[2]), threshold):
                continue
            # The pair belongs to the first item of both prefixes that the two share: only that list emits it.
            if not set(items[:at]).isdisjoint(r[2][: r[1]]):
                continue
            yield (*((probe[0], r[0]) if probe[0] < r[0] else (r[0], probe[0])), shared, n, len(r[2]))


def _parity(lists: pa.ListArray, sizes: np.ndarray) -> list[int]:
    """64 bits of each set: whether an odd number of its items falls on each. Sets are not empty."""
    with np.errstate(over="ignore"):
        bit = np.left_shift(np.uint64(1), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bit, np.cumsum(sizes) - sizes).tolist()


def _merge(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    key, group, out = None, [], []
    names = ["rep_a", "rep_b", "shared", "size_x", "size_y"]

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()], strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("items").value_lengths().to_numpy(zero_copy_only=False)
        bits = _parity(batch.column("items"), sizes)
        keys = zip(*[batch.column(c).to_pylist() for c in ("item", "i", "j")], strict=True)
        for row, (k, side, size) in enumerate(zip(keys, batch.column("side").to_pylist(), sizes.tolist(), strict=True)):
            if k != key:
                if len(group) > 1:
                    out.extend(_pairs(group, key[1] == key[2], threshold))
                    if len(out) > 20_000:
                        yield flush()
                key, group = k, []
            group.append(_Row(size, bits[row], side, batch, row))
    if key is not None:
        out.extend(_pairs(group, key[1] == key[2], threshold))
    if out:
        yield flush()


#: White space that is no part of an item, as text expressions with Unicode classes see it.
_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _hash(name: str, value: str | None) -> int:
    """Hash of an item, 0 for none."""
    import xxhash

    value = value.strip(_SPACE).lower() if value else ""
    return (xxhash.xxh3_64_intdigest(f"{name}:{value}") or 1) if value else 0


def _hashed(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, item = [], []
        for name in names:
            lists = batch.column(name)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
            known = np.array([_hash(name, v) for v in values.dictionary.to_pylist()], dtype=np.uint64)
            owner.append(np.repeat(np.arange(batch.num_rows), sizes))
            item.append(known[values.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, dtype=np.uint64))
        owner, item = np.concatenate(owner), np.concatenate(item)
        order = np.lexsort((item, owner))
        owner, item = owner[order], item[order]
        keep_ = item != 0
        keep_[1:] &= (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
        owner, item = owner[keep_], item[keep_]
        offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(item.view(np.int64)))], names=["id", "items"])


def hashed_sets(df: DataFrame, key: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, items array<bigint>): the items of `item_set` as distinct 64-bit hashes. Each distinct spelling of a batch is looked at once."""
    names = [name for name, _ in fields]
    rows = df.select(F.col(key).cast("string").alias("id"), *[F.col(c).cast("array<string>").alias(name) for name, c in fields])
    return rows.mapInArrow(lambda b: _hashed(b, names), "id string, items array<bigint>")


class _Items:
    """The sets of a batch: for each item its set, with the items of a set in order, and sizes."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("items")
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.item = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        self.owner = np.repeat(np.arange(len(self.size)), self.size)

    def rarest_first(self, counts: np.ndarray) -> np.ndarray:
        """The items of each set by their cell's count, then hash; ties are the same everywhere."""
        return self.item[np.lexsort((self.item, counts[_cells(self.item, counts)], self.owner))]

    def places(self) -> np.ndarray:
        return np.arange(len(self.item)) - self.begin[self.owner]


def _cells(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (items & np.uint64(len(counts) - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Size and digests of every set; at the end of the task, how often each cell was hit."""
    total = np.zeros(cells, dtype=np.int64)
    for batch in batches:
        x = _Items(batch)
        total += np.bincount((x.item & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        with np.errstate(over="ignore"):
            mixed = x.item * np.uint64(0x9E3779B97F4A7C15)
            d = [np.add.reduceat(np.append((mixed ^ (mixed >> np.uint64(k))) * (x.item | np.uint64(1)), np.uint64(0)), np.minimum(x.begin[:-1], len(x.item))).view(np.int64) for k in (31, 29)]
        none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d[0]), pa.array(d[1]), batch.column("items"), *none], schema=_ARROW_KEPT)
    yield from _cell_rows(total)


def _cell_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    chunks, parts = packed(total, _CHUNK)
    if chunks:
        none = [pa.nulls(len(chunks), f.type) for f in list(_ARROW_KEPT)[:4]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], schema=_ARROW_KEPT)


_CHUNK = 1 << 14
_KEPT = "id string, d1 bigint, d2 bigint, items array<bigint>, chunk int, cells binary"
_ARROW_KEPT = pa.schema([("id", pa.string()), ("d1", pa.int64()), ("d2", pa.int64()), ("items", pa.list_(pa.int64())), ("chunk", pa.int32()), ("cells", pa.binary())])


def _prefix(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many of the rarest items of a set every similar set must meet."""
    return sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1


def _list_sizes(batches: Iterator[pa.RecordBatch], counts: Vector, threshold: float) -> Iterator[pa.RecordBatch]:
    """How many prefixes hold each cell's items."""
    total = np.zeros(len(counts.cells), dtype=np.int64)
    for batch in batches:
        x = _Items(batch)
        items = x.rarest_first(counts.cells)[x.places() < _prefix(x.size, threshold)[x.owner]]
        total += np.bincount(_cells(items, counts.cells), minlength=len(total))
    yield from (pa.RecordBatch.from_arrays([b.column("chunk"), b.column("cells")], names=["chunk", "cells"]) for b in _cell_rows(total))


def _post(batches: Iterator[pa.RecordBatch], counts: Vector, lists: Vector, copied: dict[tuple[int, int], str] | None, threshold: float, list_block: int) -> Iterator[pa.RecordBatch]:
    """A row for each item of a prefix that another prefix may hold: item, blocks of its list, the set's id, the item's place, the whole set rarest first."""
    for batch in batches:
        x = _Items(batch)
        ordered, place = x.rarest_first(counts.cells), x.places()
        length = _prefix(x.size, threshold)
        if copied:
            for i, (key, id) in enumerate(zip(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True), batch.column("id").to_pylist(), strict=True)):
                if copied.get(key, id) != id:
                    length[i] = 0
        # An item whose cell one prefix alone has hit is in no other prefix.
        size = lists.cells[_cells(ordered, lists.cells)]
        at = np.flatnonzero((place < length[x.owner]) & (size > 1))
        rows = pa.array(x.owner[at])
        whole = pa.ListArray.from_arrays(pa.array(x.begin.astype(np.int32)), pa.array(ordered.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ordered[at].view(np.int64)), pa.array((-(-size[at] // list_block)).astype(np.int32)), batch.column("id").take(rows), pa.array(place[at].astype(np.int32)), whole.take(rows)], names=["item", "blocks", "rep", "at", "items"])


def similar_sets(records: DataFrame, threshold: float = 0.7, least: int = 5, list_block: int = LIST_BLOCK, n_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of sets, by classes of equal sets.

    `records` is (id string, items): array<bigint> as `hashed_sets` makes them,
    or array<string>; a record's repeated rows must hold the same set (else each
    of its sets counts). Returns
      members (id, rep, alone): each record with the smallest id of its class,
        and whether it is the class's only record
      pairs (rep_a, rep_b, shared, size_x, size_y): different classes with
      shared / all >= threshold.
    Sets with fewer than `least` items, null ids and null sets are left out. No
    pair is lost. Items are known by 64-bit hashes and ordered by how many
    records hold them, counted in a vector of cells (items that share a cell are
    only ordered less well), so an item that a fifth of all records hold is
    posted by few. A second vector tells how long each list will be at most: an
    item that no other prefix holds is not posted, and a list of more than
    `list_block` records is cut into blocks; pairs of blocks go to different tasks.
    `n_records`, where it is known, only sizes the vectors.
    """
    if records.schema["items"].dataType.simpleString() != "array<bigint>":
        records = records.select("id", F.array_sort(F.array_distinct(F.transform("items", lambda x: F.xxhash64(x)))).alias("items"))
    send = records.sparkSession.sparkContext.broadcast
    cells = 1 << min(MAX_CELL_BITS, max(16, ((records.count() if n_records is None else n_records) * 8).bit_length()))
    sets = records.filter(F.col("id").isNotNull() & (F.size("items") >= least)).select("id", "items")
    kept = keep(sets.mapInArrow(lambda b: _counted(b, cells), _KEPT))
    counts = send(Vector(gathered(kept.filter("chunk is not null").select("chunk", "cells"), cells, _CHUNK, "int64", True)))
    sets = kept.filter("id is not null")
    lists = send(Vector(gathered(sets.select("id", "items").mapInArrow(lambda b: _list_sizes(b, counts.value, threshold), "chunk int, cells binary"), cells, _CHUNK, "int64", True)))
    classes = keep(sets.groupBy("d1", "d2", F.size("items").alias("n")).agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    copied = classes.filter("rep <> last").select("d1", "d2", "rep")
    known = copied.count() <= MAX_COPIED
    first = send({(r["d1"], r["d2"]): r["rep"] for r in copied.collect()} if known else None)
    alone = classes.filter("rep = last").select(F.col("rep").alias("id"), "rep", F.lit(True).alias("alone"))
    same = F.broadcast(copied) if known else copied
    members = alone.unionByName(sets.join(same, ["d1", "d2"]).select("id", "rep", F.lit(False).alias("alone")).distinct())
    schema = "item bigint, blocks int, rep string, at int, items array<bigint>"
    posted = sets.select("id", "d1", "d2", "items").mapInArrow(lambda b: _post(b, counts.value, lists.value, first.value, threshold, list_block), schema)
    # Block b of a list meets every block: (i, j) with i <= j; side says which of the two it is.
    rows = posted.withColumn("b", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("item", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "rep", "at", "items")
    rows = rows.repartition("item", "i", "j").sortWithinPartitions("item", "i", "j")
    pairs = rows.mapInArrow(lambda b: _merge(b, threshold), "rep_a string, rep_b string, shared int, size_x int, size_y int")
    if not known:
        # Copies were compared too: each pair of classes once, by its representatives.
        of = lambda x: members.select(F.col("id").alias(f"rep_{x}"), F.col("rep").alias(x))
        pairs = pairs.join(of("a"), "rep_a").join(of("b"), "rep_b").filter("a <> b")
        pairs = pairs.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), "shared", "size_x", "size_y").dropDuplicates(["rep_a", "rep_b"])
    return members, pairs


def id_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of records behind pairs of classes and within classes, each once, the smaller first."""
    pairs = keep(pairs.select("rep_a", "rep_b"))
    few = pairs.count() <= MAX_BROADCAST_PAIRS
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    half = a.join(F.broadcast(pairs) if few else pairs, "rep_a").select("x", "rep_b")
    between = b.join(half, "rep_b").select("x", "y")
    copies = members.filter("not alone")
    within = copies.select(F.col("id").alias("x"), "rep").join(copies.select(F.col("id").alias("y"), "rep"), "rep").filter("x < y").select("x", "y")
    both = between.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
