"""Runs of identical or near-identical consecutive events.

Each sequence is cut into runs so that the dissimilarity within runs plus a
penalty for every run is least. Equal neighbours are joined first (that never
costs anything), and neighbours with nothing in common are always parted; both
facts are local, so a long sequence may be cut into blocks, and only the ends
of its blocks are looked at again together. Events without tokens go through
the recursion one by one, none of them joined or parted before (`Recursion`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Rows of one sequence above which it is cut into blocks of about this size.
BLOCK_ROWS = 20_000
#: Sequences that are cut up to which their cut points are broadcast; beyond it the join shuffles.
MAX_BROADCAST_LONG = 1_000
#: Parts that a dense block is cut into at most (of equal width; more of them would hold one moment each).
MAX_PARTS = 1 << 20


class Piece(NamedTuple):
    """Equal consecutive events: place of the first, times of the first and last, how many, and what they hold."""

    first_pos: int
    at: int
    at2: int
    t_first: int
    t_last: int
    n: int
    sig: int
    tokens: frozenset | None


def dissimilarity(a: Piece, b: Piece) -> float:
    """0 for equal events; else 1 less the shared part of their tokens (1 where no tokens are given)."""
    if a.sig == b.sig:
        return 0.0
    if not a.tokens or not b.tokens:
        return 1.0
    both = len(a.tokens & b.tokens)
    return 1.0 - both / (len(a.tokens) + len(b.tokens) - both)


def segment(chain: Sequence[Piece], penalty: float) -> list[tuple[int, int]]:
    """Runs (from, to) of a chain that minimise dissimilarity within runs plus `penalty` a run.

    The cost of a run is the least sum of dissimilarities of its events to one
    event of the chain. Two parts of a run cost no more than the run, so a start
    t whose total up to s is not below the best total at s can't be the start of
    a better run later and is pruned; what is left is exact. Of equal totals
    the run with the earliest start is taken.
    """
    m = len(chain)
    reps = list({p.sig: p for p in reversed(chain)}.values())
    if len(reps) == 1:
        return [(0, m)]
    best, back = [0.0], [0]
    starts, sums = np.empty(0, dtype=np.int64), np.empty((0, len(reps)))
    far: dict[int, np.ndarray] = {}
    for s in range(1, m + 1):
        x = chain[s - 1]
        if x.sig not in far:
            far[x.sig] = np.array([dissimilarity(r, x) for r in reps])
        starts, sums = np.append(starts, s - 1), np.vstack([sums, np.zeros(len(reps))]) + far[x.sig] * x.n
        totals = np.array([best[t] for t in starts]) + sums.min(axis=1)
        low = int(np.argmin(totals))
        best.append(float(totals[low]) + penalty)
        back.append(int(starts[low]))
        keep = totals < best[s]
        starts, sums = starts[keep], sums[keep]
    runs, s = [], m
    while s:
        runs.append((back[s], s))
        s = back[s]
    return runs[::-1]


def _runs(chain: list[Piece], penalty: float) -> Iterator[Piece]:
    for a, b in segment(chain, penalty):
        first, last, top = chain[a], chain[b - 1], max(chain[a:b], key=lambda p: p.n)
        yield first._replace(t_last=last.t_last, n=sum(p.n for p in chain[a:b]), sig=top.sig)


class _Chains:
    """Takes a sequence's events in order; gives finished chains of pieces."""

    def __init__(self) -> None:
        self.chain: list[Piece] = []

    def add(self, p: Piece) -> list[Piece] | None:
        done = None
        if self.chain:
            last = self.chain[-1]
            if last.sig == p.sig and last.tokens == p.tokens:
                self.chain[-1] = last._replace(t_last=p.t_last, n=last.n + p.n)
                return None
            if dissimilarity(last, p) >= 1.0:
                done, self.chain = self.chain, []
        self.chain.append(p)
        return done


def _rows(batches: Iterator[pa.RecordBatch], keys: Sequence[str], with_tokens: bool) -> Iterator[tuple[tuple, bool, Piece]]:
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in (*keys, "block", "long", "pos", "at", "at2", "t", "sig", *(["tokens"] if with_tokens else []))}
        tokens = cols.get("tokens") or [None] * batch.num_rows
        ks = list(zip(*[cols[k] for k in keys], cols["block"], strict=True))
        for k, long, pos, at, at2, t, sig, tok in zip(ks, cols["long"], cols["pos"], cols["at"], cols["at2"], cols["t"], cols["sig"], tokens, strict=True):
            yield k, long, Piece(pos, at, at2, t, t, 1, sig, frozenset(tok) if tok else None)


#: How a chain of pieces lies in its block: inside, or touching its start, its end, or both.
INSIDE, STARTS, ENDS = 0, 1, 2


class Recursion:
    """The recursion of `segment` where events are equal or have nothing in common, event by event.

    A run then costs its events less those of its most frequent kind, so a start
    carries counts of kinds and no table of candidates. Starts are pruned by the
    same rule: one whose total is not below the best total plus the penalty is
    never the start of a better run. All later runs begin at a start that is left
    or at the next event, whose way back leads through one that is left; so as
    soon as one start is left, the runs before it are decided and given, and
    nothing is kept of pruned starts. Tests hold it against `segment`.
    """

    def __init__(self, penalty: float) -> None:
        self.penalty = penalty
        # A start: its event, best total before it, start of the run before it, that run (last time, events, kind), counts by kind, events, greatest count, its kind.
        self.starts: list[list] = []
        self.best, self.back, self.run = 0.0, None, None

    def take(self, events: Iterable[tuple]) -> list[Piece]:
        """The runs that are decided by further events (the fields of a piece, without tokens)."""
        penalty, starts, best, back, run = self.penalty, self.starts, self.best, self.back, self.run
        out: list[Piece] = []
        for e in events:
            n, kind = e[5], e[6]
            starts.append([e, best, back, run, {}, 0, 0, kind])
            totals, low = [], float("inf")
            for x in starts:
                counts = x[4]
                k = counts[kind] = counts.get(kind, 0) + n
                x[5] += n
                if k > x[6]:
                    x[6], x[7] = k, kind
                total = x[1] + x[5] - x[6]
                totals.append(total)
                if total < low:
                    low, back = total, x
            best, run = low + penalty, (e[4], back[5], back[7])
            starts = [x for x, total in zip(starts, totals, strict=True) if total < best]
            if len(starts) == 1 and starts[0][2] is not None:
                out.extend(self._before(starts[0][2], starts[0][3]))
                starts[0][2] = None
        self.starts, self.best, self.back, self.run = starts, best, back, run
        return out

    def end(self) -> list[Piece]:
        """The runs that are left at the end of the sequence."""
        return self._before(self.back, self.run)

    @staticmethod
    def _before(back: list | None, run: tuple | None) -> list[Piece]:
        out = []
        while back is not None:
            e = back[0]
            out.append(Piece(e[0], e[1], e[2], e[3], run[0], run[1], run[2], None))
            back, run = back[2], back[3]
        return out[::-1]


def equal_segments(sig: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the longest runs of equal events; `first` marks the start of each sequence.

    With a penalty below a half, `segment` and `Recursion` come to these runs where
    events are equal or have nothing in common: taking in another event costs
    more than parting before and after it. No query uses it; tests hold the
    recursions against it.
    """
    differs = np.ones(len(sig), dtype=bool)
    differs[1:] = (sig[1:] != sig[:-1]) | first[1:]
    return np.flatnonzero(differs)


def _recursed(batches: Iterator[pa.RecordBatch], keys: Sequence[str], penalty: float) -> Iterator[tuple[tuple, bool, Piece, int]]:
    """Runs of each block by `Recursion`, in order, and how they lie in it; a block goes on from batch to batch."""
    key, long, recursion, where = None, False, None, STARTS
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys]
        codes.append(batch.column("block").to_numpy(zero_copy_only=False))
        first = np.zeros(batch.num_rows, dtype=bool)
        first[0] = True
        for c in codes:
            first[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(first)
        names = zip(*[batch.column(c).take(pa.array(at)).to_pylist() for c in (*keys, "block", "long")], strict=True)
        t = batch.column("t").to_pylist()
        events = zip(*[batch.column(c).to_pylist() for c in ("pos", "at", "at2")], t, t, repeat(1), batch.column("sig").to_pylist(), strict=False)
        for (*k, is_long), n in zip(names, np.diff(np.append(at, batch.num_rows)).tolist(), strict=True):
            if k != key:
                if recursion is not None:
                    yield from _last(key, long, recursion.end(), where)
                key, long, recursion, where = k, is_long, Recursion(penalty), STARTS
            for p in recursion.take(islice(events, n)):
                yield tuple(key), long, p, where
                where = INSIDE
    if recursion is not None:
        yield from _last(key, long, recursion.end(), where)


def _last(key: list, long: bool, runs: list[Piece], where: int) -> Iterator[tuple[tuple, bool, Piece, int]]:
    for i, p in enumerate(runs, 1):
        yield tuple(key), long, p, where | (ENDS if i == len(runs) else 0)
        where = INSIDE


def _chains(batches: Iterator[pa.RecordBatch], keys: Sequence[str], with_tokens: bool) -> Iterator[tuple[tuple, bool, list[Piece], int]]:
    """Chains of each block (parted where neighbours have nothing in common), and how they lie in it."""
    key, chains, long, where = None, _Chains(), False, STARTS
    for k, is_long, p in _rows(batches, keys, with_tokens):
        if k != key:
            if key is not None:
                yield key, long, chains.chain, where | ENDS
            key, chains, long, where = k, _Chains(), is_long, STARTS
        done = chains.add(p)
        if done:
            yield key, long, done, where
            where = INSIDE
    if key is not None:
        yield key, long, chains.chain, where | ENDS


def _table(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _by_recursion(with_tokens: bool, penalty: float) -> bool:
    """Whether `Recursion` takes a block whole. From a half on, its runs would take in events that neighbours must be parted from; chains of equal events are cut first then."""
    return not with_tokens and penalty < 0.5


def _collapse(batches: Iterator[pa.RecordBatch], keys: Sequence[str], with_tokens: bool, penalty: float, least: int) -> Iterator[pa.RecordBatch]:
    """Runs of each block; of a long sequence, the chains at a block's ends come as pieces, with how they lie."""
    out: list[tuple] = []
    names = [*keys, "block", *Piece._fields, "lies"]
    kinds = [*[pa.string()] * len(keys), *[pa.int64()] * 8, pa.list_(pa.int64()), pa.int32()]
    if _by_recursion(with_tokens, penalty):
        found = ((k, long, [p], [p], where) for k, long, p, where in _recursed(batches, keys, penalty))
    else:
        found = ((k, long, chain, None, where) for k, long, chain, where in _chains(batches, keys, with_tokens))
    for k, long, chain, runs, where in found:
        if long and where != INSIDE:
            out.extend((*k, *p[:-1], sorted(p.tokens) if p.tokens else None, where) for p in chain)
        elif len(chain) > 1 or chain[0].n >= least:
            out.extend((*k, *p[:-1], None, INSIDE) for p in runs or _runs(chain, penalty) if p.n >= least)
        if len(out) >= 20_000:
            yield _table(out, names, kinds)
    if out:
        yield _table(out, names, kinds)


def _stitch(batches: Iterator[pa.RecordBatch], keys: Sequence[str], with_tokens: bool, penalty: float, least: int) -> Iterator[pa.RecordBatch]:
    """Runs of the chains at the ends of blocks, joined where one block's end meets the next one's start."""
    names, kinds = [*keys, "first_pos", "t_first", "t_last", "n"], [*[pa.string()] * len(keys), *[pa.int64()] * 4]
    by_recursion = _by_recursion(with_tokens, penalty)
    key, place, chains, recursion, out = None, None, _Chains(), Recursion(penalty), []

    def put(runs: Iterable[Piece]) -> None:
        out.extend((*key, p.first_pos, p.t_first, p.t_last, p.n) for p in runs if p.n >= least)

    def close(chain: list[Piece]) -> None:
        put(_runs(chain, penalty))

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (*keys, "block", "lies", *Piece._fields)]
        for row in zip(*cols, strict=True):
            k, here = row[: len(keys)], row[len(keys) : len(keys) + 2]
            p = Piece(*row[len(keys) + 2 : -1], frozenset(row[-1]) if row[-1] else None)
            meets = k == key and (here == place or place[1] & ENDS and here[1] & STARTS and here[0] != place[0])
            if not meets and key is not None:
                if chains.chain:
                    close(chains.chain)
                put(recursion.end())
                chains, recursion = _Chains(), Recursion(penalty)
            key, place = k, here
            if by_recursion:
                put(recursion.take([p]))
                continue
            done = chains.add(p)
            if done:
                close(done)
        if len(out) >= 20_000:
            yield _table(out, names, kinds)
    if chains.chain:
        close(chains.chain)
    put(recursion.end())
    if out:
        yield _table(out, names, kinds)


class Blocks(NamedTuple):
    """How long sequences are cut: `sequences` (keys, lo, width) into blocks of equal width of their order, and `dense` (keys, b, lo2, width2) those blocks again that hold too many rows, between their own ends."""

    sequences: DataFrame
    dense: DataFrame


def _coarse(lo: str = "lo", width: str = "width", at: str = "at") -> Column:
    return F.expr(f"({at} - {lo}) div {width}")


def long_sequences(rows: DataFrame, keys: Sequence[str], order: str, block_rows: int = BLOCK_ROWS) -> Blocks:
    """Blocks of about `block_rows` rows for the sequences that have more.

    A sequence gets as many blocks as it has rows for, and a block with more
    than twice `block_rows` rows is cut again in the same way. Both are
    arithmetic on the order, so no list of cut points is made or sent.
    """
    keys = list(keys)
    at = F.col(order).cast("bigint")
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("lo"), F.max(at).alias("_hi")).filter(F.col("_n") > block_rows)
    long = cut(long.select(*keys, "lo", F.greatest(F.expr(f"(_hi - lo) div (_n div {block_rows} + 1) + 1"), F.lit(1)).alias("width")))
    few = long.count() <= MAX_BROADCAST_LONG
    per = rows.select(*keys, at.alias("at")).join(F.broadcast(long) if few else long, keys).groupBy(*keys, _coarse().alias("b")).agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("lo2"), F.max("at").alias("_hi2"))
    dense = per.filter(F.col("_n") > 2 * block_rows).select(*keys, "b", "lo2", F.expr(f"(_hi2 - lo2) div least(_n div {block_rows} + 1, {MAX_PARTS}) + 1").alias("width2"))
    return Blocks(long, cut(dense))


def _blocked(rows: DataFrame, blocks: Blocks, keys: list[str]) -> DataFrame:
    """Rows with `block`, which rises along `at`, and `long`: whether their sequence has several."""
    long, dense = (F.broadcast(x) if x.count() <= MAX_BROADCAST_LONG else x for x in blocks)
    rows = rows.join(long, keys, "left").withColumn("b", _coarse()).join(dense, [*keys, "b"], "left")
    part = F.coalesce(_coarse("lo2", "width2"), F.lit(0))
    block = F.coalesce(F.col("b") * MAX_PARTS + F.least(F.greatest(part, F.lit(0)), F.lit(MAX_PARTS - 1)), F.lit(0))
    return rows.withColumn("block", block.cast("bigint")).withColumn("long", F.col("lo").isNotNull()).drop("lo", "width", "b", "lo2", "width2")


def collapse_runs(events: DataFrame, keys: Sequence[str], long: Blocks, penalty: float = 0.25, least: int = 1, with_tokens: bool = False) -> DataFrame:
    """Runs of every sequence: keys, first_pos, n_events, t_first, t_last.

    `events` has the string columns `keys`, pos (what names an event), at and
    at2 (bigint: the order, total within a sequence), t (bigint time), sig
    (bigint: equal events have equal ones) and, where `with_tokens`, tokens
    (array<bigint>: the more two events share, the more alike). Without tokens,
    events are equal or have nothing in common, and the least total is that of the
    longest runs of equal events; `Recursion` finds it over all events of a block. `long` names sequences to be cut into blocks (`long_sequences`).
    Runs of fewer than `least` events are left out. Rows with a null key, order
    or sig must be filtered before; repeated events count as events; an empty
    table gives no rows; further columns are ignored.
    """
    keys = list(keys)
    cols = ["pos", "at", "at2", "t", "sig", *(["tokens"] if with_tokens else [])]
    rows = _blocked(events.select(*keys, *cols), long, keys)
    rows = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "at", "at2")
    names = ", ".join(f"{k} string" for k in keys)
    schema = f"{names}, block bigint, first_pos bigint, at bigint, at2 bigint, t_first bigint, t_last bigint, n bigint, sig bigint, tokens array<bigint>, lies int"
    pieces = rows.mapInArrow(lambda b: _collapse(b, keys, with_tokens, penalty, least), schema)
    result = ["first_pos", F.col("n").alias("n_events"), "t_first", "t_last"]
    if long.sequences.isEmpty():
        return pieces.select(*keys, *result)
    pieces = cut(pieces)
    ends = pieces.filter("lies <> 0").repartition(*keys).sortWithinPartitions(*keys, "block", "at", "at2")
    joined = ends.mapInArrow(lambda b: _stitch(b, keys, with_tokens, penalty, least), f"{names}, first_pos bigint, t_first bigint, t_last bigint, n bigint")
    return pieces.filter("lies = 0").select(*keys, *result).unionByName(joined.select(*keys, *result))
