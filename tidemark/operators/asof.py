"""Joins and look-backs along time that never sort a whole key in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `order` columns, then the greatest other columns.

    Spark reduces rows to one per key before the shuffle, so a key with many
    deliveries costs one row a task. Null order columns are smallest. Columns
    must be orderable (no maps).
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, value: str, width: int = DAY_US, inclusive: bool = False, ends: bool = False) -> DataFrame:
    """Left rows with n_before and last_value: how many right rows of the same key lie before, and the value of the latest.

    With `ends` also low_value and high_value: the least and greatest value among them.

    Before means strictly earlier, or not later where `inclusive`. Times are
    integers. Of right rows at the same time the greatest value counts as the
    latest. Left rows with a null key or time get 0 and null; right rows with a
    null key or time are left out; repeated right rows count as often as they occur.

    Time is cut into buckets: whole buckets are summed up on a table of one row
    per key and bucket, and only rows of one bucket are sorted together.
    """
    on = list(on)
    a, b = F.col(left_time), F.col(right_time)
    known = [F.col(k).isNotNull() for k in on]
    kept = right.filter(b.isNotNull())
    for k in known:
        kept = kept.filter(k)
    r = kept.select(*on, b.cast("bigint").alias("_t"), F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    per = r.groupBy(*on, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_t", "_v")).alias("_top"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    names = left.columns
    l2 = left.withColumn("_t", a.cast("bigint")).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    # One row per key and bucket of either side, with what lies in earlier buckets.
    marks = per.unionByName(l2.select(*on, "_b").distinct().select(*on, "_b", F.lit(0).cast("bigint").alias("_n"), *[F.lit(None).cast(per.schema[c].dataType).alias(c) for c in ("_top", "_lo", "_hi")]))
    marks = marks.groupBy(*on, "_b").agg(F.sum("_n").alias("_n"), F.max("_top").alias("_top"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    earlier = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*on, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.last("_top", ignorenulls=True).over(earlier).alias("_top0"), F.min("_lo").over(earlier).alias("_lo0"), F.max("_hi").over(earlier).alias("_hi0"))
    side = F.lit(0 if inclusive else 1)
    rows = l2.select(*on, "_b", "_t", (1 - side).alias("_late"), F.struct(*names).alias("_row"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
    rows = rows.unionByName(r.select(*on, "_b", "_t", side.alias("_late"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_v"))
    here = Window.partitionBy(*on, "_b").orderBy("_t", "_late", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_right = F.col("_row").isNull()
    rows = rows.withColumn("_n", F.count(F.when(is_right, 1)).over(here)).withColumn("_top", F.max(F.when(is_right, F.struct("_t", "_v"))).over(here))
    if ends:
        rows = rows.withColumn("_lo1", F.min("_v").over(here)).withColumn("_hi1", F.max("_v").over(here))
    rows = rows.filter(~is_right)
    rows = rows.filter("_t is not null")
    for k in known:
        rows = rows.filter(k)
    outer = [F.least("_lo0", "_lo1").alias("low_value"), F.greatest("_hi0", "_hi1").alias("high_value")] if ends else []
    found = rows.join(marks, [*on, "_b"]).select("_row.*", (F.col("_n") + F.col("_n0")).alias("n_before"), F.coalesce("_top", "_top0")["_v"].alias("last_value"), *outer)
    lost = a.isNull()
    for k in known:
        lost = lost | ~k
    return found.unionByName(left.filter(lost).select("*", F.lit(0).cast("bigint").alias("n_before"), *[F.lit(None).cast(r.schema["_v"].dataType).alias(c) for c in ("last_value", *(("low_value", "high_value") if ends else ()))]))


def with_recent(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], n: int, block: Column) -> DataFrame:
    """Rows with `recent`: the `values` of the up to n rows of the same key before, newest first (array of structs).

    `order` must be total within a key, and `block` (bigint) must not fall along
    it. A key is cut at its blocks; each block gets the last n rows of each of
    the n blocks before it as context, so a block sorts its own rows and n * n
    others, whatever a key holds. Null keys are keys of their own.
    """
    keys, order, values = list(keys), list(order), list(values)
    names = df.columns
    rows = df.withColumn("_b", block)
    blocks = rows.select(*keys, "_b").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_b")))
    same = rows["_b"] == blocks["_b"]
    for k in keys:
        same = same & rows[k].eqNullSafe(blocks[k])
    rows = rows.join(blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "_i"), F.expr(" and ".join([f"{k} <=> _k_{k}" for k in keys] + ["_b = _kb"]))).select(*names, "_i")
    newest = Window.partitionBy(*keys, "_i").orderBy(*[F.col(c).desc() for c in order])
    tails = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")
    context = tails.withColumn("_i", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + n))).withColumn("_own", F.lit(False))
    both = rows.withColumn("_own", F.lit(True)).unionByName(context)
    before = Window.partitionBy(*keys, "_i").orderBy(*order).rowsBetween(-n, -1)
    both = both.withColumn("recent", F.reverse(F.collect_list(F.struct(*values)).over(before)))
    return both.filter("_own").select(*names, "recent")


class _Recent:
    """Of a key's rows so far: the n latest of each of the n + 1 owners seen last."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def add(self, t: int, id: str, owner: str | None) -> None:
        self.held[owner] = sorted([*self.held.get(owner, ()), (-t, id)])[: self.n]
        if len(self.held) > self.n + 1:
            # The n latest rows of other owners lie with the n + 1 owners seen last.
            self.held.pop(max(self.held, key=lambda k: self.held[k][0]))

    def others(self, owner: str | None) -> list[tuple[int, str]]:
        return sorted(x for k, xs in self.held.items() if k != owner for x in xs)[: self.n]

    def rows(self) -> list[tuple]:
        return [(-t, id, k) for k, xs in self.held.items() for t, id in xs]


def _sorted_keys(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def _block_states(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Before each block of a key: what all its earlier blocks leave."""
    key, block, state, out = None, None, _Recent(n), []

    def table() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["g", "b", "id", "owner", "t"])

    for g, b, id, owner, t in _sorted_keys(batches, ("g", "b", "id", "owner", "t")):
        if g != key:
            key, block, state = g, b, _Recent(n)
        elif b != block:
            block = b
            out.extend((g, b, i, o, u) for u, i, o in state.rows())
        if len(out) >= 20_000:
            yield table()
            out = []
        state.add(t, id, owner)
    if out:
        yield table()


def _answers(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    key, now, waiting, state, out = None, None, [], _Recent(n), []
    table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], names=["id", "other", "place"])
    for g, b, own, id, owner, t in _sorted_keys(batches, ("g", "b", "own", "id", "owner", "t")):
        if (g, b) != key or t != now:
            for x in waiting:
                state.add(*x)
            waiting, now = [], t
            if (g, b) != key:
                key, state = (g, b), _Recent(n)
        if own:
            out.extend((id, other, k) for k, (_, other) in enumerate(state.others(owner), 1))
            if len(out) >= 20_000:
                yield table()
                out = []
        waiting.append((t, id, owner))
    if out:
        yield table()


def recent_others(df: DataFrame, keys: Sequence[str], id: str, owner: str, time: str, n: int, block: Column) -> DataFrame:
    """(id, other, place): for each row the n latest strictly earlier rows of its keys with another owner; ties by id.

    Null owners are one owner. Rows with a null id, time or key are left out.
    `block` (bigint) must not fall along the time. Each block is read in order
    with a state of n rows for n + 1 owners, which it gets from a table of its
    key's blocks, so no pair of rows is formed and no key waits for one task.
    """
    rows = df.filter(F.col(id).isNotNull() & F.col(time).isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    rows = rows.select(F.to_json(F.struct(*keys)).alias("g"), block.cast("bigint").alias("b"), F.col(id).cast("string").alias("id"), F.col(owner).cast("string").alias("owner"), F.col(time).cast("bigint").alias("t"))
    # Of a block only the n latest rows of the n + 1 owners seen last can matter later.
    late = rows.withColumn("_r", F.row_number().over(Window.partitionBy("g", "b", "owner").orderBy(F.col("t").desc(), F.col("id").asc()))).filter(F.col("_r") <= n)
    first = late.withColumn("_m", F.max("t").over(Window.partitionBy("g", "b", "owner")))
    late = first.withColumn("_o", F.dense_rank().over(Window.partitionBy("g", "b").orderBy(F.col("_m").desc(), "owner"))).filter(F.col("_o") <= n + 1).select("g", "b", "id", "owner", "t")
    marks = late.repartition("g").sortWithinPartitions("g", "b", "t")
    state = marks.mapInArrow(lambda x: _block_states(x, n), "g string, b bigint, id string, owner string, t bigint")
    both = rows.withColumn("own", F.lit(True)).unionByName(state.withColumn("own", F.lit(False)))
    both = both.repartition("g", "b").sortWithinPartitions("g", "b", "t")
    return both.select("g", "b", "own", "id", "owner", "t").mapInArrow(lambda x: _answers(x, n), "id string, other string, place int")
