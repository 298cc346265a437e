"""The N best items of every group, by descending score bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, keep

#: Scales (values of `scale`) up to which cut points are kept per scale and broadcast: a fixed bound on rows.
MAX_SCALES = 10_000
#: Filled groups up to which their list is broadcast; beyond it the anti-join shuffles.
MAX_BROADCAST_GROUPS = 50_000
#: Rows of a task that are cut to n per group together.
CUT_ROWS = 1 << 18


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """A number for each distinct value; null is a value of its own."""
    d = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy(zero_copy_only=False), max(1, len(d.dictionary))


def _places(items: pa.ChunkedArray) -> np.ndarray:
    """Numbers that order values as the values do (text by code point)."""
    d = pc.dictionary_encode(items).combine_chunks()
    d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
    rank = np.empty(len(d.dictionary), dtype=np.int64)
    rank[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(d.dictionary))
    return rank[d.indices.to_numpy(zero_copy_only=False)]


def _best(rows: pa.Table, groups: Sequence[str], n: int) -> pa.Table:
    """Each group's n best distinct items among these rows."""
    group = np.zeros(rows.num_rows, dtype=np.int64)
    for g in groups:
        code, size = _codes(rows.column(g))
        group = np.unique(group * size + code, return_inverse=True)[1]
    item, down = _places(rows.column("_item")), -rows.column("_score").to_numpy()
    order = np.lexsort((down, item, group))
    g, i = group[order], item[order]
    order = order[np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])))]
    order = order[np.lexsort((item[order], down[order], group[order]))]
    g = group[order]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    return rows.take(pa.array(np.sort(order[place < n])))


def _cut(batches: Iterator[pa.RecordBatch], groups: Sequence[str], n: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CUT_ROWS:
            rest = _best(pa.Table.from_batches(held), groups, n)
            # What is left of many rows stays to meet the next ones; where little was cut, it goes on.
            if rest.num_rows > CUT_ROWS // 4:
                yield from rest.to_batches()
                rest = rest.slice(0, 0)
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield from _best(pa.Table.from_batches(held), groups, n).to_batches()


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int = 5, scale: str | None = None, quantiles: Sequence[float] = (0.9, 0.5)) -> DataFrame:
    """The n best distinct items of every group: groups, rank_no (from 1), item, score.

    Rows with a null item or a null or NaN score do not count. An item found
    more than once in a group counts once, with its highest score. Order: score
    descending, then item ascending by code point, so ranks are fixed; infinite
    scores are ordinary values. Null group keys are values of their own. Groups
    with fewer than n items give fewer rows; an empty table gives none. Further
    columns are ignored.

    The scores of each scale are cut into bands at `quantiles` (approximate cut
    points do, any cut is right). Bands run from the top. A task first cuts its
    rows of the band to n items a group, so a group with any number of rows
    leaves the task as n rows. Filled groups leave by an anti-join; what is left
    meets the rows of the band above that did not fill their group, and is
    ranked exactly. Equal scores never straddle two bands, so a group that holds
    n items after a band is done. The anti-join, the reduction to items and the
    ranking share one shuffle by group.
    """
    groups = list(groups)
    rows = df.filter(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = rows.select(*groups, F.col(item).alias("_item"), F.col(score).cast("double").alias("_score"), (F.col(scale) if scale else F.lit(0)).alias("_scale"))
    at = [float(q) for q in sorted(quantiles, reverse=True)]
    cuts = cut(rows.groupBy("_scale").agg(F.percentile_approx("_score", at, 1000).alias("_cuts")))
    if cuts.count() > MAX_SCALES:
        cuts = cut(rows.groupBy().agg(F.percentile_approx("_score", at, 1000).alias("_cuts")))
        banded = rows.crossJoin(F.broadcast(cuts))  # one row of cut points
    else:
        cuts = cuts.withColumnRenamed("_scale", "_cut_scale")
        banded = rows.join(F.broadcast(cuts), rows["_scale"].eqNullSafe(cuts["_cut_scale"]))
    band = reduce(lambda otherwise, i: F.when(F.col("_score") >= F.col("_cuts")[i], i).otherwise(otherwise), reversed(range(len(at))), F.lit(len(at)))
    plain = rows.select(*groups, "_item", "_score").schema
    # One column for the group: equal structs match null keys too, and joins, aggregates and windows share its partitioning.
    group = F.struct(*groups).alias("_g")
    best_first = Window.partitionBy("_g").orderBy(F.col("_score").desc(), F.col("_item").asc())
    done, open_rows, filled = [], None, None
    for i in range(len(at) + 1):
        part = banded.filter(band == i).select(*groups, "_item", "_score").mapInArrow(lambda b: _cut(b, groups, n), plain).select(group, "_item", "_score")
        part = part if open_rows is None else part.unionByName(open_rows)
        if filled is not None:
            part = part.join(F.broadcast(filled) if filled.count() <= MAX_BROADCAST_GROUPS else filled, "_g", "left_anti")
        best = part.groupBy("_g", "_item").agg(F.max("_score").alias("_score")).withColumn("rank_no", F.row_number().over(best_first)).filter(F.col("rank_no") <= n)
        if i < len(at):
            best = keep(best)
            full = best.filter(F.col("rank_no") == n).select("_g")
            filled = full if filled is None else filled.unionByName(full)
            open_rows = best.join(full, "_g", "left_anti").select("_g", "_item", "_score")
            best = best.join(full, "_g", "left_semi")
        done.append(best)
    out = reduce(lambda a, b: a.unionByName(b), done)
    return out.select(*[F.col("_g")[g].alias(g) for g in groups], "rank_no", F.col("_item").alias(item), F.col("_score").alias(score))
