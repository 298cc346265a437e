"""Connected components of a graph by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: node, component (its smallest node).

    Alternating large-star and small-star rounds until the edges stop changing.
    Each round works on minima per node (combined before the shuffle) joined
    back to the edges, so no neighbourhood is ever gathered. Rounds are
    checkpointed. Null ends, loops and repeated edges are ignored; only nodes
    with an edge appear; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = cut(e)
    before = _mark(e)
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lowest.select("hi", F.col("m").alias("lo")))
        e = cut(small.distinct())
        after = _mark(e)
        if after == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = after
    raise RuntimeError("components did not settle")
