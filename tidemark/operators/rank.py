"""Hashed vectors, and fusion and scaling of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.search import word_counts


def hashed_vectors(docs: DataFrame, key: str, words: Column, dimension: int) -> DataFrame:
    """(key, dim, value): hashed embedding. A word's sha256 gives its dimension and sign, its weight is 1 + ln tf; vectors have length 1."""
    p = word_counts(docs, key, words)
    h = F.sha2(F.col("word"), 256)
    dim = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dimension)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring(h, 9, 2), 16, 10).cast("int"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    v = p.select(key, dim.alias("dim"), (sign * (1 + F.log("tf"))).alias("x")).groupBy(key, "dim").agg(F.sum("x").alias("x"))
    norm = v.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return v.join(norm, key).filter("x <> 0").select(key, "dim", (F.col("x") / F.col("norm")).alias("value"))


def rrf(lists: DataFrame, groups: Sequence[str], item: str, source: str, rank: str, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(groups, item, score, first_source, first_rank): reciprocal rank fusion, sum of weight / (k + rank).

    first_source and first_rank are the smallest (source, rank) that names the
    item: the tie order of the fused ranking.
    """
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(source)), F.lit(1.0))
    got = lists.groupBy(*groups, item).agg(F.sum(w / (k + F.col(rank))).alias("score"), F.min(F.struct(source, rank)).alias("_f"))
    return got.select(*groups, item, "score", F.col("_f")[source].alias("first_source"), F.col("_f")[rank].alias("first_rank"))


def min_max(df: DataFrame, groups: Sequence[str], score: str, flat: float) -> DataFrame:
    """Rows with `scaled`: the score between its group's least and greatest; `flat` where they are equal."""
    ends = df.groupBy(*groups).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(ends, list(groups)).withColumn("scaled", F.when(span <= 1e-12, F.lit(flat)).otherwise((F.col(score) - F.col("_lo")) / span)).drop("_lo", "_hi")


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str = "rank_no") -> DataFrame:
    """Rows with their number in a total order within their group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
