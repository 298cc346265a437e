"""Joins and per-key results that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_NAME = "<null>"


def key_states(df: DataFrame, keys: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Compact state of each key: n rows and partial sums. Spark combines it before the shuffle, so a hot key costs one row a task."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: Sequence[str] = (),
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Aggregates over `left join right on keys`, without joining rows.

    Both inputs are reduced to a state per join key (and per `by` column of the
    left input) before the join; then counts multiply, and a sum of one side is
    multiplied by the count of the other. Result: `on`, `by`, n_left, n_right,
    n_pairs and the sums over all pairs. Null keys join each other (null is a
    value of its own). Repeated rows count as often as they occur; an empty side
    gives no rows; further columns are ignored.
    """
    ls, rs = left_sums or {}, right_sums or {}
    a = key_states(left, [*on, *by], ls)
    b = key_states(right, list(on), rs).select(*[F.col(k).alias(f"_r_{k}") for k in on], F.col("n").alias("_r_n"), *[F.col(k).alias(f"_r_sum_{k}") for k in rs])
    cond = None
    for k in on:
        c = a[k].eqNullSafe(b[f"_r_{k}"])
        cond = c if cond is None else cond & c
    joined = a.join(b, cond)
    return joined.select(
        *on,
        *by,
        F.col("n").alias("n_left"),
        F.col("_r_n").alias("n_right"),
        (F.col("n") * F.col("_r_n")).alias("n_pairs"),
        *[(F.col(k) * F.col("_r_n")).alias(k) for k in ls],
        *[(F.col(f"_r_sum_{k}") * F.col("n")).alias(k) for k in rs],
    )


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """Values of `fields` that at least `share` of all rows hold.

    Result: key_field, key_value (as stored; null as '<null>'), n, n_all. All
    rows count, repeated ones too. The rows are first reduced to a state per
    (field, value); the totals per field are a roll-up of the same compact
    states, and the two are joined by field, never row by row. At most
    1 / share values of a field can pass, whatever the data. A stored value
    '<null>' and a null stay two keys that print alike. Empty table: no rows.
    """
    fields = list(dict.fromkeys(fields))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("k")).select("k.key_field", "k.v")
    states = eager_join_aggregate(long, long.select("key_field"), on=["key_field"], by=["v"])
    exact = Fraction(str(share))
    return states.filter(F.col("n_left") * exact.denominator >= F.col("n_right") * exact.numerator).select(
        "key_field", F.coalesce("v", F.lit(NULL_NAME)).alias("key_value"), F.col("n_left").alias("n"), F.col("n_right").alias("n_all")
    )


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", share: float = 0.01, salts: int = 32) -> DataFrame:
    """Equi-join of a skewed left side with a right side of unique keys.

    Keys that hold `share` of the left rows or more are salted: their left rows
    spread over `salts` tasks, and only their right rows are repeated. At most
    1 / share keys can be that heavy, so the list of them has a fixed size. The
    other keys join as usual. `how` is inner or left.
    """
    counts = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = counts.join(F.broadcast(total), F.col("_n") >= F.col("_all") * share).select(on)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    others = [c for c in left.columns if c != on]
    l2 = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*others) if others else F.xxhash64(on), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    r2 = right.join(hot, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return l2.join(r2, [on, "_salt"], how).drop("_salt")


def self_pairs(df: DataFrame, keys: Sequence[str], id: str, limit: int = 2_000) -> DataFrame:
    """(keys, id_a, id_b) with id_a < id_b: pairs of ids that share a key, for distinct rows (keys, id).

    A key with more than `limit` rows is cut into blocks, and each pair of its
    blocks meets in a task of its own. Null keys share nothing.
    """
    keys = list(keys)
    rows = df.select(*keys, id)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("_n"))
    rows = rows.join(blocks.filter("_n > 1"), keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64(id, F.lit(11)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = rows.select(*keys, F.col(id).alias("id_a"), F.col("_b").alias("_i"), other.alias("_j"))
    b = rows.select(*keys, F.col(id).alias("id_b"), F.col("_b").alias("_j"), other.alias("_i"))
    return a.join(b, [*keys, "_i", "_j"]).filter("id_a < id_b").select(*keys, "id_a", "id_b")
