"""Aggregations over telemetry: nested responses, counters, histograms, frequencies, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of log levels in the severity column.
SPELLINGS = {"trace": ("trace",), "debug": ("debug", "dbg"), "info": ("info", "notice"), "warn": ("warn", "warning"), "error": ("error", "err"), "fatal": ("fatal", "crit", "critical")}


def level(c: Column) -> Column:
    """One spelling of a severity; null for an unknown one."""
    c = F.lower(F.btrim(c))
    out = F.lit(None).cast("string")
    for name, words in SPELLINGS.items():
        out = F.when(c.isin(*words), name).otherwise(out)
    return out


def unpivoted(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value): a row per row and feature."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(*keys, "x.feature", "x.value")


def top_values(df: DataFrame, groups: Sequence[str], value: str, n: int) -> DataFrame:
    """(groups, value, n, rank_no): the n most frequent values of each group; ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups).orderBy(F.col("n").desc(), F.col(value).asc())
    return counts.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= n)


def surge(df: DataFrame, groups: Sequence[str], value: str, active: Column, baseline: Column, least_active: int = 2, least_score: float = 2.0) -> DataFrame:
    """(groups, value, n_active, n_baseline, score): values more frequent while active, score (a + 1) / (b + 1)."""
    c = df.groupBy(*groups, value).agg(F.count_if(active).alias("n_active"), F.count_if(baseline).alias("n_baseline"))
    s = (F.col("n_active") + 1) / (F.col("n_baseline") + 1)
    return c.withColumn("score", s).filter((F.col("n_active") >= least_active) & (F.col("score") >= least_score))


def counter_increase(df: DataFrame, keys: Sequence[str], time: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """(keys, bucket, increase, n): how much a counter rose in each time bucket; a fall is a reset to zero.

    A sample is compared with the one before it in the same bucket, and the
    first of a bucket with the last of the bucket before, which is fetched from
    a table of one row per bucket; so only a bucket's rows are sorted together.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("bucket", bucket)
    ends = rows.groupBy(*keys, "bucket").agg(F.max(F.struct(*time, value)).alias("_e"))
    prior = ends.withColumn("_p", F.lag(F.col("_e")[value]).over(Window.partitionBy(*keys).orderBy("bucket"))).select(*keys, "bucket", "_p")
    here = Window.partitionBy(*keys, "bucket").orderBy(*time)
    r = rows.withColumn("_l", F.lag(value).over(here)).join(prior, [*keys, "bucket"])
    last = F.coalesce("_l", "_p")
    step = F.when(last.isNull(), F.lit(0.0)).when(F.col(value) < last, F.col(value)).otherwise(F.col(value) - last)
    return r.groupBy(*keys, "bucket").agg(F.sum(step).alias("increase"), F.count(F.lit(1)).alias("n"))


def histogram_quantile(buckets: DataFrame, groups: Sequence[str], upper: str, count: str, q: float) -> DataFrame:
    """(groups, quantile) of cumulative histogram buckets (upper bound inclusive, last one infinite).

    Linear within the bucket that the rank falls into, from zero or the bound
    before; in the last bucket the bound before it; null where there are no
    observations.
    """
    b = buckets.groupBy(*groups, upper).agg(F.sum(count).alias("_c"))
    w = Window.partitionBy(*groups).orderBy(F.col(upper).asc())
    total = b.groupBy(*groups).agg(F.max("_c").alias("_all"))
    c = b.withColumn("_c0", F.coalesce(F.lag("_c").over(w), F.lit(0))).withColumn("_u0", F.coalesce(F.lag(upper).over(w), F.lit(0.0))).join(total, list(groups))
    rank = F.col("_all") * q
    value = F.when(F.col(upper) == float("inf"), F.col("_u0")).when(F.col("_c") == F.col("_c0"), F.col(upper)).otherwise(F.col("_u0") + (F.col(upper) - F.col("_u0")) * (rank - F.col("_c0")) / (F.col("_c") - F.col("_c0")))
    hit = c.filter((F.col("_c") >= rank) & (F.col("_all") > 0))
    found = hit.groupBy(*groups).agg(F.min_by(value, F.col(upper)).alias("quantile"))
    return total.select(*groups).join(found, list(groups), "left")


def value_ranks(df: DataFrame, groups: Sequence[str], value: str, buckets: int = 256) -> DataFrame:
    """(_g, value, upto, n): each distinct value of a group, how many rows do not exceed it, and the group's rows; nulls and NaN don't count.

    _g is a struct of the groups. Rows are first reduced to a count per value;
    running sums go over buckets of values, then within a bucket, so no task
    sorts a whole group.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(*groups, F.lit(0).alias("_")).alias("_g"), F.col(value).alias("_v"))
    c = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_k"))
    cuts = c.groupBy("_g").agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"), F.sum("_k").alias("n"))
    c = c.join(cuts, "_g").withColumn("_b", F.size(F.filter("_cuts", lambda x: x <= F.col("_v")))).drop("_cuts")
    below = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy("_g", "_b").agg(F.sum("_k").alias("_s")).select("_g", "_b", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_s0"))
    here = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn("_u", F.sum("_k").over(here)).join(sums, ["_g", "_b"]).select("_g", F.col("_v").alias(value), (F.col("_u") + F.col("_s0")).alias("upto"), "n")


def nearest_rank(df: DataFrame, groups: Sequence[str], value: str, q: float) -> DataFrame:
    """(groups, n, quantile): the value at rank ceil(q n), 1 at least; exact."""
    r = value_ranks(df, groups, value).filter(F.col("upto") >= F.greatest(F.ceil(F.col("n") * q), F.lit(1)))
    return r.groupBy("_g").agg(F.max("n").alias("n"), F.min(value).alias("quantile")).select(*[F.col("_g")[g].alias(g) for g in groups], "n", "quantile")


def quantiles(df: DataFrame, groups: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """(groups, named quantiles): exact, linear between neighbouring values; groups without values have no row."""
    r = value_ranks(df, groups, value)
    n, v = F.col("n"), F.col(value).cast("double")
    at = {k: (F.floor((n - 1) * q), F.ceil((n - 1) * q), (n - 1) * q) for k, q in named.items()}
    ends = [x for k, (low, high, _) in at.items() for x in (F.min(F.when(F.col("upto") > low, v)).alias(f"_l_{k}"), F.min(F.when(F.col("upto") > high, v)).alias(f"_h_{k}"))]
    g = r.groupBy("_g").agg(F.max("n").alias("n"), *ends)
    return g.select(*[F.col("_g")[c].alias(c) for c in groups], *[(F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * (h - low)).alias(k) for k, (low, _, h) in at.items()])


def hashed_numbers(df: DataFrame, groups: Sequence[str], key: str, seed: str, digits: int = 3) -> DataFrame:
    """Rows with `place` (from 1, in the order of md5 of seed and key, then key, within the group) and `of` (the group's rows).

    The first hex digits of the hash cut a group into 16 ** digits even buckets;
    rows are numbered within their bucket and moved by the buckets before.
    """
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))).withColumn("_g", F.struct(*groups, F.lit(0).alias("_"))).withColumn("_b", F.substring("_h", 1, digits))
    sums = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_s"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_s").over(Window.partitionBy("_g")).alias("of"))
    here = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", key))
    return rows.withColumn("_p", here).join(sums, ["_g", "_b"]).select(*df.columns, (F.col("_p") + F.col("_s0")).alias("place"), "of")


def quota_sample(df: DataFrame, groups: Sequence[str], key: str, quota: Column | int, seed: str) -> DataFrame:
    """Rows of each group up to its quota, in the order of a hash of seed and key. Sampling is the feature; each task keeps no more than the quota."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))
    w = Window.partitionBy(*groups).orderBy(order, F.col(key))
    return df.withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= quota)


def allocate(capacity: dict[str, int], ratio: dict[str, float], total: int, rounds: int = 16) -> dict[str, int]:
    """Shares of a total in given ratios, none above its capacity; what is lacking goes to those with room, in proportion.

    Works on a handful of counts. Remainders of rounding go to the largest room first.
    """
    given = dict.fromkeys(capacity, 0)
    for _ in range(rounds):
        lack = total - sum(given.values())
        room = {k: capacity[k] - given[k] for k in capacity if capacity[k] > given[k] and ratio.get(k, 0) > 0}
        weight = sum(ratio[k] for k in room)
        if lack <= 0 or not room or weight <= 0:
            break
        moved = 0
        for k in sorted(room, key=lambda k: (-room[k], k)):
            add = min(room[k], int(lack * ratio[k] / weight))
            given[k] += add
            moved += add
        if not moved:
            for k in sorted(room, key=lambda k: (-room[k], k))[:lack]:
                given[k] += 1
    return given


def strided(df: DataFrame, groups: Sequence[str], is_error: Column, order: Sequence[str], n: int) -> DataFrame:
    """Up to n rows of each group: errors first, then every so many-th of the others, in the order of time."""
    rows = df.withColumn("_e", is_error)
    sizes = rows.groupBy(*groups).agg(F.count_if("_e").alias("_ne"), F.count_if(~F.col("_e")).alias("_no"))
    w = Window.partitionBy(*groups, "_e").orderBy(*order)
    r = rows.withColumn("_k", F.row_number().over(w)).join(sizes, list(groups))
    room = F.greatest(F.lit(n) - F.col("_ne"), F.lit(0))
    stride = F.greatest(F.ceil(F.col("_no") / F.nullif(room, F.lit(0))), F.lit(1))
    keep = F.when(F.col("_e"), F.col("_k") <= n).otherwise((room > 0) & ((F.col("_k") - 1) % stride == 0) & (F.floor((F.col("_k") - 1) / stride) < room))
    return r.filter(keep).select(*df.columns)
