"""Classification, retrieval and calibration metrics, and statistics over them.

Scores are first reduced to a row per distinct score, so the running sums that
the curves need go over distinct scores, not over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_counts(df: DataFrame, groups: Sequence[str], score: str, label: Column) -> DataFrame:
    """(groups, score, pos, neg): positives and negatives at each distinct score; null scores or labels don't count."""
    rows = df.filter(F.col(score).isNotNull()).withColumn("_y", label).filter("_y is not null")
    return rows.groupBy(*groups, score).agg(F.sum(F.when(F.col("_y"), 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("_y"), 0).otherwise(1)).alias("neg"))


def _curve(counts: DataFrame, groups: Sequence[str], score: str, buckets: int = 64) -> DataFrame:
    """Counts with tp and fp at each score and all_pos and all_neg of the group.

    The running sums go over buckets of scores first (a row per group and
    bucket), then within each bucket, so no task sorts a whole group.
    """
    named = list(groups)
    keyed = counts if named else counts.withColumn("_all", F.lit(0))
    by = named or ["_all"]
    cuts = keyed.groupBy(*by).agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    same = " and ".join(f"{k} <=> _k_{k}" for k in by)
    c = keyed.join(cuts.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_cuts", "all_pos", "all_neg"), F.expr(same)).drop(*[f"_k_{k}" for k in by])
    c = c.withColumn("_b", F.size(F.filter("_cuts", lambda x: x <= F.col(score)))).drop("_cuts")
    above = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy(*by, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_b").alias("_kb"), F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"))
    here = Window.partitionBy(*by, "_b").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_tp", F.sum("pos").over(here)).withColumn("_fp", F.sum("neg").over(here)).join(sums, F.expr(same + " and _b = _kb"))
    return c.select(*named, score, "pos", "neg", (F.col("_tp") + F.col("_p0")).alias("tp"), (F.col("_fp") + F.col("_n0")).alias("fp"), "all_pos", "all_neg")


def curve_areas(counts: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """(groups, n_pos, n_neg, pr_auc, pr_auc_trapezoid, roc_auc).

    pr_auc is the step average precision with tied scores as one step;
    pr_auc_trapezoid joins the points from (0, 1) by straight lines; roc_auc
    gives ties half. Without positives the PR areas are 0, without either class
    roc_auc is 0.
    """
    c = _curve(counts, groups, score)
    tp, fp, tp0, fp0 = F.col("tp"), F.col("fp"), F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    recall = lambda x: F.when(F.col("all_pos") > 0, x / F.col("all_pos")).otherwise(0.0)
    # The point before is what was counted above this score; above the first score precision is 1.
    c = c.withColumn("p", tp / (tp + fp)).withColumn("r", recall(tp)).withColumn("p0", F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)).withColumn("r0", recall(tp0))
    return c.groupBy(*groups).agg(
        F.max("all_pos").alias("n_pos"),
        F.max("all_neg").alias("n_neg"),
        F.round(F.sum(F.col("p") * (F.col("r") - F.col("r0"))), 6).alias("pr_auc"),
        F.round(F.sum((F.col("p") + F.col("p0")) / 2 * (F.col("r") - F.col("r0"))), 6).alias("pr_auc_trapezoid"),
        # Pairs in which the positive has the greater score: negatives below it, and half of those tied.
        F.round(F.coalesce(F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2)) / F.when((F.max("all_pos") > 0) & (F.max("all_neg") > 0), F.max("all_pos") * F.max("all_neg")), F.lit(0.0)), 6).alias("roc_auc"),
    )


def operating_point(counts: DataFrame, groups: Sequence[str], score: str, fpr: float) -> DataFrame:
    """(groups, threshold, precision_at, recall_at): the lowest score at which the false-positive rate is at most `fpr`; ties are taken whole."""
    c = _curve(counts, groups, score).filter((F.col("all_pos") > 0) & (F.col("all_neg") > 0)).filter(F.col("fp") <= F.col("all_neg") * fpr)
    last = c.groupBy(*groups).agg(F.min(F.struct(score, "tp", "fp", "all_pos")).alias("x"))
    return last.select(*groups, F.col("x")[score].alias("threshold"), F.round(F.col("x.tp") / (F.col("x.tp") + F.col("x.fp")), 6).alias("precision_at"), F.round(F.col("x.tp") / F.col("x.all_pos"), 6).alias("recall_at"))


def confusion(df: DataFrame, groups: Sequence[str], predicted: Column, label: Column, beta: float = 2.0) -> DataFrame:
    """(groups, tp, fp, fn, tn, precision, recall, fpr, f_beta); a ratio without cases is 0."""
    rows = df.withColumn("_p", predicted).withColumn("_y", label).filter("_p is not null and _y is not null")
    c = rows.groupBy(*groups).agg(F.count_if(F.expr("_p and _y")).alias("tp"), F.count_if(F.expr("_p and not _y")).alias("fp"), F.count_if(F.expr("not _p and _y")).alias("fn"), F.count_if(F.expr("not _p and not _y")).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    b2 = beta * beta
    f = F.coalesce((1 + b2) * F.col("precision") * F.col("recall") / F.nullif(b2 * F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return c.select(*groups, "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "fpr")], F.round(f, 6).alias("f_beta"))


def reliability(df: DataFrame, groups: Sequence[str], score: str, label: Column, bins: int = 10) -> DataFrame:
    """(groups, bin, n, confidence, accuracy): scores by bins of equal width; 1 falls into the last."""
    rows = df.filter(F.col(score).isNotNull()).withColumn("_y", label).filter("_y is not null")
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*groups, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(F.col("_y").cast("int")).alias("accuracy"))


def calibration_error(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, ece) of a reliability table: mean distance of confidence and accuracy, weighted by rows."""
    return table.groupBy(*groups).agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"))


def retrieval_by_query(hits: DataFrame, n_gold: DataFrame, systems: DataFrame, groups: Sequence[str], query: str, rank: str, ks: Sequence[int]) -> DataFrame:
    """(groups, query, n_gold, hit_k, recall_k, reciprocal_rank, ndcg_3) of every group for every query with gold.

    `hits` are the retrieved rows that are gold, `n_gold` is (query, n_gold)
    with n_gold > 0, `systems` the groups (few); a system without hits for a
    query misses it. nDCG is binary.
    """
    found = hits.groupBy(*groups, query).agg(*[F.count_if(F.col(rank) <= k).alias(f"_h{k}") for k in ks], F.min(rank).alias("_first"), F.sum(F.when(F.col(rank) <= 3, 1 / F.log2(F.col(rank) + 1))).alias("_dcg"))
    every = n_gold.select(query, "n_gold").crossJoin(F.broadcast(systems))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(3)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    j = every.join(found, [*groups, query], "left")
    out = [*groups, query, "n_gold"]
    for k in ks:
        h = F.coalesce(f"_h{k}", F.lit(0))
        out += [(h > 0).alias(f"hit_{k}"), (h / F.col("n_gold")).alias(f"recall_{k}")]
    return j.select(*out, F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg_3"))


def benjamini_hochberg(df: DataFrame, p: str, order: Sequence[str], families: Sequence[str] = ()) -> DataFrame:
    """Rows with q_value: the step-up false discovery rate, monotone in p; null p-values get none and don't count.

    The q-value of a p-value is the least p n / rank at or above it. The table
    of p-values is one of results, a row per comparison.
    """
    rows = df.filter(F.col(p).isNotNull())
    up = Window.partitionBy(*families).orderBy(F.col(p).asc(), *[F.col(c).asc() for c in order])
    whole = Window.partitionBy(*families)
    r = rows.withColumn("_x", F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(whole) / F.row_number().over(up)))
    return r.withColumn("q_value", F.min("_x").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))).drop("_x")


#: Upper ends of the distribution function of a Poisson variable with mean 1, times 2**32, rounded.
POISSON = (1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276)


def _draws(digests: np.ndarray, replicates: int) -> np.ndarray:
    """Weights (rows x replicates) from the rows' digests: Poisson variables with mean 1."""
    u = digests.view(">u4").reshape(len(digests), -1)[:, :replicates]
    return np.searchsorted(np.array(POISSON, dtype=np.uint32), u.astype(np.uint32), side="right")


def _replicate_sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """Per group of a task: for every replicate the sum of weights and of weights times values."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        w, v = _draws(digests, replicates).astype(np.float64), batch.column("value").to_numpy()
        group = batch.column("groups").dictionary_encode()
        code = group.indices.to_numpy()
        for k, name in enumerate(group.dictionary.to_pylist()):
            at = code == k
            sums = np.stack((w[at].sum(axis=0), v[at] @ w[at]))
            total[name] = total[name] + sums if name in total else sums
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), *[pa.array([x[i] for x in total.values()], pa.list_(pa.float64())) for i in (0, 1)]], names=["groups", "weights", "sums"])


def replicate_means(rows: DataFrame, groups: Sequence[str], key: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(groups, replicate, m): mean of `value` in every bootstrap replicate.

    A row is drawn as often as a Poisson variable with mean 1 from the hash of
    seed, replicate and key says, so every system sees the same draws and the
    result doesn't depend on the partitions. A task returns two vectors a group.
    Replicates without any draw have no row; null values don't count.
    """
    groups = list(groups)
    # A digest of 128 bits serves four replicates.
    digest = F.concat(*[F.unhex(F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(i)), F.col(key)))) for i in range(-(-replicates // 4))])
    named = F.to_json(F.struct(*groups)) if groups else F.lit("{}")
    made = rows.filter(F.col(value).isNotNull()).select(named.alias("groups"), F.col(value).cast("double").alias("value"), digest.alias("digest"))
    sums = made.mapInArrow(lambda b: _replicate_sums(b, replicates), "groups string, weights array<double>, sums array<double>")
    long = sums.select("groups", F.posexplode(F.arrays_zip("weights", "sums")).alias("replicate", "x"))
    per = long.groupBy("groups", "replicate").agg(F.sum("x.weights").alias("w"), F.sum("x.sums").alias("s")).filter("w > 0")
    names = [F.get_json_object("groups", f"$.{g}").alias(g) for g in groups]
    return per.select(*names, "replicate", (F.col("s") / F.col("w")).alias("m"))


def bootstrap_interval(rows: DataFrame, groups: Sequence[str], key: str, value: str, replicates: int = 200, alpha: float = 0.05, seed: str = "b") -> DataFrame:
    """(groups, mean, low, high): mean of `value` over rows (groups are strings) and its percentile interval, index int(alpha n) of the sorted replicates."""
    means = replicate_means(rows, groups, key, value, replicates, seed)
    sorted_ = means.groupBy(*groups).agg(F.sort_array(F.collect_list(F.round("m", 9))).alias("ms"))
    n = F.size("ms")
    low = F.get("ms", F.floor(n * (alpha / 2)).cast("int"))
    high = F.get("ms", F.least(F.floor(n * (1 - alpha / 2)).cast("int"), n - 1))
    point = rows.groupBy(*groups).agg(F.avg(value).alias("mean"))
    joined = point.join(sorted_, list(groups)) if groups else point.crossJoin(sorted_)
    return joined.select(*groups, F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, replicates: int = 200, seed: str = "b") -> DataFrame:
    """(delta, low, high, p_value): mean of a - b over rows, its interval, and twice the smaller share of replicates on one side of 0 (ties half)."""
    d = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    means = replicate_means(d, [], key, "d", replicates, seed).select(F.round("m", 9).alias("m"))
    s = means.agg(F.sort_array(F.collect_list("m")).alias("ms"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("m") < 0, 1.0).when(F.col("m") == 0, 0.5).otherwise(0.0)).alias("below"))
    p = F.least(F.lit(1.0), 2 * F.least(F.col("below") / F.col("n"), 1 - F.col("below") / F.col("n")))
    return d.agg(F.round(F.avg("d"), 6).alias("delta")).crossJoin(s).select("delta", F.round(F.get("ms", F.floor(F.col("n") * 0.025).cast("int")), 6).alias("low"), F.round(F.get("ms", F.least(F.floor(F.col("n") * 0.975), F.col("n") - 1).cast("int")), 6).alias("high"), F.round(p, 6).alias("p_value"))


def paired_by_group(rows: DataFrame, groups: Sequence[str], key: str, difference: str, replicates: int = 100, seed: str = "b") -> DataFrame:
    """(groups, delta, low, high, p_value): as `paired_bootstrap`, for every group (strings) of differences at once."""
    groups = list(groups)
    means = replicate_means(rows, groups, key, difference, replicates, seed).withColumn("m", F.round("m", 9))
    s = means.groupBy(*groups).agg(F.sort_array(F.collect_list("m")).alias("ms"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("m") < 0, 1.0).when(F.col("m") == 0, 0.5).otherwise(0.0)).alias("below"))
    p = F.least(F.lit(1.0), 2 * F.least(F.col("below") / F.col("n"), 1 - F.col("below") / F.col("n")))
    low, high = F.get("ms", F.floor(F.col("n") * 0.025).cast("int")), F.get("ms", F.least(F.floor(F.col("n") * 0.975), F.col("n") - 1).cast("int"))
    return rows.groupBy(*groups).agg(F.round(F.avg(difference), 6).alias("delta")).join(s, groups).select(*groups, "delta", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(p, 6).alias("p_value"))
