"""Queries of metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators.relations import gold_counts, gold_pairs
from tidemark.plans import views as V
from tidemark.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a score (p95 latency, 10 s as 1) and whether they are worth a ticket."""
    s = F.least(F.floor(F.coalesce(F.col(V.FEATURES[0]), F.lit(0.0)) / 10.0), F.lit(1000)) / 1000.0
    return V.windows(spark, sf_dir).filter("label is not null").select("window_id", "source", "family", "service", "window_type", "is_hard_case", s.alias("score"), (F.col("label") == "ticket_worthy").alias("y"))


def gold_found(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """The retrieved rows that are gold."""
    return gold_pairs(ranked, V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir))


def gold_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, n_gold, first_gold, last_gold) of the windows that have gold."""
    return gold_counts(V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir)).filter("n_gold > 0")


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.ranked(spark, sf_dir)
    asked = table(spark, sf_dir, "hits").select("window_id").distinct()
    n = gold_numbers(spark, sf_dir).join(asked, "window_id", "left_semi")
    return M.retrieval_by_query(gold_found(spark, sf_dir, r), n, r.select("pipeline_name").distinct(), ["pipeline_name"], "window_id", "rank_no", (1, 3, 5))


def m1_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas under the precision-recall (two forms) and ROC curves by source."""
    return M.curve_areas(M.score_counts(scored(spark, sf_dir), ["source"], "score", F.col("y")), ["source"], "score")


def m4_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, precision and recall at false-positive rates of 1 % and 5 %."""
    c = M.score_counts(scored(spark, sf_dir), ["source"], "score", F.col("y"))
    rows = [M.operating_point(c, ["source"], "score", f).withColumn("max_fpr", F.lit(f)) for f in (0.01, 0.05)]
    return rows[0].unionByName(rows[1])


def m6_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and ratios at a score of 0.05, by phase."""
    return M.confusion(scored(spark, sf_dir), ["window_type"], F.col("score") >= 0.05, F.col("y"))


def m7_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability table of the scores."""
    t = M.reliability(scored(spark, sf_dir), [], "score", F.col("y"))
    return t.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def m7_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error by source."""
    return M.calibration_error(M.reliability(scored(spark, sf_dir), ["source"], "score", F.col("y")), ["source"])


def m9_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate, recall, mean reciprocal rank and nDCG of each pipeline over windows with gold."""
    r = _retrieval(spark, sf_dir)
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return r.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("n_windows"), *[mean(c) for c in ("hit_1", "hit_3", "hit_5", "recall_1", "recall_5", "reciprocal_rank", "ndcg_3")])


def m11_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of novelty among ticket-worthy windows, against missing gold."""
    s = V.states(spark, sf_dir).filter("decision = 'ticket_worthy' and is_novel is not null").select("window_id", "is_novel")
    w = V.windows(spark, sf_dir).filter("label = 'ticket_worthy'")
    gold = gold_numbers(spark, sf_dir).select("window_id", F.lit(True).alias("has_gold"))
    rows = w.join(s, "window_id").join(gold, "window_id", "left")
    return M.confusion(rows, [], F.col("is_novel"), F.col("has_gold").isNull(), beta=1.0)


def m12_novelty_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of novelty as signals are joined by 'or', per family and over all (family null): no hits, weak hits, decided novel."""
    w = V.windows(spark, sf_dir).filter("label = 'ticket_worthy'").select("window_id", "family")
    gold = gold_numbers(spark, sf_dir).select("window_id")
    novel = w.join(gold, "window_id", "left_anti")
    top = V.ranked(spark, sf_dir, 1).filter("pipeline_name = 'bi_encoder_retrieval'").select("window_id", "score")
    s = V.states(spark, sf_dir).select("window_id", "is_novel")
    r = novel.join(top, "window_id", "left").join(s, "window_id", "left")
    a = F.col("score").isNull()
    b = a | (F.col("score") < 0.5)
    c = b | F.coalesce("is_novel", F.lit(False))
    flags = r.select(F.coalesce("family", F.lit("<null>")).alias("family"), a.alias("a"), b.alias("b"), c.alias("c"))
    return flags.rollup("family").agg(F.count(F.lit(1)).alias("n_novel"), F.count_if(F.expr("a")).alias("no_hits"), F.count_if(F.expr("b")).alias("or_weak"), F.count_if(F.expr("c")).alias("or_decided"))


def m13_orphan_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold hits among the top five of windows expected in memory and of those not."""
    s = V.states(spark, sf_dir).filter("expected_in_memory is not null").select("window_id", "expected_in_memory")
    r = _retrieval(spark, sf_dir).join(s, "window_id")
    return r.groupBy("pipeline_name", "expected_in_memory").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit_5").cast("double")), 6).alias("hit_5"))


def m14_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (ticket-worthy decisions) per distinct incident, by phase."""
    s = V.states(spark, sf_dir)
    p = s.groupBy("window_type").agg(F.count_if(F.expr("decision in ('ticket_worthy', 'needs_review')")).alias("pages"), F.count_distinct("incident_id").alias("incidents"))
    return p.withColumn("pages_per_incident", F.round(F.col("pages") / F.nullif("incidents", F.lit(0)), 6))


def m16_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate among the top five with its bootstrap interval, by pipeline."""
    r = _retrieval(spark, sf_dir).select("pipeline_name", "window_id", F.col("hit_5").cast("double").alias("v"))
    return M.bootstrap_interval(r, ["pipeline_name"], "window_id", "v", 100)


def m17_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of reciprocal ranks of two pipelines with its bootstrap interval and p-value."""
    r = _retrieval(spark, sf_dir)
    a = r.filter("pipeline_name = 'bi_encoder_retrieval'").select("window_id", F.col("reciprocal_rank").alias("a"))
    b = r.filter("pipeline_name = 'bm25_retrieval'").select("window_id", F.col("reciprocal_rank").alias("b"))
    return M.paired_bootstrap(a.join(b, "window_id"), "window_id", "a", "b", 100)


def m18_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of pipelines: windows that only one of them hits among its top five, and the false discovery rate of the difference (normal approximation of the sign test)."""
    r = _retrieval(spark, sf_dir).select("window_id", "pipeline_name", "hit_5")
    a, b = r.toDF("window_id", "a", "ha"), r.toDF("window_id", "b", "hb")
    n = a.join(b, "window_id").filter("a < b").groupBy("a", "b").agg(F.count_if(F.expr("ha and not hb")).alias("only_a"), F.count_if(F.expr("hb and not ha")).alias("only_b"))
    d, m = F.abs(F.col("only_a") - F.col("only_b")), F.col("only_a") + F.col("only_b")
    # Logistic approximation of the normal tail, the same in any engine.
    z = F.when(m > 0, d / F.sqrt(m)).otherwise(0.0)
    p = F.round(F.least(F.lit(1.0), 2 / (1 + F.exp(1.702 * z))), 9)
    q = M.benjamini_hochberg(n.withColumn("p_value", p), "p_value", ["a", "b"])
    return q.select(F.col("a").alias("pipeline_a"), F.col("b").alias("pipeline_b"), "only_a", "only_b", F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"))


def m20_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families whose share of ticket-worthy windows differs from the whole, by q-value."""
    s = scored(spark, sf_dir).filter("family is not null")
    whole = s.agg(F.avg(F.col("y").cast("double")).alias("p0"))
    f = s.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("y")).alias("k")).crossJoin(F.broadcast(whole))
    z = F.abs(F.col("k") - F.col("n") * F.col("p0")) / F.sqrt(F.col("n") * F.col("p0") * (1 - F.col("p0")))
    f = f.withColumn("p_value", F.round(F.least(F.lit(1.0), 2 / (1 + F.exp(1.702 * z))), 9))
    return M.benjamini_hochberg(f, "p_value", ["family"]).select("family", "n", "k", F.round("q_value", 6).alias("q_value"))


def m22_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of pipelines along several axes at once (manual grouping sets as one aggregation)."""
    w = V.windows(spark, sf_dir).select("window_id", "service", "window_type", F.col("is_hard_case").cast("string").alias("hard"), F.coalesce("family", F.lit("<null>")).alias("family"))
    r = _retrieval(spark, sf_dir).join(w, "window_id")
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), (F.col(c) if c else F.lit("all")).alias("value")) for a, c in (("overall", None), ("phase", "window_type"), ("hard", "hard"), ("family", "family"))]))
    return r.withColumn("x", axes).groupBy("pipeline_name", "x.axis", "x.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit_5").cast("double")), 6).alias("hit_5"))


def m23_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area in each family held out and their mean; families with one class are left out (family null: the mean)."""
    s = scored(spark, sf_dir).filter("family is not null")
    a = M.curve_areas(M.score_counts(s, ["family"], "score", F.col("y")), ["family"], "score").filter("n_pos > 0 and n_neg > 0")
    rows = a.select("family", "roc_auc")
    return rows.unionByName(rows.agg(F.lit(None).cast("string").alias("family"), F.round(F.avg("roc_auc"), 6).alias("roc_auc")))


def m25_depth_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates by how many gold tickets a window has."""
    n = F.col("n_gold")
    bucket = F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 20, "6-20").otherwise("21+")
    r = _retrieval(spark, sf_dir)
    return r.groupBy("pipeline_name", bucket.alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit_1").cast("double")), 6).alias("hit_1"), F.round(F.avg(F.col("hit_5").cast("double")), 6).alias("hit_5"))


def m26_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate among the top five when each place turns into a distractor with probability 0, 10, 25 and 50 % (hashed draws)."""
    r = V.ranked(spark, sf_dir, 5).filter("pipeline_name = 'hybrid_rrf'").select("window_id", "issue_id", "rank_no")
    gold = gold_found(spark, sf_dir, r).select("window_id", "issue_id", F.lit(1).alias("hit"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "window_id", F.col("rank_no").cast("string"))), 1, 6), 16, 10).cast("bigint")
    rows = r.join(gold, ["window_id", "issue_id"], "left").withColumn("u", u).withColumn("percent", F.explode(F.array(*[F.lit(x) for x in (0, 10, 25, 50)])))
    kept = rows.groupBy("percent", "window_id").agg(F.max(F.when((F.col("u") * 100 >= F.col("percent") * (1 << 24)) & (F.col("hit") == 1), 1).otherwise(0)).alias("h"))
    return kept.groupBy("percent").agg(F.count(F.lit(1)).alias("n"), F.sum("h").cast("bigint").alias("hits"))


def m27_agent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against labels in one row per phase: accuracy, novelty, incidents, first tickets."""
    w = V.windows(spark, sf_dir).select("window_id", "label")
    s = V.states(spark, sf_dir).join(w, "window_id")
    return s.groupBy("window_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == F.col("label")).alias("agreed"), F.count_if(F.expr("is_novel")).alias("novel"), F.count_distinct("incident_id").alias("incidents"), F.count("top1_match").alias("matched"))


_F = (m1_curves, m4_operating_points, m6_confusion, m7_reliability, m7_calibration, m9_retrieval, m11_novelty, m12_novelty_signals, m13_orphan_gap, m14_pages, m16_interval, m17_paired, m18_all_pairs, m20_false_discovery, m22_strata, m23_leave_one_out, m25_depth_curves, m26_distractors, m27_agent_report)
QUERIES = {f.__name__: f for f in _F}

_SC = f"{V.WINDOWS}, sc as (select window_id, source, family, service, window_type, is_hard_case, least(floor(coalesce({V.FEATURES[0]}, 0.0) / 10.0), 1000) / 1000.0::double as score, label = 'ticket_worthy' as y from w where label is not null)"


def _areas(key: str) -> str:
    return f"""c as (select {key}, score, sum(case when y then 1 else 0 end) as pos, sum(case when y then 0 else 1 end) as neg from sc group by 1, 2),
t as (select *, sum(pos) over (partition by {key}) as P_, sum(neg) over (partition by {key}) as N_, sum(pos) over d as tp, sum(neg) over d as fp from c window d as (partition by {key} order by score desc rows unbounded preceding)),
l as (select *, tp / (tp + fp) as p, case when P_ > 0 then tp / P_ else 0.0 end as r from t),
m as (select *, coalesce(lag(p) over o, 1.0) as p0, coalesce(lag(r) over o, 0.0) as r0 from l window o as (partition by {key} order by score desc)),
ar as (select {key}, cast(max(P_) as bigint) as n_pos, cast(max(N_) as bigint) as n_neg, round(sum(p * (r - r0)), 6) as pr_auc, round(sum((p + p0) / 2 * (r - r0)), 6) as pr_auc_trapezoid,
  round(coalesce(sum(pos * (N_ - fp + neg / 2)) / nullif(max(P_) * max(N_), 0), 0.0), 6) as roc_auc from m group by 1)"""


def _confusion(key: str, source: str, p: str, y: str, b2: float) -> str:
    k = f"{key}, " if key else ""
    g = " group by 1" if key else ""
    return f"""cf as (select {k}count(*) filter ({p} and {y}) as tp, count(*) filter ({p} and not {y}) as fp, count(*) filter (not {p} and {y}) as fn, count(*) filter (not {p} and not {y}) as tn from {source}{g}),
cr as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as pr, coalesce(tp / nullif(tp + fn, 0), 0.0) as re, coalesce(fp / nullif(fp + tn, 0), 0.0) as fr from cf)
select {k}tp, fp, fn, tn, round(pr, 6) as precision, round(re, 6) as recall, round(fr, 6) as fpr, round(coalesce((1 + {b2}) * pr * re / nullif({b2} * pr + re, 0), 0.0), 6) as f_beta from cr"""


_RT = f"""{V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED},
gq as (select distinct window_id, ticket_id as issue_id from g where window_id in (select window_id from hits)), ng as (select window_id, count(*) as n_gold from gq group by 1),
fd as (select pipeline_name, window_id, count(*) filter (rank_no <= 1) as h1, count(*) filter (rank_no <= 3) as h3, count(*) filter (rank_no <= 5) as h5, min(rank_no) as first, sum(case when rank_no <= 3 then 1 / log2(rank_no + 1) end) as dcg from r join gq using (window_id, issue_id) group by 1, 2),
rq as (select pipeline_name, window_id, n_gold, coalesce(h1, 0) > 0 as hit_1, coalesce(h3, 0) > 0 as hit_3, coalesce(h5, 0) > 0 as hit_5, coalesce(h1, 0) / n_gold as recall_1, coalesce(h5, 0) / n_gold as recall_5, coalesce(1 / first, 0.0) as reciprocal_rank,
  coalesce(dcg, 0.0) / (1 + case when n_gold >= 2 then 1 / log2(3.0) else 0 end + case when n_gold >= 3 then 1 / log2(4.0) else 0 end) as ndcg_3 from ng cross join (select distinct pipeline_name from r) left join fd using (pipeline_name, window_id))"""
_W8 = " + ".join(f"case when u >= {x} then 1 else 0 end" for x in M.POISSON)


def _draws(key: str, n: int, source: str) -> str:
    return f"(select *, {_W8} as weight from (select s.*, i as replicate, ('0x' || substring(md5('b|' || (i // 4) || '|' || {key}), cast((i % 4) * 8 + 1 as integer), 8))::bigint as u from {source} s, range({n}) t(i)))"


_TAIL = "round(least(1.0, 2 / (1 + exp(1.702 * z))), 9)"
_BH = "min(x) over ({part}order by p_value, {keys} rows between current row and unbounded following)"

SQL = {
    "m1_curves": f"with {_SC}, {_areas('source')} select * from ar",
    "m4_operating_points": f"with {_SC}, {_areas('source')}, q as (select source, max_fpr, arg_min(struct_pack(score, tp, fp, P_), score) as x from m, (values (0.01::double), (0.05::double)) v(max_fpr) where P_ > 0 and N_ > 0 and fp <= N_ * max_fpr group by 1, 2) select source, max_fpr, x.score as threshold, round(x.tp / (x.tp + x.fp), 6) as precision_at, round(x.tp / x.P_, 6) as recall_at from q",
    "m6_confusion": f"with {_SC}, {_confusion('window_type', 'sc', '(score >= 0.05)', 'y', 4.0)}",
    "m7_reliability": f"with {_SC} select cast(least(floor(score * 10), 9) as integer) as bin, count(*) as n, round(avg(score), 6) as confidence, round(avg(case when y then 1 else 0 end), 6) as accuracy from sc group by 1",
    "m7_calibration": f"with {_SC}, b as (select source, least(floor(score * 10), 9) as bin, count(*) as n, avg(score) as c, avg(case when y then 1 else 0 end) as a from sc group by 1, 2) select source, round(sum(n * abs(c - a)) / sum(n), 6) as ece from b group by 1",
    "m9_retrieval": f"with {_RT} select pipeline_name, count(*) as n_windows, " + ", ".join(f"round(avg(cast({c} as double)), 6) as {c}" for c in ("hit_1", "hit_3", "hit_5", "recall_1", "recall_5", "reciprocal_rank", "ndcg_3")) + " from rq group by 1",
    "m11_novelty": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.STATES}, x as (select s.is_novel as p, w.window_id not in (select window_id from g) as y from w join s using (window_id) where w.label = 'ticket_worthy' and s.decision = 'ticket_worthy' and s.is_novel is not null), {_confusion('', 'x', 'p', 'y', 1.0)}",
    "m12_novelty_signals": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.STATES}, {V.RANKED}, x as (select coalesce(w.family, '<null>') as family, r.score is null as a, r.score is null or r.score < 0.5 as b, r.score is null or r.score < 0.5 or coalesce(s.is_novel, false) as c from w left join r on w.window_id = r.window_id and r.pipeline_name = 'bi_encoder_retrieval' and r.rank_no = 1 left join s on w.window_id = s.window_id where label = 'ticket_worthy' and w.window_id not in (select window_id from g)) select family, count(*) as n_novel, count(*) filter (a) as no_hits, count(*) filter (b) as or_weak, count(*) filter (c) as or_decided from x group by rollup (family)",
    "m13_orphan_gap": f"with {_RT}, {V.STATES} select pipeline_name, expected_in_memory, count(*) as n, round(avg(cast(hit_5 as double)), 6) as hit_5 from rq join s using (window_id) where expected_in_memory is not null group by 1, 2",
    "m14_pages": f"with {V.STATES} select window_type, count(*) filter (decision in ('ticket_worthy', 'needs_review')) as pages, count(distinct incident_id) as incidents, round(count(*) filter (decision in ('ticket_worthy', 'needs_review')) / nullif(count(distinct incident_id), 0), 6) as pages_per_incident from s group by 1",
    "m16_interval": f"with {_RT}, v as (select pipeline_name, window_id, cast(hit_5 as double) as v from rq), bw as {_draws('window_id', 100, 'v')}, bm as (select pipeline_name, replicate, round(sum(weight * v) / sum(weight), 9) as m from bw where weight > 0 group by 1, 2), bl as (select pipeline_name, list(m order by m) as ms from bm group by 1), pt as (select pipeline_name, avg(v) as mean from v group by 1) select pipeline_name, round(mean, 6) as mean, round(ms[cast(floor(len(ms) * 0.025) as integer) + 1], 6) as low, round(ms[cast(least(floor(len(ms) * 0.975), len(ms) - 1) as integer) + 1], 6) as high from pt join bl using (pipeline_name)",
    "m17_paired": f"with {_RT}, v as (select a.window_id, a.reciprocal_rank - b.reciprocal_rank as d from rq a join rq b using (window_id) where a.pipeline_name = 'bi_encoder_retrieval' and b.pipeline_name = 'bm25_retrieval'), bw as {_draws('window_id', 100, 'v')}, bm as (select replicate, round(sum(weight * d) / sum(weight), 9) as m from bw where weight > 0 group by 1), bl as (select list(m order by m) as ms, count(*) as n, sum(case when m < 0 then 1.0 when m = 0 then 0.5 else 0.0 end) as below from bm) select (select round(avg(d), 6) from v) as delta, round(ms[cast(floor(n * 0.025) as integer) + 1], 6) as low, round(ms[cast(least(floor(n * 0.975), n - 1) as integer) + 1], 6) as high, round(least(1.0, 2 * least(below / n, 1 - below / n)), 6) as p_value from bl",
    "m18_all_pairs": f"with {_RT}, n as (select a.pipeline_name as a, b.pipeline_name as b, count(*) filter (a.hit_5 and not b.hit_5) as only_a, count(*) filter (b.hit_5 and not a.hit_5) as only_b from rq a join rq b using (window_id) where a.pipeline_name < b.pipeline_name group by 1, 2), z as (select *, case when only_a + only_b > 0 then abs(only_a - only_b) / sqrt(only_a + only_b) else 0.0 end as z from n), p as (select *, {_TAIL} as p_value from z), x as (select *, least(1.0, p_value * count(*) over () / row_number() over (order by p_value, a, b)) as x from p) select a as pipeline_a, b as pipeline_b, only_a, only_b, round(p_value, 6) as p_value, round({_BH.format(part='', keys='a, b')}, 6) as q_value from x",
    "m20_false_discovery": f"with {_SC}, f as (select family, count(*) as n, count(*) filter (y) as k, (select avg(case when y then 1.0::double else 0.0 end) from sc where family is not null) as p0 from sc where family is not null group by 1), z as (select *, abs(k - n * p0) / sqrt(n * p0 * (1 - p0)) as z from f), p as (select *, {_TAIL} as p_value from z), x as (select *, least(1.0, p_value * count(*) over () / row_number() over (order by p_value, family)) as x from p) select family, n, k, round({_BH.format(part='', keys='family')}, 6) as q_value from x",
    "m22_strata": f"with {_RT}, a as (select r.pipeline_name, r.hit_5, w.window_type, cast(w.is_hard_case as varchar) as hard, coalesce(w.family, '<null>') as family from rq r join w using (window_id)), e as (select pipeline_name, hit_5, 'overall' as axis, 'all' as value from a union all select pipeline_name, hit_5, 'phase', window_type from a union all select pipeline_name, hit_5, 'hard', hard from a union all select pipeline_name, hit_5, 'family', family from a) select pipeline_name, axis, value, count(*) as n, round(avg(cast(hit_5 as double)), 6) as hit_5 from e group by 1, 2, 3",
    "m23_leave_one_out": f"with {V.WINDOWS}, sc as (select family, least(floor(coalesce({V.FEATURES[0]}, 0.0) / 10.0), 1000) / 1000.0::double as score, label = 'ticket_worthy' as y from w where label is not null and family is not null), {_areas('family')}, k as (select family, roc_auc from ar where n_pos > 0 and n_neg > 0) select * from k union all select null, round(avg(roc_auc), 6) from k",
    "m25_depth_curves": f"with {_RT} select pipeline_name, case when n_gold <= 2 then '1-2' when n_gold <= 5 then '3-5' when n_gold <= 20 then '6-20' else '21+' end as depth, count(*) as n, round(avg(cast(hit_1 as double)), 6) as hit_1, round(avg(cast(hit_5 as double)), 6) as hit_5 from rq group by 1, 2",
    "m26_distractors": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED}, x as (select r.window_id, ('0x' || left(md5(r.window_id || '|' || rank_no), 6))::bigint as u, g.ticket_id is not null as hit from r left join g on r.window_id = g.window_id and r.issue_id = g.ticket_id where pipeline_name = 'hybrid_rrf' and rank_no <= 5), kk as (select percent, window_id, max(case when u * 100 >= percent * 16777216 and hit then 1 else 0 end) as h from x, (values (0), (10), (25), (50)) v(percent) group by 1, 2) select percent, count(*) as n, cast(sum(h) as bigint) as hits from kk group by 1",
    "m27_agent_report": f"with {V.WINDOWS}, {V.STATES} select s.window_type, count(*) as n, count(*) filter (decision = label) as agreed, count(*) filter (is_novel) as novel, count(distinct incident_id) as incidents, count(top1_match) as matched from s join w using (window_id) group by 1",
}
