"""Further queries: grids and sweeps, operating points, candidate pairs, masks, fallbacks, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import metrics as M
from tidemark.operators import rank as R
from tidemark.operators import state as S
from tidemark.operators.relations import gold_pairs, top_rows
from tidemark.plans import compositions as C
from tidemark.plans import evaluation as E
from tidemark.plans import supplement as U
from tidemark.plans import telemetry as P
from tidemark.plans import views as V
from tidemark.plans.joins import p1_manifest_split
from tidemark.plans.text import _HASH
from tidemark.tables import table

METRICS = ("hit_1", "hit_3", "hit_5", "reciprocal_rank", "ndcg_3")
#: Order in which a list takes the anchor's part where the lists before it are missing.
ANCHORS = ("cross_encoder", "hybrid_rrf", "bi_encoder_retrieval", "bm25_retrieval", "kg_retrieval")
BUDGETS = (50, 100, 200, 400, 800)
PHASES = ("pre_fault_baseline", "active_fault", "recovery_window", "observation_window")
#: Bucket names of decisions by the start of a label.
BUCKET_LABELS = (("ticket", "positive"), ("border", "uncertain"), ("noise", "negative"))
#: Symptom phrases by family; the last one is the default.
PHRASES = (("cache-stampede", "requests to {service} pile up on a cold cache"), ("memory-pressure", "{service} is short of memory"), ("dns-resolution-loss", "{service} cannot resolve names"), ("config-drift", "{service} runs with a changed configuration"))
DEFAULT_PHRASE = "{service} behaves unusually"


def m5_fallback_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest threshold with at most 1 % false positives by phase; just above the greatest score where no score qualifies."""
    c = M.score_counts(E.scored(spark, sf_dir), ["window_type"], "score", F.col("y"))
    top = c.groupBy("window_type").agg(F.max("score").alias("most"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p > 0 and n > 0")
    at = M.operating_point(c, ["window_type"], "score", 0.01)
    return top.join(at, "window_type", "left").select("window_type", F.round(F.coalesce("threshold", F.col("most") + 1e-9), 9).alias("threshold"), F.col("threshold").isNull().alias("is_fallback"))


def m18_five_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of every pair of pipelines on five metrics: difference, interval, two-sided p-value."""
    r = E._retrieval(spark, sf_dir)
    long = r.select("window_id", "pipeline_name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS])).alias("x")).select("window_id", "pipeline_name", "x.metric", "x.v")
    a = long.select("window_id", "metric", F.col("pipeline_name").alias("pipeline_a"), F.col("v").alias("va"))
    b = long.select("window_id", "metric", F.col("pipeline_name").alias("pipeline_b"), F.col("v").alias("vb"))
    d = a.join(b, ["window_id", "metric"]).filter("pipeline_a < pipeline_b").withColumn("d", F.col("va") - F.col("vb"))
    return M.paired_by_group(d, ["pipeline_a", "pipeline_b", "metric"], "window_id", "d", 100, "p")


def z34_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, calibration and the point at 5 % false positives by family; zeros for families with one class."""
    s = E.scored(spark, sf_dir).filter("family is not null")
    c = M.score_counts(s, ["family"], "score", F.col("y"))
    a = M.curve_areas(c, ["family"], "score")
    e = M.calibration_error(M.reliability(s, ["family"], "score", F.col("y")), ["family"])
    o = M.operating_point(c, ["family"], "score", 0.05)
    one = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    zero = lambda x: F.round(F.when(one, 0.0).otherwise(F.coalesce(x, F.lit(0.0))), 6)
    p, r = F.coalesce("precision_at", F.lit(0.0)), F.coalesce("recall_at", F.lit(0.0))
    f = lambda b2: F.when(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0)
    j = a.join(e, "family").join(o, "family", "left")
    return j.select("family", "n_pos", "n_neg", zero(F.col("pr_auc")).alias("pr_auc"), zero(F.col("roc_auc")).alias("roc_auc"), zero(F.col("ece")).alias("ece"), zero(f(1.0)).alias("f1"), zero(f(4.0)).alias("f2"))


def z41_resolved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of each window: the manifest's, else its own (that of its family by hash; train without one)."""
    own = V.windows(spark, sf_dir).select("window_id", F.coalesce(T.family_split(F.col("family")), F.lit("train")).alias("own"))
    s = p1_manifest_split(spark, sf_dir).filter("split <> '__unassigned__'").distinct()
    return own.join(s, "window_id", "left").select("window_id", F.coalesce("split", "own").alias("split"), F.col("split").isNull().alias("is_own"))


def x11_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate of the fused top five with each pipeline left out in turn, and with none: one pass over a grid."""
    r = V.ranked(spark, sf_dir)
    grid = F.explode(F.array(*[F.lit(x) for x in ("none", *ANCHORS)]))
    f = R.rrf(r.withColumn("left_out", grid).filter("pipeline_name <> left_out"), ["left_out", "window_id"], "issue_id", "pipeline_name", "rank_no").withColumn("score", F.round("score", 9))
    top = top_rows(f, ["left_out", "window_id"], [F.col("score").desc(), F.col("issue_id").asc()], 5)
    hit = E.gold_found(spark, sf_dir, top).select("left_out", "window_id").distinct().groupBy("left_out").agg(F.count(F.lit(1)).alias("hits"))
    asked = r.select("window_id").distinct().join(E.gold_numbers(spark, sf_dir), "window_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return hit.crossJoin(F.broadcast(asked)).select("left_out", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("hit_5"))


def x12_budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused tickets read in rank order under several word budgets: tickets read, windows that broke the budget, gold read."""
    from pyspark.sql import Window

    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), F.size(T.words_a(F.concat_ws(" ", "root_cause", "fix"))).alias("cost"))
    r = V.ranked(spark, sf_dir).filter("pipeline_name = 'hybrid_rrf'").join(k, "issue_id")
    gold = E.gold_found(spark, sf_dir, r.select("window_id", "issue_id")).withColumn("g", F.lit(1))
    upto = F.sum("cost").over(Window.partitionBy("window_id").orderBy("rank_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = r.withColumn("upto", upto).join(gold, ["window_id", "issue_id"], "left").withColumn("budget", F.explode(F.array(*[F.lit(x) for x in BUDGETS]))).filter("upto - cost < budget")
    w = rows.groupBy("budget", "window_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("upto") > F.col("budget")).cast("int")).alias("broke"), F.count("g").alias("g"))
    return w.groupBy("budget").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_read"), F.sum("broke").alias("n_broke"), F.sum("g").alias("n_gold"))


def z15_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to train a reranker: every retrieved gold ticket, and up to three wrong lexical ones that were there before the window."""
    w, k = V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir)
    r = V.ranked(spark, sf_dir)
    good = gold_pairs(r.select("window_id", "issue_id").distinct(), w, k)
    seen = r.filter("pipeline_name = 'bm25_retrieval'").join(w.select("window_id", "start_us"), "window_id").join(k.select(F.col("ticket_id").alias("issue_id"), "ts_us"), "issue_id").filter("ts_us < start_us")
    wrong = seen.join(good.select("window_id").distinct(), "window_id", "left_semi").join(good, ["window_id", "issue_id"], "left_anti")
    bad = top_rows(wrong.select("window_id", "issue_id", "rank_no"), ["window_id"], [F.col("rank_no").asc()], 3, "k")
    return good.select("window_id", "issue_id", F.lit(1).alias("label")).unionByName(bad.select("window_id", "issue_id", F.lit(0).alias("label")))


def r5_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of every window: by BM25 of its error lines where it has any, else of its whole evidence."""
    lines = F.array_join(F.filter(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x: x.startswith("log: ")), "\n")
    x = C.candidate_scores(spark, sf_dir, [F.col("t"), lines], by_signature=lines != "").filter("score_0 is not null")
    s = x.withColumn("score", F.when(F.col("by_signature"), F.coalesce("score_1", F.lit(0.0))).otherwise(F.col("score_0")))
    return top_rows(s, ["window_id"], [F.col("score").desc(), F.col("ticket_id").asc()], 1).select("window_id", "ticket_id", "score", "by_signature")


def r16_agent_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ticket of every window: of the anchor's top three the one with most votes (3, 2, 1) of the other lists, ties by the anchor; the anchor is the first list present."""
    r = V.ranked(spark, sf_dir).filter("rank_no <= 3")
    place = F.array_position(F.array(*[F.lit(x) for x in ANCHORS]), F.col("pipeline_name"))
    first = r.groupBy("window_id").agg(F.min_by("pipeline_name", place).alias("anchor"))
    j = r.join(first, "window_id")
    votes = j.filter("pipeline_name <> anchor").groupBy("window_id", "issue_id").agg(F.sum(4 - F.col("rank_no")).alias("votes"))
    a = j.filter("pipeline_name = anchor").join(votes, ["window_id", "issue_id"], "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("bigint")))
    return top_rows(a, ["window_id"], [F.col("votes").desc(), F.col("rank_no").asc()], 1, "k").select("window_id", "anchor", "issue_id", "votes")


def p20_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence without lines about traces or the cluster."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t")).filter("t is not null")
    kept = F.filter(F.split("t", "\n"), lambda x: ~U._any(F.lower(x), U.TRACE_WORDS) & ~U._any(F.lower(x), U.CLUSTER_WORDS))
    return w.select("window_id", F.array_join(kept, "\n").alias("text"))


def z24_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct log messages of a window's evidence (240 characters), twelve at most, in their order."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    lines = w.select("window_id", F.posexplode(F.split("t", "\n")).alias("pos", "line")).filter("line like 'log: %'").select("window_id", "pos", F.substring("line", 6, 240).alias("message"))
    first = lines.groupBy("window_id", "message").agg(F.min("pos").alias("pos"))
    return top_rows(first, ["window_id"], [F.col("pos").asc()], 12).select("window_id", "message", "rank_no")


def z29_fallback_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error counts of windows; where all features are null or zero, the number of log lines in the evidence instead."""
    w = V.windows(spark, sf_dir)
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    n = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x: x.startswith("log: ")))
    nothing = F.lit(True)
    for f in V.FEATURES:
        nothing = nothing & (F.coalesce(f, F.lit(0.0)) == 0)
    return w.join(e, "window_id").select("window_id", F.when(nothing, n.cast("double")).otherwise(F.coalesce(V.FEATURES[3], F.lit(0.0))).alias("n_errors"), nothing.alias("is_fallback"))


def z53_family_of_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families told from scenario ids (without the prefix 'sc-' and a number at the end), and how they agree with the stored ones."""
    w = table(spark, sf_dir, "telemetry_windows").filter("scenario_id is not null")
    told = F.nullif(F.regexp_replace(F.regexp_replace("scenario_id", "^sc-", ""), "-[0-9]+$", ""), F.lit("none"))
    stored = F.regexp_replace("scenario_family", "-[0-9]+$", "")
    return w.groupBy(told.alias("told")).agg(F.count(F.lit(1)).alias("n"), F.count_if(stored == told).alias("n_same"), F.count_if(F.col("scenario_family").isNull()).alias("n_filled"))


def z46_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symptom phrase for each window by its family in any case, with its service."""
    phrase = F.lit(DEFAULT_PHRASE)
    for family, text in PHRASES:
        phrase = F.when(F.lower(F.coalesce("family", F.lit(""))) == family, text).otherwise(phrase)
    w = V.windows(spark, sf_dir)
    return w.select("window_id", F.replace(phrase, F.lit("{service}"), F.coalesce("service", F.lit("a service"))).alias("phrase"))


def z39_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipelines that ran for a window, in order, how often they returned something, and whether any returned a broken score."""
    h = table(spark, sf_dir, "hits").filter("window_id is not null")
    bad = F.col("score").isNull() | F.isnan("score") | F.col("issue_id").isNull()
    g = h.groupBy("window_id").agg(F.array_join(F.array_sort(F.collect_set("pipeline_name")), ",").alias("invoked"), F.count(F.lit(1)).alias("n_calls"), F.max(bad).alias("has_error"))
    return g


def a8_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each episode: rise of every feature's mean from baseline to fault, min(1, log10(1 + rise) / 2), and how complete the recovery of latency is (0 to 1)."""
    w = V.windows(spark, sf_dir).filter("episode is not null")
    mean = lambda f, phase: F.coalesce(F.avg(F.when(F.col("window_type") == phase, F.coalesce(f, F.lit(0.0)))), F.lit(0.0))
    e = w.groupBy("episode").agg(*[mean(f, p).alias(f"{p}_{i}") for i, f in enumerate(V.FEATURES) for p in PHASES[:3]])
    rise = lambda i: F.greatest(F.col(f"{PHASES[1]}_{i}") - F.col(f"{PHASES[0]}_{i}"), F.lit(0.0))
    left = F.greatest(F.col(f"{PHASES[2]}_0") - F.col(f"{PHASES[0]}_0"), F.lit(0.0))
    done = F.when(rise(0) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - left / rise(0))))
    return e.select("episode", *[F.round(F.least(F.lit(1.0), F.log10(1 + rise(i)) / 2), 6).alias(f"signal_{i}") for i in range(4)], F.round(done, 6).alias("recovery"))


def a4_own_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a window that concern its own service (its name is in the object's), by reason: how many, each uid once."""
    e = table(spark, sf_dir, "k8s_events").filter("window_id is not null").groupBy("event_uid").agg(F.max("window_id").alias("window_id"), F.max(F.lower(F.btrim("reason"))).alias("reason"), F.max("object_name").alias("o"))
    w = V.windows(spark, sf_dir).filter("service is not null").select("window_id", "service")
    return e.join(w, "window_id").filter(F.contains("o", F.col("service"))).groupBy("window_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def m15_before_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of decisions with labels by phase, where suppressed decisions count as ticket_worthy (what was decided before suppression)."""
    s = V.states(spark, sf_dir).filter("ts_us is not null").select("window_id", "service", "ts_us", "decision", "top1_match", "family", "window_type")
    r = S.suppression(s, "service", ["ts_us", "window_id"], P._block()).select("window_id", "window_type", F.when(F.col("suppressed"), "ticket_worthy").otherwise(F.col("decision")).alias("d"), "suppressed")
    j = r.join(V.windows(spark, sf_dir).select("window_id", "label"), "window_id")
    return j.groupBy("window_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == F.col("label")).alias("n_right"), F.count_if("suppressed").alias("n_suppressed"))


def st6_phase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of each episode as windows of their own: first and last start, windows, label counts."""
    w = V.windows(spark, sf_dir).filter("episode is not null")
    return w.groupBy("episode", "window_type").agg(F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "ticket_worthy").alias("n_worthy"))


def p10_bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels mapped by their start, against the phase."""
    bucket = F.lit("unknown")
    for start, name in BUCKET_LABELS:
        bucket = F.when(F.col("label").startswith(start), name).otherwise(bucket)
    return V.windows(spark, sf_dir).groupBy(bucket.alias("bucket"), "window_type").agg(F.count(F.lit(1)).alias("n"))


def p11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that pass each of three filters (error rate 5 % or less, a log line, evidence of 200 characters), and all of them."""
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    j = V.windows(spark, sf_dir).join(e, "window_id")
    a, b, c = F.coalesce(V.FEATURES[1], F.lit(0.0)) <= 0.05, F.coalesce(F.contains("t", F.lit("log: ")), F.lit(False)), F.coalesce(F.length("t"), F.lit(0)) >= 200
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("n_certain"), F.count_if(b).alias("n_logged"), F.count_if(c).alias("n_long"), F.count_if(a & b & c).alias("n_all"))


def z27_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-run-out folds: the run held out, its windows, its first and last window by id, and the runs left to train on."""
    w = V.windows(spark, sf_dir).filter("run is not null")
    r = w.groupBy("run").agg(F.count(F.lit(1)).alias("n_eval"), F.min("window_id").alias("first_id"), F.max("window_id").alias("last_id"))
    n = r.agg(F.count(F.lit(1)).alias("k"))
    return r.crossJoin(F.broadcast(n)).select("run", "n_eval", "first_id", "last_id", (F.col("k") - 1).alias("n_train_runs"))


def x4_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions looked up for every window: the first ticket of each of three pipelines, null where there is none."""
    w = V.windows(spark, sf_dir).select("window_id")
    r = V.ranked(spark, sf_dir, 1).groupBy("window_id").pivot("pipeline_name", list(ANCHORS[:3])).agg(F.max("issue_id"))
    return w.join(r, "window_id", "left")


_F = (m5_fallback_thresholds, m18_five_metrics, z34_bundle, z41_resolved_split, x11_ablation, x12_budget_sweep, z15_training_pairs, r5_signature, r16_agent_cascade, p20_masked, z24_messages, z29_fallback_features, z53_family_of_scenario, z46_phrases, z39_traces, a8_recovery, a4_own_events, m15_before_suppression, st6_phase_windows, p10_bucket_labels, p11_quality, z27_folds, x4_looked_up)
QUERIES = {f.__name__: f for f in _F}

_EV = "ev as (select window_id, max(triage_evidence_text) as t from telemetry_windows group by 1)"
_WG = f"{V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED}"
_LOGS = "list_filter(string_split(coalesce(t, ''), chr(10)), lambda x: starts_with(x, 'log: '))"
_ANCHOR = f"list_position([{', '.join(repr(x) for x in ANCHORS)}], pipeline_name)"
_ZERO = " and ".join(f"coalesce({f}, 0.0) = 0" for f in V.FEATURES)


def _mean(f: str, phase: str) -> str:
    return f"coalesce(avg(coalesce({f}, 0.0)) filter (window_type = '{phase}'), 0.0)"


_MEANS = ", ".join(f"{_mean(f, p)} as {q}{i}" for i, f in enumerate(V.FEATURES) for p, q in zip(PHASES[:3], "bar", strict=True))
_P5 = ", ".join(f"('{m}')" for m in METRICS)
_V5 = "case metric " + " ".join(f"when '{m}' then cast({{t}}.{m} as double)" for m in METRICS) + " end"

SQL = {
    "m5_fallback_thresholds": f"with {E._SC}, {E._areas('window_type')}, q as (select window_type, min(score) as s from m where fp <= N_ * 0.01 group by 1) select t.window_type, round(coalesce(s, most + 1e-9), 9) as threshold, s is null as is_fallback from (select window_type, max(score) as most from m where P_ > 0 and N_ > 0 group by 1) t left join q using (window_type)",
    "m18_five_metrics": f"with {E._RT}, v as (select a.window_id, a.pipeline_name as pipeline_a, b.pipeline_name as pipeline_b, metric, {_V5.format(t='a')} - {_V5.format(t='b')} as d from rq a join rq b using (window_id), (values {_P5}) x(metric) where a.pipeline_name < b.pipeline_name), bw as {E._draws('window_id', 100, 'v').replace(chr(39) + 'b|', chr(39) + 'p|')}, bm as (select pipeline_a, pipeline_b, metric, replicate, round(sum(weight * d) / sum(weight), 9) as m from bw where weight > 0 group by 1, 2, 3, 4), bl as (select pipeline_a, pipeline_b, metric, list(m order by m) as ms, count(*) as n, sum(case when m < 0 then 1.0 when m = 0 then 0.5 else 0.0 end) as below from bm group by 1, 2, 3), pt as (select pipeline_a, pipeline_b, metric, round(avg(d), 6) as delta from v group by 1, 2, 3) select pipeline_a, pipeline_b, metric, delta, round(ms[cast(floor(n * 0.025) as integer) + 1], 6) as low, round(ms[cast(least(floor(n * 0.975), n - 1) as integer) + 1], 6) as high, round(least(1.0, 2 * least(below / n, 1 - below / n)), 6) as p_value from pt join bl using (pipeline_a, pipeline_b, metric)",
    "z34_bundle": f"with {V.WINDOWS}, sc as (select family, least(floor(coalesce({V.FEATURES[0]}, 0.0) / 10.0), 1000) / 1000.0::double as score, label = 'ticket_worthy' as y from w where label is not null and family is not null), {E._areas('family')}, rb as (select family, least(floor(score * 10), 9) as bin, count(*) as n, avg(score) as c, avg(case when y then 1 else 0 end) as a from sc group by 1, 2), ec as (select family, round(sum(n * abs(c - a)) / sum(n), 6) as ece from rb group by 1), q as (select family, arg_min(struct_pack(tp, fp, P_), score) as x from m where P_ > 0 and N_ > 0 and fp <= N_ * 0.05 group by 1), o as (select family, round(x.tp / (x.tp + x.fp), 6) as p, round(x.tp / x.P_, 6) as r from q), j as (select ar.*, ece, coalesce(p, 0.0) as p, coalesce(r, 0.0) as r, n_pos = 0 or n_neg = 0 as one from ar join ec using (family) left join o using (family)) select family, n_pos, n_neg, case when one then 0.0 else pr_auc end as pr_auc, case when one then 0.0 else roc_auc end as roc_auc, case when one then 0.0 else ece end as ece, case when one or p + r = 0 then 0.0 else round(2 * p * r / (p + r), 6) end as f1, case when one or 4 * p + r = 0 then 0.0 else round(5 * p * r / (4 * p + r), 6) end as f2 from j",
    "z41_resolved_split": f"with {V.WINDOWS}, {U._MS}, h as (select distinct scenario_family, {_HASH} as b from telemetry_windows where scenario_family is not null) select w.window_id, coalesce(split, case when b <= 1 then 'test' when b <= 3 then 'validation' else 'train' end) as split, split is null as is_own from w left join (select * from ms where split is not null) ms on w.window_id = ms.window_id left join h on w.family = h.scenario_family",
    "x11_ablation": f"with {_WG}, x as (select left_out, window_id, issue_id, round(sum(1.0::double / (60 + rank_no)), 9) as score from r, (values ('none'), {', '.join(f'({a!r})' for a in ANCHORS)}) l(left_out) where pipeline_name <> left_out group by 1, 2, 3), t as (select * from x qualify row_number() over (partition by left_out, window_id order by score desc, issue_id) <= 5), n as (select count(distinct window_id) as n from r where window_id in (select window_id from g)) select left_out, count(distinct t.window_id) as hits, (select n from n) as n, round(count(distinct t.window_id) / (select n from n), 6) as hit_5 from t join g on t.window_id = g.window_id and t.issue_id = g.ticket_id group by 1",
    "x12_budget_sweep": f"with {_WG}, c as (select r.window_id, issue_id, rank_no, len(list_filter(regexp_extract_all(lower(concat_ws(' ', root_cause, fix)), '[a-z0-9]+'), lambda x: length(x) >= 2)) as cost from r join k on issue_id = ticket_id where pipeline_name = 'hybrid_rrf'), u as (select c.*, sum(cost) over (partition by c.window_id order by rank_no rows unbounded preceding) as upto, g.ticket_id is not null as hit from c left join g on c.window_id = g.window_id and c.issue_id = g.ticket_id), w2 as (select budget, window_id, count(*) as n, max(case when upto > budget then 1 else 0 end) as broke, count(*) filter (hit) as g from u, (values {', '.join(f'({b})' for b in BUDGETS)}) b(budget) where upto - cost < budget group by 1, 2) select budget, count(*) as n_windows, cast(sum(n) as bigint) as n_read, cast(sum(broke) as bigint) as n_broke, cast(sum(g) as bigint) as n_gold from w2 group by 1",
    "z15_training_pairs": f"with {_WG}, good as (select distinct r.window_id, issue_id from r join g on r.window_id = g.window_id and issue_id = ticket_id), bad as (select r.window_id, issue_id from r join w using (window_id) join k on issue_id = ticket_id where pipeline_name = 'bm25_retrieval' and ts_us < start_us and r.window_id in (select window_id from good) and (r.window_id, issue_id) not in (select (window_id, issue_id) from good) qualify row_number() over (partition by r.window_id order by rank_no) <= 3) select window_id, issue_id, 1 as label from good union all select window_id, issue_id, 0 from bad",
    "r5_signature": f"with {C.candidate_sql('t', 'l')}, {C.candidate_sql('array_to_string(' + _LOGS + ', chr(10))', 'g', False)}, hs as (select window_id, len({_LOGS}) > 0 as has from l_e), x as (select l_s.window_id, l_s.ticket_id, case when has then coalesce(g_s.score, 0.0) else l_s.score end as score, has as by_signature from l_s join hs using (window_id) left join g_s on l_s.window_id = g_s.window_id and l_s.ticket_id = g_s.ticket_id) select * from x qualify row_number() over (partition by window_id order by score desc, ticket_id) = 1",
    "r16_agent_cascade": f"with {V.RANKED}, a as (select window_id, arg_min(pipeline_name, {_ANCHOR}) as anchor from r where rank_no <= 3 group by 1), v as (select r.window_id, issue_id, sum(4 - rank_no) as votes from r join a using (window_id) where rank_no <= 3 and pipeline_name <> anchor group by 1, 2) select r.window_id, anchor, r.issue_id, cast(coalesce(votes, 0) as bigint) as votes from r join a using (window_id) left join v on r.window_id = v.window_id and r.issue_id = v.issue_id where rank_no <= 3 and pipeline_name = anchor qualify row_number() over (partition by r.window_id order by coalesce(votes, 0) desc, rank_no) = 1",
    "p20_masked": f"with {_EV} select window_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: not ({U._sql_any('lower(x)', U.TRACE_WORDS)}) and not ({U._sql_any('lower(x)', U.CLUSTER_WORDS)})), chr(10)) as text from ev where t is not null",
    "z24_messages": f"with {_EV}, l as (select window_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from ev), f as (select window_id, substring(line, 6, 240) as message, min(pos) as pos from l where line like 'log: %' group by 1, 2) select window_id, message, cast(row_number() over (partition by window_id order by pos) as integer) as rank_no from f qualify rank_no <= 12",
    "z29_fallback_features": f"with {V.WINDOWS}, {_EV} select w.window_id, case when {_ZERO} then cast(len({_LOGS}) as double) else coalesce({V.FEATURES[3]}, 0.0) end as n_errors, {_ZERO} as is_fallback from w join ev using (window_id)",
    "z53_family_of_scenario": "with x as (select nullif(regexp_replace(regexp_replace(scenario_id, '^sc-', ''), '-[0-9]+$', ''), 'none') as told, regexp_replace(scenario_family, '-[0-9]+$', '') as stored from telemetry_windows where scenario_id is not null) select told, count(*) as n, count(*) filter (stored = told) as n_same, count(*) filter (stored is null) as n_filled from x group by 1",
    "z46_phrases": f"with {V.WINDOWS} select window_id, replace(case lower(coalesce(family, '')) " + " ".join(f"when '{k}' then '{p}'" for k, p in PHRASES) + f" else '{DEFAULT_PHRASE}' end, '{{service}}', coalesce(service, 'a service')) as phrase from w",
    "z39_traces": "select window_id, array_to_string(list_sort(list(distinct pipeline_name)), ',') as invoked, count(*) as n_calls, bool_or(score is null or isnan(score) or issue_id is null) as has_error from hits where window_id is not null group by 1",
    "a8_recovery": f"with {V.WINDOWS}, e as (select episode, {_MEANS} from w where episode is not null group by 1) select episode, " + ", ".join(f"round(least(1.0, log10(1 + greatest(a{i} - b{i}, 0.0)) / 2), 6) as signal_{i}" for i in range(4)) + ", round(case when greatest(a0 - b0, 0.0) > 0 then greatest(0.0, least(1.0, 1 - greatest(r0 - b0, 0.0) / greatest(a0 - b0, 0.0))) end, 6) as recovery from e",
    "a4_own_events": f"with {V.WINDOWS}, e as (select event_uid, max(window_id) as window_id, max(lower(trim(reason))) as reason, max(object_name) as o from k8s_events where window_id is not null group by 1) select e.window_id, reason, count(*) as n from e join w using (window_id) where contains(o, service) group by 1, 2",
    "m15_before_suppression": f"with {V.STATES}, {V.WINDOWS}, {P._SUP} select x.window_type, count(*) as n, count(*) filter (case when src is not null then 'ticket_worthy' else decision end = label) as n_right, count(*) filter (src is not null) as n_suppressed from x join w using (window_id) group by 1",
    "st6_phase_windows": f"with {V.WINDOWS} select episode, window_type, min(start_us) as first_us, max(start_us) as last_us, count(*) as n, count(*) filter (label = 'ticket_worthy') as n_worthy from w where episode is not null group by 1, 2",
    "p10_bucket_labels": f"with {V.WINDOWS} select case " + " ".join(f"when label like '{k}%' then '{v}'" for k, v in BUCKET_LABELS) + " else 'unknown' end as bucket, window_type, count(*) as n from w group by 1, 2",
    "p11_quality": f"with {V.WINDOWS}, {_EV}, x as (select source, coalesce({V.FEATURES[1]}, 0.0) <= 0.05 as a, coalesce(contains(t, 'log: '), false) as b, coalesce(length(t), 0) >= 200 as c from w join ev using (window_id)) select source, count(*) as n, count(*) filter (a) as n_certain, count(*) filter (b) as n_logged, count(*) filter (c) as n_long, count(*) filter (a and b and c) as n_all from x group by 1",
    "z27_folds": f"with {V.WINDOWS}, r as (select run, count(*) as n_eval, min(window_id) as first_id, max(window_id) as last_id from w where run is not null group by 1) select *, (select count(*) from r) - 1 as n_train_runs from r",
    "x4_looked_up": f"with {V.WINDOWS}, {V.RANKED}, t as (select window_id, " + ", ".join(f"max(issue_id) filter (pipeline_name = '{a}') as {a}" for a in ANCHORS[:3]) + " from r where rank_no = 1 group by 1) select w.window_id, " + ", ".join(ANCHORS[:3]) + " from w left join t using (window_id)",
}
