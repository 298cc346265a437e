"""Further queries: splits, labels, channels, candidate ranking, text assembly, audits, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import rank as R
from tidemark.operators.asof import latest_rows
from tidemark.operators.relations import top_rows
from tidemark.operators.telemetry import hashed_numbers
from tidemark.plans import evaluation as E
from tidemark.plans import views as V
from tidemark.tables import table

# Words of a scenario by which its family is told, the first that fits.
FAMILY_WORDS = (("baseline", ("baseline",)), ("near_miss", ("nearmiss",)), ("restart", ("restart",)), ("latency", ("latency",)), ("configuration", ("config",)), ("outage_or_degradation", ("unavailable", "degradation", "failure")), ("traffic", ("traffic",)))
# Words that give away how a data set was made.
LEAK_WORDS = ("fault", "injected", "lab", "labonly", "nearmiss", "near-miss", "borderline", "ticket_worthy", "noise_window")
LEAK_PARTS = (
    "scenario-", "scenario_id", "scenario_family", "dataset-", "dataset_run", "fault.injected", "fault_injected", "fault_compatibility", "expected_severity", "expected_in_memory",
    "triage_label", "triage_severity", "triage_components", "triage_reason_class", "is_hard_case", "is_novel", "incident_type", "root_cause_category",
    "synthetic-incident", "synthetic_incident", "telemetry-linked", "telemetry_linked", "chaos-mesh", "chaosmesh", "chaos_mesh", "networkchaos", "dnschaos", "stresschaos", "iochaos", "podchaos",
)
# Words of lines about traces and about the cluster.
TRACE_WORDS = ("traceid", "trace_id", "spanid", "span_id", "span ", "p50", "p95", "p99", "latency_ms", "duration_ms")
CLUSTER_WORDS = ("pod ", "pod_", "kubelet", "deployment", "oom", "crashloopbackoff", "imagepullbackoff", "containerstatuses", "restartcount", "restart count", "unschedulable", "nodename", "back-off restarting")
_PARTS = "|".join(x.replace(".", r"\.") for x in LEAK_PARTS)
# Kinds of fixes, by what a text mentions.
FIXES = (("config_change", ("limit", "timeout", "config", "tune")), ("restart", ("restart", "recycled", "drained")), ("scale_up", ("scale", "doubled", "raised", "replica")), ("rollback", ("rolled back", "rollback", "previous", "revert")))
SEVERITIES = ("none", "minor", "major", "critical")
PROFILES = (("text", 1.0, 0.0, 0.0), ("services", 0.0, 1.0, 0.0), ("severity", 0.0, 0.0, 1.0), ("all", 0.55, 0.30, 0.15))


def _any(c, words):
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _first(c, rules, default):
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(_any(c, words), name).otherwise(out)
    return out


def split_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 % and 15 % of each service, truncated, in a hashed order; the rest is test."""
    r = hashed_numbers(V.windows(spark, sf_dir).filter("service is not null").select("window_id", "service"), ["service"], "window_id", "7")
    a, b = F.expr("of * 70 div 100"), F.expr("of * 15 div 100")
    return r.select("window_id", F.when(F.col("place") <= a, "train").when(F.col("place") <= a + b, "val").otherwise("test").alias("split"))


def split_by_run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each family's runs the last is test, the one before validation where there are three or more."""
    runs = V.windows(spark, sf_dir).filter("family is not null and run is not null and start_us is not null").groupBy("family", "run").agg(F.min("start_us").alias("t"))
    w = Window.partitionBy("family").orderBy(F.col("t").desc(), F.col("run").desc())
    n = F.count(F.lit(1)).over(Window.partitionBy("family"))
    r = runs.withColumn("k", F.row_number().over(w)).withColumn("n", n)
    return r.select("family", "run", F.when(F.col("k") == 1, "test").when((F.col("k") == 2) & (F.col("n") >= 3), "validation").otherwise("train").alias("split"))


def split_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families whose windows lie in more than one split of their manifests."""
    from tidemark.plans.joins import p1_manifest_split

    s = p1_manifest_split(spark, sf_dir).filter("split <> '__unassigned__'").join(V.windows(spark, sf_dir).select("window_id", "family"), "window_id")
    return s.filter("family is not null").groupBy("family").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n")).filter("n_splits > 1")


def label_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as strict and as inclusive classes, counted."""
    w = V.windows(spark, sf_dir)
    return w.groupBy((F.col("label") == "ticket_worthy").alias("strict"), F.col("label").isin("ticket_worthy", "borderline").alias("inclusive")).agg(F.count(F.lit(1)).alias("n"))


def item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of tickets without those of given prefixes or names."""
    k = table(spark, sf_dir, "kg_tickets").dropDuplicates(["ticket_id"])
    c = F.transform(F.coalesce("components", F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x)))
    kept = F.filter(c, lambda x: x.isNotNull() & (x != "") & ~x.startswith("request") & ~x.isin("blob reader", "image cache"))
    return k.select("ticket_id", F.array_join(F.array_sort(F.array_distinct(kept)), "|").alias("components"))


def candidate_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope of the five best lexical candidates: positive, negative of the same family, hard negative of another; by rank."""
    w = V.windows(spark, sf_dir).select("window_id", F.col("family").alias("wf"))
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), F.col("family").alias("kf"))
    top = V.ranked(spark, sf_dir, 5).filter("pipeline_name = 'bm25_retrieval'")
    gold = E.gold_found(spark, sf_dir, top).select("window_id", "issue_id", F.lit(1).alias("hit"))
    r = top.join(w, "window_id").join(k, "issue_id").join(gold, ["window_id", "issue_id"], "left")
    scope = F.when(F.col("hit") == 1, "positive").when(F.col("wf") == F.col("kf"), "same_family_negative").otherwise("hard_negative")
    return r.groupBy("rank_no", scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def overlap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of a window's components with its best graph ticket's: exact, partial or none."""
    a = table(spark, sf_dir, "window_entities").dropDuplicates(["window_id"]).select("window_id", F.col("components").alias("x"))
    b = table(spark, sf_dir, "kg_tickets").dropDuplicates(["ticket_id"]).select(F.col("ticket_id").alias("issue_id"), F.col("components").alias("y"))
    j = V.ranked(spark, sf_dir, 1).filter("pipeline_name = 'kg_retrieval'").join(a, "window_id").join(b, "issue_id")
    s = T.jaccard(F.col("x"), F.col("y"))
    return j.groupBy(F.when(s >= 0.999, "exact").when(s > 0, "partial").otherwise("none").alias("overlap")).agg(F.count(F.lit(1)).alias("n"))


def family_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse family of each stored family by the words it holds, the first that fits."""
    f = table(spark, sf_dir, "window_states").filter("scenario_family is not null").select("scenario_family").distinct()
    return f.select("scenario_family", _first(F.lower("scenario_family"), FAMILY_WORDS, "other").alias("coarse"))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence each window has: text, numbers, entities, retrieved tickets, events; counted by combination."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"), *[F.max(f).alias(f) for f in V.FEATURES])
    e = table(spark, sf_dir, "window_entities").select("window_id").distinct().withColumn("e", F.lit(1))
    h = table(spark, sf_dir, "hits").select("window_id").distinct().withColumn("h", F.lit(1))
    v = table(spark, sf_dir, "k8s_events").select("window_id").filter("window_id is not null").distinct().withColumn("v", F.lit(1))
    j = w.join(e, "window_id", "left").join(h, "window_id", "left").join(v, "window_id", "left")
    flags = F.array_compact(F.array(F.when(F.length("t") >= 8, "text"), F.when(F.coalesce(*V.FEATURES).isNotNull(), "numbers"), F.when(F.col("e") == 1, "entities"), F.when(F.col("h") == 1, "tickets"), F.when(F.col("v") == 1, "events")))
    return j.groupBy(F.array_join(flags, "+").alias("capabilities")).agg(F.count(F.lit(1)).alias("n"))


def channel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines by channel (traces, cluster, others), by phase."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"), F.max("window_type").alias("window_type"))
    s = w.select("window_type", F.explode(F.split("t", "\n")).alias("line")).filter("trim(line) <> ''")
    low = F.lower("line")
    return s.groupBy("window_type").agg(F.count_if(_any(low, TRACE_WORDS)).alias("n_trace"), F.count_if(_any(low, CLUSTER_WORDS)).alias("n_cluster"), F.count_if(~_any(low, TRACE_WORDS) & ~_any(low, CLUSTER_WORDS)).alias("n_other"))


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in evidence that give the data set away: documents and occurrences."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    pattern = "(?i)(?:" + _PARTS + r")|\b(?:" + "|".join(LEAK_WORDS) + r")\b"
    f = w.select("window_id", F.explode(F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(pattern), F.lit(0)), F.lower)).alias("word"))
    return f.groupBy("word").agg(F.count_distinct("window_id").alias("n_windows"), F.count(F.lit(1)).alias("n"))


def leak_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with those words redacted, for windows that hold any."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    out = F.regexp_replace("t", "(?i)(?:" + _PARTS + ")", "<REDACTED>")
    out = F.regexp_replace(out, r"(?i)\b(?:" + "|".join(LEAK_WORDS) + r")\b", "<REDACTED>")
    return w.select("window_id", out.alias("text")).filter("text like '%<REDACTED>%'")


def fix_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of fix by words of the fix text against the recorded kind, counted."""
    k = table(spark, sf_dir, "kg_tickets").dropDuplicates(["ticket_id"])
    return k.groupBy(_first(F.lower(F.coalesce("fix", F.lit(""))), FIXES, "other").alias("told"), F.col("fix_kind").alias("recorded")).agg(F.count(F.lit(1)).alias("n"))


def cause_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentence of a ticket that names a cause: with 'caused', 'turned out', 'traced' or 'failed', else the first."""
    k = V.tickets(spark, sf_dir).select("ticket_id", F.split(F.concat_ws(" ", "root_cause", "fix"), r"\. ").alias("s"))
    named = F.filter("s", lambda x: F.lower(x).rlike("caused|turned out|traced|failed"))
    return k.select("ticket_id", F.coalesce(F.get(named, F.lit(0)), F.get("s", F.lit(0))).alias("sentence"))


def ticket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval text of a ticket: headers, symptoms (three at most, 40 characters each), cause and fix."""
    k = table(spark, sf_dir, "kg_tickets").filter("ticket_id is not null").select("ticket_id", "severity", F.coalesce("symptoms", F.array().cast("array<string>")).alias("s"), "root_cause", "fix").dropDuplicates(["ticket_id"])
    s = F.transform(F.slice(F.filter(F.transform("s", lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != "")), 1, 3), lambda x: F.substring(x, 1, 40))
    return k.select("ticket_id", F.concat_ws("\n", F.concat(F.lit("severity: "), "severity"), F.concat(F.lit("symptoms: "), F.array_join(s, "; ")), F.col("root_cause"), F.col("fix")).alias("text"))


def recut_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows cut again to two minutes around their middle, within a padded range, as nanoseconds."""
    w = V.windows(spark, sf_dir).filter("start_us is not null").select("window_id", (F.col("start_us") * 1000).alias("a"))
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max(F.unix_micros(T.iso_timestamp(F.col("end_time")))).alias("e"))
    r = w.join(e, "window_id").withColumn("b", F.col("e") * 1000).withColumn("m", F.expr("(a + b) div 2"))
    minute = 60 * 10**9
    return r.select("window_id", F.greatest(F.col("m") - minute, F.col("a") - minute).alias("from_ns"), F.least(F.col("m") + minute, F.col("b") + minute).alias("to_ns"))


def diagnosis_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled search time per pipeline: 30 s a place up to the first gold ticket, 1800 s without, nothing without gold."""
    r = V.ranked(spark, sf_dir)
    asked = r.select("window_id", "pipeline_name").distinct().join(E.gold_numbers(spark, sf_dir).select("window_id"), "window_id")
    first = E.gold_found(spark, sf_dir, r).groupBy("window_id", "pipeline_name").agg(F.min("rank_no").alias("r"))
    j = asked.join(first, ["window_id", "pipeline_name"], "left")
    return j.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("r") * 30, F.lit(1800))).cast("bigint").alias("seconds"))


def top_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of each episode with the greatest change from its baseline, worded."""
    from tidemark.operators.relations import baseline_deltas
    from tidemark.operators.telemetry import unpivoted

    w = V.windows(spark, sf_dir).filter("episode is not null")
    d = baseline_deltas(w, ["episode", "service"], ["start_us", "window_id"], F.col("window_type") == "pre_fault_baseline", V.FEATURES)
    u = unpivoted(d, ["episode"], [f"{f}_delta" for f in V.FEATURES])
    m = u.groupBy("episode", "feature").agg(F.max_by("value", F.struct(F.abs("value"), "value")).alias("v")).filter("v <> 0")
    r = top_rows(m, ["episode"], [F.abs("v").desc(), F.col("feature").asc()], 2)
    name = F.regexp_replace(F.regexp_replace("feature", "^triage_feature_", ""), "_delta$", "")
    return r.select("episode", "rank_no", F.concat_ws(" ", name, F.when(F.col("v") > 0, "rose").otherwise("fell")).alias("phrase"))


def hashed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persona, a number of comments and a resolution time for each ticket, from hashes."""
    k = V.tickets(spark, sf_dir).select("ticket_id")
    u = lambda seed, n: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "ticket_id"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    who = F.element_at(F.array(*[F.lit(x) for x in ("operator", "developer", "lead", "support")]), (u("persona", 4) + 1).cast("int"))
    return k.select("ticket_id", who.alias("persona"), (u("comments", 4) + 1).alias("n_comments"), (u("minutes", 170) + 10).alias("minutes"))


def miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the first lexical ticket of a window with gold is wrong: late gold, other family, other service, order."""
    from tidemark.plans.ranking import r36_top_misses

    m = r36_top_misses(spark, sf_dir)
    w = V.windows(spark, sf_dir).select("window_id", F.col("family").alias("wf"), F.col("service").alias("ws"))
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("top_ticket"), F.col("family").alias("kf"), "services")
    j = m.join(w, "window_id").join(k, "top_ticket")
    why = F.when(F.col("gold_rank") > 10, "gold far down").when(~F.col("wf").eqNullSafe(F.col("kf")), "other family").when(~F.coalesce(F.array_contains("services", F.col("ws")), F.lit(False)), "other service").otherwise("order")
    return j.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def visible_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused top five of three lists in which invisible tickets were left out before the cut."""
    w = V.windows(spark, sf_dir).select("window_id", "start_us")
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), "ts_us")
    h = table(spark, sf_dir, "hits").filter("issue_id is not null and score is not null and not isnan(score)").filter(F.col("pipeline_name").isin("bm25_retrieval", "bi_encoder_retrieval", "kg_retrieval"))
    h = h.groupBy("window_id", "pipeline_name", "issue_id").agg(F.max("score").alias("score")).join(w, "window_id").join(k, "issue_id").filter("ts_us < start_us")
    r = top_rows(h, ["window_id", "pipeline_name"], [F.col("score").desc(), F.col("issue_id").asc()], 20)
    f = R.rrf(r, ["window_id"], "issue_id", "pipeline_name", "rank_no").withColumn("score", F.round("score", 9))
    return top_rows(f, ["window_id"], [F.col("score").desc(), F.col("issue_id").asc()], 5, "place").select("window_id", "issue_id", "place")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical candidates with text, service and severity scores."""
    w = V.windows(spark, sf_dir).select("window_id", "service")
    e = table(spark, sf_dir, "window_entities").groupBy("window_id").agg(F.max("severity").alias("sw"))
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), "services", F.col("severity").alias("sk"))
    r = V.ranked(spark, sf_dir).filter("pipeline_name = 'bm25_retrieval' and score > 0")
    peak = r.groupBy("window_id").agg(F.max("score").alias("peak"))
    j = r.join(peak, "window_id").join(w, "window_id").join(e, "window_id", "left").join(k, "issue_id")
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    gap = F.abs(F.array_position(order, F.coalesce("sw", F.lit(""))) - F.array_position(order, F.coalesce("sk", F.lit(""))))
    known = (F.array_position(order, F.coalesce("sw", F.lit(""))) > 1) & (F.array_position(order, F.coalesce("sk", F.lit(""))) > 1)
    return j.select("window_id", "issue_id", (F.col("score") / F.col("peak")).alias("text_score"), F.when(F.coalesce(F.array_contains("services", F.col("service")), F.lit(False)), 1.0).otherwise(0.0).alias("service_score"), F.when(known & (gap == 0), 1.0).when(known & (gap == 1), 0.5).otherwise(0.0).alias("severity_score"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best three candidates by 0.55 text + 0.30 services + 0.15 severity; ties by text, then id."""
    p = _pairs(spark, sf_dir).withColumn("score", F.round(0.55 * F.col("text_score") + 0.3 * F.col("service_score") + 0.15 * F.col("severity_score"), 9)).withColumn("text_score", F.round("text_score", 9))
    return top_rows(p, ["window_id"], [F.col("score").desc(), F.col("text_score").desc(), F.col("issue_id").asc()], 3).select("window_id", "issue_id", F.round("score", 6).alias("score"), "rank_no")


def ablation_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank of the first gold candidate under several weight profiles at once."""
    profiles = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in PROFILES]))
    p = _pairs(spark, sf_dir).withColumn("p", profiles).select("window_id", "issue_id", "p.profile", F.round(F.col("p.a") * F.col("text_score") + F.col("p.b") * F.col("service_score") + F.col("p.c") * F.col("severity_score"), 9).alias("score"))
    r = R.numbered(p, ["profile", "window_id"], [F.col("score").desc(), F.col("issue_id").asc()])
    first = E.gold_found(spark, sf_dir, r).groupBy("profile", "window_id").agg(F.min("rank_no").alias("first"))
    return first.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"))


def first_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least rank of a gold ticket for every window and pipeline that finds one."""
    return E.gold_found(spark, sf_dir, V.ranked(spark, sf_dir)).groupBy("window_id", "pipeline_name").agg(F.min("rank_no").alias("first_gold"))


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest known decision and match of every service."""
    s = V.states(spark, sf_dir).filter("service is not null and ts_us is not null")
    last = latest_rows(s.select("service", "ts_us", "window_id", "decision"), ["service"], ["ts_us", "window_id"])
    top = s.filter("top1_match is not null").groupBy("service").agg(F.max_by("top1_match", F.struct("ts_us", "window_id")).alias("last_match"))
    return last.join(top, "service", "left").select("service", "window_id", "decision", "last_match")


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most recent events of every object."""
    e = table(spark, sf_dir, "k8s_events").filter("object_name is not null and ts_ns > 0").select("object_name", "event_uid", "ts_ns").distinct()
    return top_rows(e, ["object_name"], [F.col("ts_ns").desc(), F.col("event_uid").desc()], 3).select("object_name", "event_uid", "rank_no")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of windows and of tickets: in both, in one, in either."""
    a = V.windows(spark, sf_dir).filter("family is not null").select("family")
    b = V.tickets(spark, sf_dir).filter("family is not null").select("family")
    part = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part("both", a.intersect(b)).unionByName(part("only_windows", a.subtract(b))).unionByName(part("only_tickets", b.subtract(a))).unionByName(part("either", a.unionByName(b).distinct()))


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved tickets read in rank order until 400 words are spent: read before the budget ends, and whether the last one broke it."""
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), F.size(T.words_a(F.concat_ws(" ", "root_cause", "fix"))).alias("cost"))
    r = V.ranked(spark, sf_dir).filter("pipeline_name = 'hybrid_rrf'").join(k, "issue_id")
    before = Window.partitionBy("window_id").orderBy("rank_no").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("spent", F.coalesce(F.sum("cost").over(before), F.lit(0))).filter("spent < 400")
    return r.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_read"), F.sum("cost").cast("bigint").alias("words"), (F.sum("cost") > 400).alias("broke"))


def service_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates narrowed to those of the window's service where three or more remain."""
    w = V.windows(spark, sf_dir).select("window_id", "service")
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), "services")
    r = V.ranked(spark, sf_dir).filter("pipeline_name = 'bm25_retrieval'").join(w, "window_id").join(k, "issue_id").withColumn("own", F.coalesce(F.array_contains("services", F.col("service")), F.lit(False)))
    n = r.groupBy("window_id").agg(F.count_if("own").alias("n_own"), F.count(F.lit(1)).alias("n_all"))
    return n.select("window_id", (F.col("n_own") >= 3).alias("narrowed"), F.when(F.col("n_own") >= 3, F.col("n_own")).otherwise(F.col("n_all")).alias("n_candidates"))


def novelty_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose best dense score lies below several thresholds, among those with and without gold."""
    gold = E.gold_numbers(spark, sf_dir).select("window_id", F.lit(1).alias("g"))
    r = V.ranked(spark, sf_dir, 1).filter("pipeline_name = 'bi_encoder_retrieval'").join(gold, "window_id", "left")
    t = r.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])))
    return t.groupBy("threshold").agg(F.count_if(F.col("g").isNull() & (F.col("score") < F.col("threshold"))).alias("novel_below"), F.count_if(F.col("g").isNotNull() & (F.col("score") < F.col("threshold"))).alias("known_below"), F.count_if(F.col("g").isNull()).alias("n_novel"))


def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every family in every split, with empty cells, and whether a filled cell is weak (fewer than 30)."""
    from tidemark.plans.joins import p1_manifest_split

    s = p1_manifest_split(spark, sf_dir).filter("split <> '__unassigned__'").join(V.windows(spark, sf_dir).select("window_id", "family"), "window_id").filter("family is not null")
    n = s.groupBy("family", "split").agg(F.count(F.lit(1)).alias("n"))
    cells = s.select("family").distinct().withColumn("split", F.explode(F.array(F.lit("train"), F.lit("validation"), F.lit("test"))))
    out = cells.join(n, ["family", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("weak", (F.col("n") > 0) & (F.col("n") < 30))


def family_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate among the top five by family, a column per pipeline."""
    r = E._retrieval(spark, sf_dir).join(V.windows(spark, sf_dir).select("window_id", "family"), "window_id")
    return r.groupBy("family").pivot("pipeline_name", ["bm25_retrieval", "bi_encoder_retrieval", "kg_retrieval"]).agg(F.round(F.avg(F.col("hit_5").cast("double")), 6))


def characteristic_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence line of a window that hints at an error, else its first line."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    s = w.select("window_id", F.posexplode(F.split("t", "\n")).alias("pos", "line")).filter("trim(line) <> '' and not line like 'WINDOW %'")
    hint = F.lower("line").rlike("error|exception|fault|failure|failed")
    return s.groupBy("window_id").agg(F.min_by("line", F.struct((~hint).alias("h"), "pos")).alias("line"))


def sequence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as a sequence of lines: severity by word, place as time; counts by severity and the first error's place."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    s = w.select("window_id", F.posexplode(F.split("t", "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    low = F.lower("line")
    sev = F.when(low.rlike("fatal|panic"), "fatal").when(low.rlike("error|exception|fault|failure|failed"), "error").when(low.rlike("warn|retry|timeout"), "warn").otherwise("info")
    s = s.withColumn("sev", sev)
    return s.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("sev") == "error").alias("n_errors"), F.count_if(F.col("sev") == "warn").alias("n_warnings"), F.min(F.when(F.col("sev") == "error", F.col("pos"))).alias("first_error"))


def log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a service's log lines: with a trace id, with a dependency error, structured, empty."""
    x = table(spark, sf_dir, "log_lines").groupBy("stream_id", "line_no").agg(F.max("service").alias("service"), F.max("line").alias("line"))
    c = F.coalesce("line", F.lit(""))
    return x.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_if(c.rlike(r"trace(?:_id)?[\"=: ]")).alias("n_trace"), F.count_if(c.rlike(r"failed with [A-Z][A-Za-z]+")).alias("n_dependency"), F.count_if(c.rlike(r"^\{.*\}\s*$")).alias("n_structured"), F.count_if(F.btrim(c) == "").alias("n_empty"))


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors: per language up to five tickets' worth of documents of 200 to 2000 code points in a hashed order, without known ids."""
    d = table(spark, sf_dir, "documents").filter("n_chars between 200 and 2000 and lang is not null")
    ids = table(spark, sf_dir, "eval_passages").select(F.col("item_id").alias("doc_id")).distinct()
    d = d.join(ids, "doc_id", "left_anti")
    order = F.md5(F.concat_ws("|", F.lit("9"), F.col("doc_id").cast("string")))
    return top_rows(d.select("lang", "doc_id"), ["lang"], [order.asc(), F.col("doc_id").asc()], 5).select("lang", "doc_id", "rank_no")


def newest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest issue of each run's manifest, how many there were, and how many windows it names."""
    m = table(spark, sf_dir, "split_manifest")
    n = m.groupBy("dataset_run_id").agg(F.count_distinct("generated_at").alias("n_issues"), F.max(F.struct("generated_at", "manifest_id", F.coalesce(F.size("window_assignment"), F.lit(0)).alias("k"))).alias("x"))
    return n.select("dataset_run_id", "n_issues", F.col("x.manifest_id").alias("manifest_id"), F.greatest(F.col("x.k"), F.lit(0)).alias("n_windows"))


_F = (split_truncated, split_by_run_order, split_guard, label_binary, item_filter, candidate_scope, overlap_buckets, family_by_words, capabilities, channel_lines, leak_scan, leak_redacted, fix_kinds, cause_sentence, ticket_text, recut_windows, diagnosis_time, top_changes, hashed_choice, miss_reasons, visible_hybrid, pair_scores, ablation_profiles, first_gold_rank, latest_decision, recent_events, set_operations, budget_cut, service_narrowing, novelty_thresholds, family_coverage, family_pivot, characteristic_line, sequence_lines, log_quality, length_filter, newest_manifest)
QUERIES = {f.__name__: f for f in _F}


def _sql_any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _sql_first(c: str, rules, default: str) -> str:
    return "case " + " ".join(f"when {_sql_any(c, words)} then '{name}'" for name, words in rules) + f" else '{default}' end"


_EV = "ev as (select window_id, max(triage_evidence_text) as t, max(window_type) as window_type from telemetry_windows group by 1)"
_EL = f"{_EV}, el as (select window_id, window_type, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) - 1 as pos from ev)"
_WG = f"{V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED}"
_MS = "ms as (select distinct window_id, case when name in ('train', 'training') then 'train' when name in ('val', 'valid', 'validation', 'dev') then 'validation' when name in ('test', 'testing') then 'test' end as split from (select e.key as window_id, lower(trim(e.value)) as name from (select unnest(map_entries(window_assignment)) as e from split_manifest qualify generated_at is not distinct from max(generated_at) over (partition by dataset_run_id))))"
_LEAK = "(?:" + _PARTS + r")|\b(?:" + "|".join(LEAK_WORDS) + r")\b"
_U = "('0x' || left(sha256('{seed}|' || ticket_id), 8))::bigint % {n}"
_SEV = "list_position(['none', 'minor', 'major', 'critical'], coalesce({c}, ''))"
_PAIRS = f"""{_WG}, e as (select window_id, max(severity) as sw from window_entities group by 1), bm as (select *, max(score) over (partition by window_id) as peak from r where pipeline_name = 'bm25_retrieval' and score > 0),
pp as (select bm.window_id, bm.issue_id, bm.score / bm.peak as ts, case when coalesce(list_contains(k.services, w.service), false) then 1.0 else 0.0 end as ss, coalesce({_SEV.format(c='sw')}, 0) as a, coalesce({_SEV.format(c='k.severity')}, 0) as b from bm join w using (window_id) left join e using (window_id) join k on bm.issue_id = k.ticket_id),
pq as (select window_id, issue_id, ts, ss, case when a > 1 and b > 1 and a = b then 1.0 when a > 1 and b > 1 and abs(a - b) = 1 then 0.5 else 0.0 end as vs from pp)"""
_BASE = "b as (select *, 1 as n from w where window_type = 'pre_fault_baseline' qualify row_number() over (partition by episode, service order by start_us desc nulls last, window_id desc) = 1)"
_DEL = " union all ".join(f"select w.episode, '{f}_delta' as feature, case when w.window_type = 'pre_fault_baseline' or b.n is null then 0.0 else coalesce(w.{f}, 0.0) - coalesce(b.{f}, 0.0) end as v from w left join b on w.episode is not distinct from b.episode and w.service is not distinct from b.service where w.episode is not null" for f in V.FEATURES)
_RQ = E._RT

SQL = {
    "split_truncated": f"with {V.WINDOWS}, r as (select window_id, row_number() over (partition by service order by md5('7|' || window_id), window_id) as r, count(*) over (partition by service) as n from w where service is not null) select window_id, case when r <= n * 70 // 100 then 'train' when r <= n * 70 // 100 + n * 15 // 100 then 'val' else 'test' end as split from r",
    "split_by_run_order": f"with {V.WINDOWS}, u as (select family, run, min(start_us) as t from w where family is not null and run is not null and start_us is not null group by 1, 2), r as (select *, row_number() over (partition by family order by t desc, run desc) as k, count(*) over (partition by family) as n from u) select family, run, case when k = 1 then 'test' when k = 2 and n >= 3 then 'validation' else 'train' end as split from r",
    "split_guard": f"with {V.WINDOWS}, {_MS} select family, count(distinct split) as n_splits, count(*) as n from w join ms using (window_id) where family is not null and split is not null group by 1 having count(distinct split) > 1",
    "label_binary": f"with {V.WINDOWS} select label = 'ticket_worthy' as strict, label in ('ticket_worthy', 'borderline') as inclusive, count(*) as n from w group by 1, 2",
    "item_filter": "with k as (select distinct ticket_id, list_transform(coalesce(components, []), lambda x: lower(trim(x))) as c from kg_tickets) select ticket_id, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x is not null and x <> '' and not starts_with(x, 'request') and x not in ('blob reader', 'image cache')))), '|') as components from k",
    "candidate_scope": f"with {_WG} select cast(rank_no as integer) as rank_no, case when g.ticket_id is not null then 'positive' when w.family = k.family then 'same_family_negative' else 'hard_negative' end as scope, count(*) as n from r join w using (window_id) join k on r.issue_id = k.ticket_id left join g on r.window_id = g.window_id and r.issue_id = g.ticket_id where pipeline_name = 'bm25_retrieval' and rank_no <= 5 group by 1, 2",
    "overlap_buckets": f"with {V.RANKED}, a as (select distinct window_id, coalesce(components, []) as x from window_entities), b as (select distinct ticket_id, coalesce(components, []) as y from kg_tickets), s as (select list_distinct(list_filter(list_transform(x, lambda v: lower(trim(v))), lambda v: v is not null and v <> '')) as x, list_distinct(list_filter(list_transform(y, lambda v: lower(trim(v))), lambda v: v is not null and v <> '')) as y from r join a using (window_id) join b on r.issue_id = b.ticket_id where pipeline_name = 'kg_retrieval' and rank_no = 1), j as (select case when len(list_distinct(list_concat(x, y))) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end as s from s) select case when s >= 0.999 then 'exact' when s > 0 then 'partial' else 'none' end as overlap, count(*) as n from j group by 1",
    "family_by_words": f"select distinct scenario_family, {_sql_first('lower(scenario_family)', FAMILY_WORDS, 'other')} as coarse from window_states where scenario_family is not null",
    "capabilities": f"with w as (select window_id, max(triage_evidence_text) as t, coalesce({', '.join(f'max({f})' for f in V.FEATURES)}) as f from telemetry_windows group by 1) select array_to_string(list_filter([case when length(t) >= 8 then 'text' end, case when f is not null then 'numbers' end, case when window_id in (select window_id from window_entities) then 'entities' end, case when window_id in (select window_id from hits) then 'tickets' end, case when window_id in (select window_id from k8s_events where window_id is not null) then 'events' end], lambda x: x is not null), '+') as capabilities, count(*) as n from w group by 1",
    "channel_lines": f"with {_EL} select window_type, count(*) filter ({_sql_any('lower(line)', TRACE_WORDS)}) as n_trace, count(*) filter ({_sql_any('lower(line)', CLUSTER_WORDS)}) as n_cluster, count(*) filter (not {_sql_any('lower(line)', TRACE_WORDS)} and not {_sql_any('lower(line)', CLUSTER_WORDS)}) as n_other from el where trim(line) <> '' group by 1",
    "leak_scan": f"with {_EV}, f as (select window_id, unnest(list_transform(regexp_extract_all(coalesce(t, ''), '(?i){_LEAK}'), lambda x: lower(x))) as word from ev) select word, count(distinct window_id) as n_windows, count(*) as n from f group by 1",
    "leak_redacted": f"with {_EV}, x as (select window_id, regexp_replace(regexp_replace(t, '(?:{_PARTS})', '<REDACTED>', 'gi'), '\\b(?:{'|'.join(LEAK_WORDS)})\\b', '<REDACTED>', 'gi') as text from ev) select * from x where text like '%<REDACTED>%'",
    "fix_kinds": f"with k as (select distinct ticket_id, lower(coalesce(fix, '')) as f, fix_kind from kg_tickets) select {_sql_first('f', FIXES, 'other')} as told, fix_kind as recorded, count(*) as n from k group by 1, 2",
    "cause_sentence": f"with {V.TICKETS}, s as (select ticket_id, string_split(concat_ws(' ', root_cause, fix), '. ') as s from k) select ticket_id, coalesce(list_filter(s, lambda x: regexp_matches(lower(x), 'caused|turned out|traced|failed'))[1], s[1]) as sentence from s",
    "ticket_text": "with k as (select distinct ticket_id, severity, coalesce(symptoms, []) as s, root_cause, fix from kg_tickets where ticket_id is not null) select ticket_id, concat_ws(chr(10), 'severity: ' || severity, 'symptoms: ' || array_to_string(list_transform(list_slice(list_filter(list_transform(s, lambda x: trim(x)), lambda x: x is not null and x <> ''), 1, 3), lambda x: left(x, 40)), '; '), root_cause, fix) as text from k",
    "recut_windows": f"with {V.WINDOWS}, e as (select window_id, max({V._ISO.format(c='end_time')}) as e from telemetry_windows group by 1), r as (select window_id, start_us * 1000 as a, e * 1000 as b, (start_us * 1000 + e * 1000) // 2 as m from w join e using (window_id) where start_us is not null) select window_id, greatest(m - 60000000000, a - 60000000000) as from_ns, least(m + 60000000000, b + 60000000000) as to_ns from r",
    "diagnosis_time": f"with {_WG}, a as (select distinct window_id, pipeline_name from r where window_id in (select window_id from g)), f as (select r.window_id, pipeline_name, min(rank_no) as k from r join g on r.window_id = g.window_id and r.issue_id = g.ticket_id group by 1, 2) select pipeline_name, count(*) as n, cast(sum(coalesce(k * 30, 1800)) as bigint) as seconds from a left join f using (window_id, pipeline_name) group by 1",
    "top_changes": f"with {V.WINDOWS}, {_BASE}, u as ({_DEL}), m as (select episode, feature, arg_max(v, (abs(v), v)) as v from u group by 1, 2) select episode, cast(row_number() over (partition by episode order by abs(v) desc, feature) as integer) as rank_no, regexp_replace(regexp_replace(feature, '^triage_feature_', ''), '_delta$', '') || case when v > 0 then ' rose' else ' fell' end as phrase from m where v <> 0 qualify rank_no <= 2",
    "hashed_choice": f"with {V.TICKETS} select ticket_id, ['operator', 'developer', 'lead', 'support'][{_U.format(seed='persona', n=4)} + 1] as persona, {_U.format(seed='comments', n=4)} + 1 as n_comments, {_U.format(seed='minutes', n=170)} + 10 as minutes from k",
    "miss_reasons": f"with {_WG}, m as (select r.window_id, min(rank_no) as gold_rank from r join g on r.window_id = g.window_id and issue_id = ticket_id where pipeline_name = 'bm25_retrieval' group by 1 having min(rank_no) > 1) select case when gold_rank > 10 then 'gold far down' when w.family is distinct from k.family then 'other family' when not coalesce(list_contains(k.services, w.service), false) then 'other service' else 'order' end as reason, count(*) as n from m join r on m.window_id = r.window_id and r.pipeline_name = 'bm25_retrieval' and r.rank_no = 1 join w on w.window_id = m.window_id join k on k.ticket_id = r.issue_id group by 1",
    "visible_hybrid": f"with {V.WINDOWS}, {V.TICKETS}, h as (select window_id, pipeline_name, issue_id, max(score) as score from hits where issue_id is not null and score is not null and not isnan(score) and pipeline_name in ('bm25_retrieval', 'bi_encoder_retrieval', 'kg_retrieval') group by 1, 2, 3), v as (select h.*, row_number() over (partition by h.window_id, pipeline_name order by score desc, issue_id) as rank_no from h join w using (window_id) join k on h.issue_id = k.ticket_id where k.ts_us < w.start_us), x as (select window_id, issue_id, round(sum(1.0::double / (60 + rank_no)), 9) as score from v where rank_no <= 20 group by 1, 2) select window_id, issue_id, cast(row_number() over (partition by window_id order by score desc, issue_id) as integer) as place from x qualify place <= 5",
    "pair_scores": f"with {_PAIRS}, s as (select window_id, issue_id, round(ts, 9) as ts, round(0.55::double * ts + 0.3::double * ss + 0.15::double * vs, 9) as score from pq) select window_id, issue_id, round(score, 6) as score, cast(row_number() over (partition by window_id order by score desc, ts desc, issue_id) as integer) as rank_no from s qualify rank_no <= 3",
    "ablation_profiles": f"with {_PAIRS}, s as (select profile, window_id, issue_id, round(a * ts + b * ss + c * vs, 9) as score from pq, (values {', '.join(f'({n!r}, {a}::double, {b}::double, {c}::double)' for n, a, b, c in PROFILES)}) t(profile, a, b, c)), n as (select *, row_number() over (partition by profile, window_id order by score desc, issue_id) as k from s), f as (select profile, n.window_id, min(k) as first from n join g on n.window_id = g.window_id and n.issue_id = g.ticket_id group by 1, 2) select profile, count(*) as n, round(avg(1 / first), 6) as mrr from f group by 1",
    "first_gold_rank": f"with {_WG} select r.window_id, pipeline_name, cast(min(rank_no) as integer) as first_gold from r join g on r.window_id = g.window_id and r.issue_id = g.ticket_id group by 1, 2",
    "latest_decision": f"with {V.STATES}, a as (select service, arg_max(window_id, (ts_us, window_id)) as window_id, arg_max(decision, (ts_us, window_id)) as decision from s where service is not null and ts_us is not null group by 1), b as (select service, arg_max(top1_match, (ts_us, window_id)) as last_match from s where service is not null and ts_us is not null and top1_match is not null group by 1) select service, window_id, decision, last_match from a left join b using (service)",
    "recent_events": "with e as (select distinct object_name, event_uid, ts_ns from k8s_events where object_name is not null and ts_ns > 0) select object_name, event_uid, cast(row_number() over (partition by object_name order by ts_ns desc, event_uid desc) as integer) as rank_no from e qualify rank_no <= 3",
    "set_operations": f"with {V.WINDOWS}, {V.TICKETS}, a as (select distinct family from w where family is not null), b as (select distinct family from k where family is not null) select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'only_windows', count(*) from (select * from a except select * from b) union all select 'only_tickets', count(*) from (select * from b except select * from a) union all select 'either', count(*) from (select * from a union select * from b)",
    "budget_cut": f"with {V.TICKETS}, {V.RANKED}, c as (select ticket_id, len(list_filter(regexp_extract_all(lower(concat_ws(' ', root_cause, fix)), '[a-z0-9]+'), lambda x: length(x) >= 2)) as cost from k), x as (select window_id, cost, coalesce(sum(cost) over (partition by window_id order by rank_no rows between unbounded preceding and 1 preceding), 0) as spent from r join c on r.issue_id = c.ticket_id where pipeline_name = 'hybrid_rrf') select window_id, count(*) as n_read, cast(sum(cost) as bigint) as words, sum(cost) > 400 as broke from x where spent < 400 group by 1",
    "service_narrowing": f"with {V.WINDOWS}, {V.TICKETS}, {V.RANKED}, x as (select r.window_id, count(*) filter (coalesce(list_contains(services, service), false)) as n_own, count(*) as n_all from r join w using (window_id) join k on r.issue_id = k.ticket_id where pipeline_name = 'bm25_retrieval' group by 1) select window_id, n_own >= 3 as narrowed, case when n_own >= 3 then n_own else n_all end as n_candidates from x",
    "novelty_thresholds": f"with {_WG}, x as (select r.score, r.window_id in (select window_id from g) as known from r where pipeline_name = 'bi_encoder_retrieval' and rank_no = 1) select threshold, count(*) filter (not known and score < threshold) as novel_below, count(*) filter (known and score < threshold) as known_below, count(*) filter (not known) as n_novel from x, (values (0.1::double), (0.3), (0.5), (0.7), (0.9)) t(threshold) group by 1",
    "family_coverage": f"with {V.WINDOWS}, {_MS}, s as (select family, split from w join ms using (window_id) where family is not null and split is not null), n as (select family, split, count(*) as n from s group by 1, 2) select c.family, c.split, coalesce(n, 0) as n, coalesce(n, 0) between 1 and 29 as weak from (select distinct family, unnest(['train', 'validation', 'test']) as split from s) c left join n on c.family = n.family and c.split = n.split",
    "family_pivot": f"with {_RQ} select family, " + ", ".join(f"round(avg(cast(hit_5 as double)) filter (pipeline_name = '{p}'), 6) as {p}" for p in ("bm25_retrieval", "bi_encoder_retrieval", "kg_retrieval")) + " from rq join w using (window_id) group by 1",
    "characteristic_line": f"with {_EL} select window_id, arg_min(line, (not regexp_matches(lower(line), 'error|exception|fault|failure|failed'), pos)) as line from el where trim(line) <> '' and not line like 'WINDOW %' group by 1",
    "sequence_lines": f"with {_EL}, s as (select window_id, pos, case when regexp_matches(lower(line), 'fatal|panic') then 'fatal' when regexp_matches(lower(line), 'error|exception|fault|failure|failed') then 'error' when regexp_matches(lower(line), 'warn|retry|timeout') then 'warn' else 'info' end as sev from el where trim(line) <> '') select window_id, count(*) as n_lines, count(*) filter (sev = 'error') as n_errors, count(*) filter (sev = 'warn') as n_warnings, cast(min(pos) filter (sev = 'error') as integer) as first_error from s group by 1",
    "log_quality": "with x as (select stream_id, line_no, max(service) as service, coalesce(max(line), '') as c from log_lines group by 1, 2) select service, count(*) as n, count(*) filter (regexp_matches(c, 'trace(?:_id)?[\"=: ]')) as n_trace, count(*) filter (regexp_matches(c, 'failed with [A-Z][A-Za-z]+')) as n_dependency, count(*) filter (regexp_matches(c, '^\\{.*\\}\\s*$')) as n_structured, count(*) filter (trim(c) = '') as n_empty from x group by 1",
    "length_filter": "select lang, doc_id, cast(row_number() over (partition by lang order by md5('9|' || doc_id), doc_id) as integer) as rank_no from documents where n_chars between 200 and 2000 and lang is not null and doc_id not in (select item_id from eval_passages where item_id is not null) qualify rank_no <= 5",
    "newest_manifest": "select dataset_run_id, count(distinct generated_at) as n_issues, arg_max(manifest_id, (generated_at, manifest_id)) as manifest_id, cast(arg_max(coalesce(cardinality(window_assignment), 0), (generated_at, manifest_id, coalesce(cardinality(window_assignment), 0))) as integer) as n_windows from split_manifest group by 1",
}
