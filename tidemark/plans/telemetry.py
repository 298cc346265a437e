"""Queries of aggregations, samples, state and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import state as S
from tidemark.operators import telemetry as A
from tidemark.operators.components import connected_components
from tidemark.operators.relations import entity_rows
from tidemark.plans import views as V
from tidemark.plans.joins import FIELDS
from tidemark.tables import table

HOUR_US = 3_600_000_000


def _block(c: str = "ts_us"):
    return F.floor(F.coalesce(F.col(c), F.lit(0)) / (6 * HOUR_US))


def a1_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, warnings and errors by service; repeated deliveries of a line count once."""
    lines = table(spark, sf_dir, "log_lines").groupBy("stream_id", "line_no").agg(F.max("service").alias("service"), F.max(A.level(F.col("severity"))).alias("level"))
    return lines.groupBy("service").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("level") == "warn").alias("n_warnings"), F.count_if(F.col("level").isin("error", "fatal")).alias("n_errors"), F.count_if(F.col("level").isNull()).alias("n_unknown"))


def a4_warning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of cluster events by kind and day: trouble reasons, objects and those that hit a window."""
    e = table(spark, sf_dir, "k8s_events").filter("ts_ns > 0").groupBy("event_uid").agg(F.max("kind").alias("kind"), F.max("ts_ns").alias("ts_ns"), F.max(F.lower(F.btrim("reason"))).alias("reason"), F.max("object_name").alias("o"), F.max("window_id").alias("w"))
    bad = F.col("reason").isin("backoff", "unhealthy", "oomkilling", "failedmount", "failedscheduling", "nodenotready", "nodehasdiskpressure", "killing")
    return e.groupBy("kind", F.expr("ts_ns div 86400000000000").alias("day_no")).agg(F.count_if(bad).alias("n_warnings"), F.count_distinct("o").alias("n_objects"), F.count("w").alias("n_in_windows"))


def a6_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency by service: median and 95th percentile (interpolated), and how many windows had errors."""
    w = V.windows(spark, sf_dir)
    n = w.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(V.FEATURES[1]) > 0).alias("n_errors"))
    q = A.quantiles(w, ["service"], V.FEATURES[0], {"p50": 0.5, "p95": 0.95}).withColumnRenamed("service", "_s")
    return n.join(q, n["service"].eqNullSafe(q["_s"]), "left").select("service", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n_errors")


def a7_phase_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each episode by phase, a column per phase."""
    w = V.windows(spark, sf_dir).filter("episode is not null")
    phases = ["pre_fault_baseline", "active_fault", "recovery_window", "observation_window"]
    return w.groupBy("episode").pivot("window_type", phases).agg(F.count(F.lit(1))).na.fill(0)


def a8_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of the rise of log errors from baseline to fault, min(1, log10(1 + rise) / 2), by episode."""
    w = V.windows(spark, sf_dir).filter("episode is not null")
    f = F.coalesce(V.FEATURES[3], F.lit(0.0))
    e = w.groupBy("episode").agg(F.coalesce(F.sum(F.when(F.col("window_type") == "active_fault", f)), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("window_type") == "pre_fault_baseline", f)), F.lit(0.0)).alias("b"))
    rise = F.greatest(F.col("a") - F.col("b"), F.lit(0.0))
    return e.select("episode", F.round(F.least(F.lit(1.0), F.log10(1 + rise) / 2), 6).alias("signal"))


def a9_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most frequent reasons of each kind of object."""
    e = table(spark, sf_dir, "k8s_events").select("event_uid", "kind", F.lower(F.btrim("reason")).alias("reason")).distinct()
    return A.top_values(e, ["kind"], "reason", 5).select("kind", "reason", "n", "rank_no")


def _evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"), F.max("window_type").alias("window_type"))
    return w.select("window_id", "window_type", F.explode(F.split("t", "\n")).alias("line")).filter("line <> '' and not line like 'WINDOW %'")


def a10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty most frequent templates of evidence lines: numbers as '#', identifiers stripped."""
    t = _evidence_lines(spark, sf_dir).select(F.regexp_replace(T.strip_volatile(F.col("line")), r"[0-9]+", "#").alias("template"))
    return A.top_values(t, [], "template", 20).select("template", "n", "rank_no")


def a11_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error names that evidence mentions more often in faults than in baselines: (a + 1) / (b + 1) >= 1.5, a >= 2."""
    e = _evidence_lines(spark, sf_dir).select("window_type", F.regexp_extract("line", r"^log: ([A-Za-z]+)", 1).alias("error")).filter("error <> ''")
    s = A.surge(e, [], "error", F.col("window_type") == "active_fault", F.col("window_type") == "pre_fault_baseline", 2, 1.5)
    return s.select("error", "n_active", "n_baseline", F.round("score", 6).alias("score"))


def a13_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of tickets with their document frequency and idf; the corpus size and mean length beside them."""
    k = V.tickets(spark, sf_dir).select("ticket_id", T.words_a(F.concat_ws(" ", "root_cause", "fix")).alias("ws"))
    state = k.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("ws")).alias("avg_len"))
    df = k.select("ticket_id", F.explode(F.array_distinct("ws")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(state)).select("word", "df", F.round(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"), "n_docs", F.round("avg_len", 6).alias("avg_len"))


def a14_feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features: share of rows above zero, mean, least and greatest, and whether they hardly ever fire."""
    f = A.unpivoted(V.windows(spark, sf_dir), [], V.FEATURES)
    g = f.groupBy("feature").agg(F.count("value").alias("n"), F.round(F.avg(F.when(F.col("value") > 0, 1.0).when(F.col("value").isNotNull(), 0.0)), 6).alias("fire_rate"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.withColumn("rare", F.col("fire_rate") < 0.1)


def a15_corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source: counts, empty ones, code points (sum, mean, median), first and last time."""
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    q = A.quantiles(d, ["source"], "n_chars", {"median_chars": 0.5}).withColumnRenamed("source", "_s")
    return g.join(q, g["source"].eqNullSafe(q["_s"]), "left").drop("_s").withColumn("median_chars", F.round("median_chars", 6))


def a16_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by label and source, with subtotals and the total (null: all), as grouping sets."""
    w = V.windows(spark, sf_dir).select(F.coalesce("label", F.lit("<null>")).alias("label"), F.coalesce("source", F.lit("<null>")).alias("source"))
    return w.cube("label", "source").agg(F.count(F.lit(1)).alias("n"))


def a17_counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increase of each user's counter by day, with resets."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select("user_id", "t", "event_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("double").alias("v"))
    out = A.counter_increase(e, ["user_id"], ["t", "event_id"], "v", F.floor(F.col("t") / (24 * HOUR_US)))
    return out.select("user_id", F.col("bucket").alias("day_no"), F.round("increase", 6).alias("increase"), "n")


def a17_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile of windows' latency by service from a cumulative histogram."""
    bounds = (50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, float("inf"))
    w = V.windows(spark, sf_dir).filter(F.col(V.FEATURES[0]).isNotNull() & F.col("service").isNotNull())
    b = w.select("service", F.col(V.FEATURES[0]).alias("v"), F.explode(F.array(*[F.lit(x) for x in bounds])).alias("le")).groupBy("service", "le").agg(F.count_if(F.col("v") <= F.col("le")).alias("c"))
    return A.histogram_quantile(b, ["service"], "le", "c", 0.95).select("service", F.round("quantile", 6).alias("quantile"))


def a18_services_of_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct services of each episode in order, thirty at most in the list, and their number."""
    w = V.windows(spark, sf_dir).filter("episode is not null and service is not null").select("episode", "service").distinct()
    r = w.withColumn("k", F.row_number().over(Window.partitionBy("episode").orderBy("service")))
    return r.groupBy("episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 30, F.col("service")))), lambda x: x), ",").alias("services"), F.count(F.lit(1)).alias("n_services"))


def a19_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, latest, greatest and mean value of each user's events."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and value is not null")
    o = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.min_by("value", o).alias("first_value"), F.max_by("value", o).alias("latest_value"), F.max("value").alias("max_value"), F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def a20_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile by nearest rank of every pipeline's scores."""
    h = table(spark, sf_dir, "hits").filter("score is not null and not isnan(score)")
    return A.nearest_rank(h, ["pipeline_name"], "score", 0.95)


def a21_not_invoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipelines without a hit for a window (all pipelines less those it has), counted over the windows with hits."""
    h = table(spark, sf_dir, "hits").select("window_id", "pipeline_name").distinct()
    per = h.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("n_invoked"))
    total = h.agg(F.count_distinct("window_id").alias("n"))
    return per.crossJoin(F.broadcast(total)).select("pipeline_name", "n_invoked", (F.col("n") - F.col("n_invoked")).alias("n_spared"))


def a22_option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of each family under several filters at once."""
    k = table(spark, sf_dir, "kg_tickets").groupBy("ticket_id").agg(F.max("family").alias("family"), F.max(F.size("components")).alias("nc"), F.max(F.length("root_cause")).alias("nr"), F.max("fix_kind").alias("fix_kind"))
    return k.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nc") >= 3).alias("n_components"), F.count_if(F.col("nr") >= 80).alias("n_long"), F.count_if((F.col("nc") >= 3) & (F.col("nr") >= 80)).alias("n_both"), F.count("fix_kind").alias("n_fixed"))


def o4_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of every family and phase by a seeded hash."""
    w = V.windows(spark, sf_dir).filter("family is not null").select("window_id", "family", "window_type")
    return A.quota_sample(w, ["family", "window_type"], "window_id", 3, "42")


def o5_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twenty lines of each stream: errors first, then evenly spread others."""
    lines = table(spark, sf_dir, "log_lines").groupBy("stream_id", "line_no").agg(F.max(A.level(F.col("severity"))).alias("level"))
    return A.strided(lines.select("stream_id", "line_no", "level"), ["stream_id"], F.coalesce(F.col("level").isin("error", "fatal"), F.lit(False)), ["line_no"], 20).select("stream_id", "line_no", "level")


def st1_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of the last twelve decisions of a service before each decision."""
    s = V.states(spark, sf_dir).filter("ts_us is not null").select("window_id", "service", "ts_us", "top1_match", "family", "window_type")
    return S.recent_views(s, "service", ["ts_us", "window_id"], _block()).select("window_id", "n_recent", "n_same_top", "n_recoveries", "saw_recovery", "seen_family")


def st2_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions suppressed by an equal one among the last three of the service, up to a recovery window."""
    s = V.states(spark, sf_dir).filter("ts_us is not null").select("window_id", "service", "ts_us", "decision", "top1_match", "family", "window_type")
    return S.suppression(s, "service", ["ts_us", "window_id"], _block()).select("window_id", "suppressed", "source_window")


def st3_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident of each ticket-worthy decision: suppressed ones inherit that of their source, others start one."""
    s = V.states(spark, sf_dir).filter("ts_us is not null").select("window_id", "service", "ts_us", "decision", "top1_match", "family", "window_type")
    r = S.suppression(s, "service", ["ts_us", "window_id"], _block()).filter("decision = 'ticket_worthy'")
    groups = connected_components(r.filter("suppressed").select(F.col("window_id").alias("src"), F.col("source_window").alias("dst")))
    r = r.join(groups, F.col("window_id") == F.col("node"), "left").withColumn("g", F.coalesce("component", "window_id"))
    return r.groupBy("g").agg(F.count(F.lit(1)).alias("n_windows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).select(F.col("g").alias("incident"), "n_windows", "first_us", "last_us")


def st4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal decisions of a service."""
    s = V.states(spark, sf_dir).filter("ts_us is not null and service is not null").select("service", "ts_us", "window_id", "decision")
    return S.runs(s, ["service"], ["ts_us", "window_id"], "decision", _block()).select("service", F.col("run_value").alias("decision"), F.col("first_order").alias("first_us"), "n_rows")


def st6_clock_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: counts and sums in tumbling windows."""
    e = table(spark, sf_dir, "events").filter("ts is not null")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start_at"), "event_type", "n", "total")


def st6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events less than twelve hours apart."""
    e = table(spark, sf_dir, "events").filter("ts is not null and user_id is not null")
    g = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start_at"), "n")


def st7_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster events within each window padded by a minute on both sides (joined by the minute buckets it covers)."""
    w = V.windows(spark, sf_dir).filter("start_us is not null and service is not null").select("window_id", "service", "start_us")
    minute = 60_000_000
    w = w.select("window_id", "service", (F.col("start_us") - minute).alias("a"), (F.col("start_us") + 6 * minute).alias("b"))
    w = w.withColumn("m", F.explode(F.sequence(F.expr(f"a div {minute}"), F.expr(f"b div {minute}"))))
    e = table(spark, sf_dir, "k8s_events").filter("ts_ns > 0 and kind = 'Pod'").select("event_uid", F.expr("ts_ns div 1000").alias("t"), F.regexp_extract("object_name", r"^(.*?)-[0-9a-f]{8}(?:-|$)", 1).alias("service")).distinct().withColumn("m", F.expr(f"t div {minute}"))
    return w.join(e, ["service", "m"]).filter("t >= a and t < b").groupBy("window_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("t").alias("first_us"))


def u6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of incidents over numbered families only, as spelled ('-<digits>' at the end): size and members' first and last id. `u6_incident_groups` takes all families."""
    s = table(spark, sf_dir, "window_states").filter("incident_id is not null and scenario_family rlike '-[0-9]+$'")
    pairs = s.select("incident_id", F.concat(F.lit("~"), "scenario_family").alias("f")).distinct()
    c = connected_components(pairs, "incident_id", "f").filter("node not like '~%'")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_id"), F.max("node").alias("last_id")).select("n", "first_id", "last_id")


def u6_incident_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of incidents that share a family in any spelling, over all rows with both: size and members' first and last id."""
    s = table(spark, sf_dir, "window_states").filter("incident_id is not null and scenario_family is not null")
    pairs = s.select(F.concat(F.lit("i:"), "incident_id").alias("i"), F.concat(F.lit("f:"), T.family_key(F.col("scenario_family"))).alias("f")).distinct()
    c = connected_components(pairs, "i", "f").filter(F.col("node").startswith("i:")).withColumn("node", F.expr("substr(node, 3)"))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_id"), F.max("node").alias("last_id")).select("n", "first_id", "last_id")


def f17_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of windows and tickets by kind: how many, distinct, and shared by both sides."""
    a = entity_rows(table(spark, sf_dir, "window_entities").filter("window_id is not null"), "window_id", FIELDS).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("nw"))
    b = entity_rows(table(spark, sf_dir, "kg_tickets").filter("ticket_id is not null"), "ticket_id", FIELDS).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("nk"))
    j = a.join(b, ["kind", "value"], "full")
    return j.groupBy("kind").agg(F.count("nw").alias("in_windows"), F.count("nk").alias("in_tickets"), F.count_if(F.col("nw").isNotNull() & F.col("nk").isNotNull()).alias("shared"), F.sum(F.coalesce("nw", F.lit(0)) * F.coalesce("nk", F.lit(0))).alias("pairs"))


_F = (a1_log_levels, a4_warning_events, a6_latency, a7_phase_pivot, a8_signals, a9_top_reasons, a10_templates, a11_surge, a13_document_frequency, a14_feature_profile, a15_corpus_profile, a16_split_labels, a17_counter_increase, a17_histogram_quantile, a18_services_of_episodes, a19_first_last, a20_nearest_rank, a21_not_invoked, a22_option_counts, o4_quota_sample, o5_strided, st1_recent, st2_suppression, st3_incidents, st4_runs, st6_clock_windows, st6_sessions, st7_padded, u6_components, u6_incident_groups, f17_entities)
QUERIES = {f.__name__: f for f in _F}

_LEVEL = "case " + " ".join(f"when lower(trim(severity)) in ({', '.join(repr(w) for w in ws)}) then '{k}'" for k, ws in A.SPELLINGS.items()) + " end"
_EV = "ev as (select window_id, max(triage_evidence_text) as t, max(window_type) as window_type from telemetry_windows group by 1), el as (select * from (select window_id, window_type, unnest(string_split(t, chr(10))) as line from ev) where line <> '' and not line like 'WINDOW %')"
_VOL = "line"
for _p, _b in T.VOLATILE:
    _VOL = f"regexp_replace({_VOL}, '{_p}', '{_b.replace("$1", chr(92) + "1")}', 'g')"
_ENT = "select distinct {key}, kind, lower(trim(v)) as value from (" + " union all ".join(f"select {{key}}, '{kind}' as kind, unnest({c}) as v from {{table}} where {{key}} is not null" for kind, c in FIELDS.items()) + ") where v is not null and trim(v) <> ''"
_BACK = ", ".join(f"lag(struct_pack(w := window_id, t := top1_match, f := family, k := window_type), {i}) over o as l{i}" for i in (1, 2, 3))
_HIT = "(l{i}.t = top1_match and l{i}.f = family)"
_STOP = "coalesce(l{i}.k, '') = 'recovery_window'"
_SUP = f"""b as (select *, {_BACK} from s where ts_us is not null window o as (partition by service order by ts_us, window_id)),
x as (select *, case when decision = 'ticket_worthy' and top1_match is not null then
  case when l1 is null or {_STOP.format(i=1)} then null when {_HIT.format(i=1)} then l1.w
       when l2 is null or {_STOP.format(i=2)} then null when {_HIT.format(i=2)} then l2.w
       when l3 is null or {_STOP.format(i=3)} then null when {_HIT.format(i=3)} then l3.w end end as src from b)"""
_L12 = "list(struct_pack(t := top1_match, f := family, k := window_type)) over (partition by service order by ts_us, window_id rows between 12 preceding and 1 preceding)"

SQL = {
    "a1_log_levels": f"with l as (select stream_id, line_no, max(service) as service, max({_LEVEL}) as level from log_lines group by 1, 2) select service, count(*) as n_lines, count(*) filter (level = 'warn') as n_warnings, count(*) filter (level in ('error', 'fatal')) as n_errors, count(*) filter (level is null) as n_unknown from l group by 1",
    "a4_warning_events": "with e as (select event_uid, max(kind) as kind, max(ts_ns) as ts_ns, max(lower(trim(reason))) as reason, max(object_name) as o, max(window_id) as w from k8s_events where ts_ns > 0 group by 1) select kind, ts_ns // 86400000000000 as day_no, count(*) filter (reason in ('backoff', 'unhealthy', 'oomkilling', 'failedmount', 'failedscheduling', 'nodenotready', 'nodehasdiskpressure', 'killing')) as n_warnings, count(distinct o) as n_objects, count(w) as n_in_windows from e group by 1, 2",
    "a6_latency": f"with {V.WINDOWS} select service, count(*) as n, round(quantile_cont({V.FEATURES[0]}, 0.5), 6) as p50, round(quantile_cont({V.FEATURES[0]}, 0.95), 6) as p95, count(*) filter ({V.FEATURES[1]} > 0) as n_errors from w group by 1",
    "a7_phase_pivot": f"with {V.WINDOWS} select episode, " + ", ".join(f"count(*) filter (window_type = '{p}') as {p}" for p in ("pre_fault_baseline", "active_fault", "recovery_window", "observation_window")) + " from w where episode is not null group by 1",
    "a8_signals": f"with {V.WINDOWS}, e as (select episode, coalesce(sum(coalesce({V.FEATURES[3]}, 0.0)) filter (window_type = 'active_fault'), 0.0) as a, coalesce(sum(coalesce({V.FEATURES[3]}, 0.0)) filter (window_type = 'pre_fault_baseline'), 0.0) as b from w where episode is not null group by 1) select episode, round(least(1.0, log10(1 + greatest(a - b, 0.0)) / 2), 6) as signal from e",
    "a9_top_reasons": "with e as (select distinct event_uid, kind, lower(trim(reason)) as reason from k8s_events), c as (select kind, reason, count(*) as n from e where reason is not null group by 1, 2) select kind, reason, n, cast(row_number() over (partition by kind order by n desc, reason) as integer) as rank_no from c qualify rank_no <= 5",
    "a10_templates": f"with {_EV}, c as (select regexp_replace({_VOL}, '[0-9]+', '#', 'g') as template, count(*) as n from el group by 1) select template, n, cast(row_number() over (order by n desc, template) as integer) as rank_no from c qualify rank_no <= 20",
    "a11_surge": f"with {_EV}, c as (select regexp_extract(line, '^log: ([A-Za-z]+)', 1) as error, count(*) filter (window_type = 'active_fault') as n_active, count(*) filter (window_type = 'pre_fault_baseline') as n_baseline from el group by 1) select error, n_active, n_baseline, round((n_active + 1) / (n_baseline + 1), 6) as score from c where error <> '' and n_active >= 2 and (n_active + 1) / (n_baseline + 1) >= 1.5",
    "a13_document_frequency": f"with {V.TICKETS}, d as (select ticket_id, list_filter(regexp_extract_all(lower(concat_ws(' ', root_cause, fix)), '[a-z0-9]+'), lambda x: length(x) >= 2) as ws from k), c as (select count(*) as n_docs, avg(len(ws)) as avg_len from d), f as (select word, count(*) as df from (select distinct ticket_id, unnest(ws) as word from d) group by 1) select word, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) as idf, n_docs, round(avg_len, 6) as avg_len from f, c",
    "a14_feature_profile": f"with {V.WINDOWS}, u as (" + " union all ".join(f"select '{f}' as feature, {f} as value from w" for f in V.FEATURES) + "), g as (select feature, count(value) as n, round(avg(case when value > 0 then 1.0::double when value is not null then 0.0 end), 6) as fire_rate, round(avg(value), 6) as mean, min(value) as low, max(value) as high from u group by 1) select *, fire_rate < 0.1 as rare from g",
    "a15_corpus_profile": "select source, count(*) as n_docs, count(*) filter (coalesce(length(text), 0) = 0) as n_empty, cast(sum(n_chars) as bigint) as chars, round(avg(n_chars), 6) as mean_chars, round(median(n_chars), 6) as median_chars, min(created_at) as first_at, max(created_at) as last_at from documents group by 1",
    "a16_split_labels": f"with {V.WINDOWS}, x as (select coalesce(label, '<null>') as label, coalesce(source, '<null>') as source from w) select label, source, count(*) as n from x group by cube (label, source)",
    "a17_counter_increase": "with e as (select user_id, ts, event_id, floor(coalesce(value, 0.0)) as v, epoch_us(ts) // 86400000000 as day_no from events where user_id is not null and ts is not null), l as (select *, lag(v) over (partition by user_id order by ts, event_id) as p from e) select user_id, day_no, round(sum(case when p is null then 0.0 when v < p then v else v - p end), 6) as increase, count(*) as n from l group by 1, 2",
    "a17_histogram_quantile": f"with {V.WINDOWS}, b as (select service, le, count(*) filter ({V.FEATURES[0]} <= le) as c from w, (values (50.0::double), (100.0), (250.0), (500.0), (1000.0), (2500.0), (5000.0), (10000.0), ('infinity'::double)) t(le) where {V.FEATURES[0]} is not null and service is not null group by 1, 2), l as (select *, coalesce(lag(c) over o, 0) as c0, coalesce(lag(le) over o, 0.0) as u0, max(c) over (partition by service) as n from b window o as (partition by service order by le)), q as (select service, arg_min(case when isinf(le) then u0 when c = c0 then le else u0 + (le - u0) * (n * 0.95 - c0) / (c - c0) end, le) as quantile from l where c >= n * 0.95 and n > 0 group by 1) select service, round(quantile, 6) as quantile from q",
    "a18_services_of_episodes": f"with {V.WINDOWS}, d as (select distinct episode, service from w where episode is not null and service is not null) select episode, array_to_string(list_slice(list_sort(list(service)), 1, 30), ',') as services, count(*) as n_services from d group by 1",
    "a19_first_last": "select user_id, arg_min(value, (ts, event_id)) as first_value, arg_max(value, (ts, event_id)) as latest_value, max(value) as max_value, round(avg(value), 6) as mean_value, count(*) as n from events where user_id is not null and value is not null group by 1",
    "a20_nearest_rank": "with h as (select pipeline_name, score, row_number() over (partition by pipeline_name order by score) as k, count(*) over (partition by pipeline_name) as n from hits where score is not null and not isnan(score)) select pipeline_name, n, score as quantile from h where k = greatest(ceil(n * 0.95), 1)",
    "a21_not_invoked": "with h as (select distinct window_id, pipeline_name from hits) select pipeline_name, count(*) as n_invoked, (select count(distinct window_id) from h) - count(*) as n_spared from h group by 1",
    "a22_option_counts": "with k as (select ticket_id, max(family) as family, max(len(components)) as nc, max(length(root_cause)) as nr, max(fix_kind) as fix_kind from kg_tickets group by 1) select family, count(*) as n, count(*) filter (nc >= 3) as n_components, count(*) filter (nr >= 80) as n_long, count(*) filter (nc >= 3 and nr >= 80) as n_both, count(fix_kind) as n_fixed from k group by 1",
    "o4_quota_sample": f"with {V.WINDOWS} select window_id, family, window_type, cast(row_number() over (partition by family, window_type order by md5('42|' || window_id), window_id) as integer) as sample_no from w where family is not null qualify sample_no <= 3",
    "o5_strided": f"with l as (select stream_id, line_no, max({_LEVEL}) as level from log_lines group by 1, 2), m as (select *, coalesce(level in ('error', 'fatal'), false) as e from l), n as (select *, row_number() over (partition by stream_id, e order by line_no) as k, count(*) filter (e) over (partition by stream_id) as ne, count(*) filter (not e) over (partition by stream_id) as no_ from m), r as (select *, greatest(20 - ne, 0) as room, greatest(coalesce(ceil(no_ / nullif(greatest(20 - ne, 0), 0)), 1), 1) as stride from n) select stream_id, line_no, level from r where case when e then k <= 20 else room > 0 and (k - 1) % stride = 0 and floor((k - 1) / stride) < room end",
    "st1_recent": f"with {V.STATES}, a as (select *, list_reverse(coalesce({_L12}, [])) as r from s where ts_us is not null), p as (select *, list_position(list_transform(r, lambda x: not coalesce(x.t = r[1].t, false)), true) as d, list_position(list_transform(r, lambda x: coalesce(x.k, '') <> 'recovery_window'), true) as q from a) select window_id, cast(len(r) as integer) as n_recent, cast(case when coalesce(d, 0) > 0 then d - 1 else len(r) end as bigint) as n_same_top, cast(case when coalesce(q, 0) > 0 then q - 1 else len(r) end as bigint) as n_recoveries, len(list_filter(r, lambda x: coalesce(x.k, '') = 'recovery_window')) > 0 as saw_recovery, len(list_filter(r, lambda x: coalesce(x.f = family, false))) > 0 as seen_family from p",
    "st2_suppression": f"with {V.STATES}, {_SUP} select window_id, src is not null as suppressed, src as source_window from x",
    "st3_incidents": f"with recursive {V.STATES}, {_SUP}, e as (select window_id, src from x where decision = 'ticket_worthy'), sym as (select window_id as a, src as b from e where src is not null union select src, window_id from e where src is not null), reach as (select window_id as n, window_id as m from e union select r.n, sym.b from reach r join sym on r.m = sym.a), g as (select n as window_id, min(m) as g from reach group by 1) select g as incident, count(*) as n_windows, min(ts_us) as first_us, max(ts_us) as last_us from g join s using (window_id) group by 1",
    "st4_runs": f"with {V.STATES}, a as (select *, case when decision is not distinct from lag(decision) over o and row_number() over o > 1 then 0 else 1 end as new from s where ts_us is not null and service is not null window o as (partition by service order by ts_us, window_id)), b as (select *, sum(new) over (partition by service order by ts_us, window_id rows unbounded preceding) as i from a) select service, any_value(decision) as decision, min(ts_us) as first_us, count(*) as n_rows from b group by service, i",
    "st6_clock_windows": "select time_bucket(interval '1 hour', ts) as start_at, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
    "st6_sessions": "with a as (select user_id, ts, case when ts - lag(ts) over o < interval '12 hours' then 0 else 1 end as new from events where ts is not null and user_id is not null window o as (partition by user_id order by ts)), b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from a) select user_id, min(ts) as start_at, count(*) as n from b group by user_id, i",
    "st7_padded": f"with {V.WINDOWS}, e as (select distinct event_uid, ts_ns // 1000 as t, regexp_extract(object_name, '^(.*?)-[0-9a-f]{{8}}(?:-|$)', 1) as service from k8s_events where ts_ns > 0 and kind = 'Pod') select window_id, count(*) as n_events, min(t) as first_us from w join e on w.service = e.service and t >= start_us - 60000000 and t < start_us + 360000000 group by 1",
    "u6_components": "with recursive p as (select distinct incident_id as i, scenario_family as f from window_states where incident_id is not null and regexp_matches(scenario_family, '-[0-9]+$')), sym as (select distinct a.i as a, b.i as b from p a join p b on a.f = b.f), reach as (select distinct i as n, i as m from p union select r.n, sym.b from reach r join sym on r.m = sym.a), g as (select n, min(m) as c from reach group by 1) select count(*) as n, min(n) as first_id, max(n) as last_id from g group by c",
    "f17_entities": f"with a as (select kind, value, count(*) as nw from ({_ENT.format(key='window_id', table='window_entities')}) group by 1, 2), b as (select kind, value, count(*) as nk from ({_ENT.format(key='ticket_id', table='kg_tickets')}) group by 1, 2) select coalesce(a.kind, b.kind) as kind, count(nw) as in_windows, count(nk) as in_tickets, count(*) filter (nw is not null and nk is not null) as shared, cast(sum(coalesce(nw, 0) * coalesce(nk, 0)) as bigint) as pairs from a full join b on a.kind = b.kind and a.value = b.value group by 1",
}
