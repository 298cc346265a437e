"""Windows, tickets and ranked hits as the queries use them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import iso_timestamp
from tidemark.operators.asof import latest_rows
from tidemark.operators.relations import top_rows
from tidemark.tables import table

FEATURES = ("triage_feature_trace_latency_p95_ms", "triage_feature_trace_error_rate", "triage_feature_k8s_restart_count", "triage_feature_log_error_count")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per window: the row received last."""
    w = table(spark, sf_dir, "telemetry_windows").filter("window_id is not null")
    w = w.select(
        "window_id", F.col("dataset_run_id").alias("run"), F.col("incident_episode_id").alias("episode"), F.col("scenario_family").alias("family"), F.col("service_name").alias("service"), "window_type",
        F.unix_micros(iso_timestamp(F.col("start_time"))).alias("start_us"), F.col("triage_label").alias("label"), "source", "is_hard_case", *FEATURES, "ingested_at",
    )
    return latest_rows(w, ["window_id"], ["ingested_at", "label"])


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ticket: services trimmed and lower-cased, time as epoch microseconds."""
    k = table(spark, sf_dir, "kg_tickets").filter("ticket_id is not null")
    services = F.array_distinct(F.filter(F.transform(F.coalesce("affected_services", F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x))), lambda x: x.isNotNull() & (x != "")))
    return k.select("ticket_id", "family", "severity", F.array_sort(services).alias("services"), F.unix_micros(iso_timestamp(F.col("timestamp"))).alias("ts_us"), "root_cause", "fix").distinct().transform(lambda d: latest_rows(d, ["ticket_id"], ["ts_us"]))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per window: its decision recorded last."""
    s = table(spark, sf_dir, "window_states").filter("window_id is not null")
    s = s.select("window_id", F.col("service_name").alias("service"), F.unix_micros(iso_timestamp(F.col("timestamp"))).alias("ts_us"), F.col("triage_decision").alias("decision"), "top1_match", "is_novel", "incident_id", F.col("scenario_family").alias("family"), "window_type", "expected_in_memory", "recorded_at")
    return latest_rows(s, ["window_id"], ["recorded_at", "decision"])


def ranked(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """(window_id, pipeline_name, issue_id, score, rank_no): each pipeline's n best tickets of a window."""
    h = table(spark, sf_dir, "hits").filter("issue_id is not null and score is not null and not isnan(score)")
    h = h.groupBy("window_id", "pipeline_name", "issue_id").agg(F.max("score").alias("score"))
    return top_rows(h, ["window_id", "pipeline_name"], [F.col("score").desc(), F.col("issue_id").asc()], n)


_ISO = "epoch_us(cast(regexp_replace(regexp_replace(trim({c}), '(\\.\\d{{6}})\\d+', '\\1'), '([+-]\\d{{2}})(\\d{{2}})$', '\\1:\\2') as timestamptz))"

WINDOWS = f"""w as (
  select window_id, dataset_run_id as run, incident_episode_id as episode, scenario_family as family, service_name as service, window_type,
         {_ISO.format(c="start_time")} as start_us, triage_label as label, source, is_hard_case, {", ".join(FEATURES)}, ingested_at
  from telemetry_windows where window_id is not null
  qualify row_number() over (partition by window_id order by ingested_at desc nulls last, triage_label desc nulls last) = 1)"""

TICKETS = f"""k as (
  select ticket_id, family, severity, services, ts_us, root_cause, fix from (
    select ticket_id, family, severity, root_cause, fix, {_ISO.format(c='"timestamp"')} as ts_us,
           list_sort(list_distinct(list_filter(list_transform(coalesce(affected_services, []), lambda x: lower(trim(x))), lambda x: x is not null and x <> ''))) as services
    from kg_tickets where ticket_id is not null)
  qualify row_number() over (partition by ticket_id order by ts_us desc nulls last) = 1)"""

STATES = f"""s as (
  select window_id, service_name as service, {_ISO.format(c='"timestamp"')} as ts_us, triage_decision as decision, top1_match, is_novel, incident_id,
         scenario_family as family, window_type, expected_in_memory, recorded_at
  from window_states where window_id is not null
  qualify row_number() over (partition by window_id order by recorded_at desc nulls last, triage_decision desc nulls last) = 1)"""

RANKED = """r as (
  select * from (
    select *, row_number() over (partition by window_id, pipeline_name order by score desc, issue_id) as rank_no from (
      select window_id, pipeline_name, issue_id, max(score) as score from hits
      where issue_id is not null and score is not null and not isnan(score) group by 1, 2, 3))
  where rank_no <= 20)"""

GOLD = """g as (
  select distinct window_id, ticket_id from w join (select ticket_id, family as f, ts_us, unnest(services) as svc from k) t on w.family = t.f and w.service = t.svc and t.ts_us < w.start_us
  union
  select distinct window_id, ticket_id from w join k on w.service is null and w.family = k.family and k.ts_us < w.start_us)"""
