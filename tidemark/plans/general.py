"""Queries of the general problems: log lines into entries, and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.logs import log_entries
from tidemark.operators.skew import eager_join_aggregate, heavy_keys
from tidemark.tables import table

HEAVY_SHARE = 0.03


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries of all lines."""
    return log_entries(table(spark, sf_dir, "log_lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of scenario_family and service_name that hold at least 3 % of all rows."""
    return heavy_keys(table(spark, sf_dir, "window_states"), ["scenario_family", "service_name"], HEAVY_SHARE).select("key_field", "key_value")


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family and service: decisions joined with the service's telemetry rows, without joining rows.

    n_pairs is the number of (decision, telemetry row) pairs of the service;
    errors is the sum of the telemetry rows' log errors over these pairs.
    """
    states = table(spark, sf_dir, "window_states").filter("service_name is not null")
    windows = table(spark, sf_dir, "telemetry_windows").filter("service_name is not null")
    joined = eager_join_aggregate(
        states,
        windows,
        on=["service_name"],
        by=["scenario_family"],
        left_sums={"worthy": F.when(F.col("triage_decision") == "ticket_worthy", 1).otherwise(0)},
        right_sums={"errors": F.coalesce(F.col("triage_feature_log_error_count").cast("bigint"), F.lit(0))},
    )
    return joined.select("scenario_family", "service_name", F.col("n_left").alias("n_states"), F.col("n_right").alias("n_windows"), "n_pairs", F.col("worthy").cast("bigint").alias("worthy_pairs"), F.col("errors").cast("bigint").alias("error_pairs"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_results": p6_results}

SQL = {
    "p6_found": """
with long as (
  select 'scenario_family' as key_field, coalesce(scenario_family, '<null>') as key_value from window_states
  union all
  select 'service_name', coalesce(service_name, '<null>') from window_states)
select key_field, key_value from long group by key_field, key_value
having count(*) * 100 >= 3 * (select count(*) from window_states)""",
    "p6_results": """
with s as (
  select scenario_family, service_name, count(*) as n_states,
         sum(case when triage_decision = 'ticket_worthy' then 1 else 0 end) as worthy
  from window_states where service_name is not null group by 1, 2),
w as (
  select service_name, count(*) as n_windows, sum(coalesce(cast(trunc(triage_feature_log_error_count) as bigint), 0)) as errors
  from telemetry_windows where service_name is not null group by 1)
select scenario_family, s.service_name, n_states, n_windows, n_states * n_windows as n_pairs,
       cast(worthy * n_windows as bigint) as worthy_pairs, cast(errors * n_states as bigint) as error_pairs
from s join w on s.service_name = w.service_name""",
}
