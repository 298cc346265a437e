"""Raw telemetry responses: metric matrices, log streams, trace batches, cluster lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "queries map<string, struct<response: struct<data: struct<result: array<struct<metric: map<string, string>, values: array<array<string>>>>>>>>"
LOGS = "service_window struct<response: struct<data: struct<result: array<struct<stream: map<string, string>, values: array<array<string>>>>>>>"
TRACES = "traces map<string, struct<response: struct<batches: array<struct<scopeSpans: array<struct<spans: array<struct<name: string, parentSpanId: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: string>, attributes: array<struct<key: string, value: map<string, string>>>>>>>>>>>>"


def read_blobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document (a file each), with window_id from the file's name."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.withColumn("window_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def metric_samples(blobs: DataFrame) -> DataFrame:
    """(window_id, query, series, t, value) of metric matrices; missing parts give no rows."""
    q = blobs.select("window_id", F.explode("queries").alias("query", "q"))
    s = q.select("window_id", "query", F.posexplode("q.response.data.result").alias("series", "r"))
    v = s.select("window_id", "query", "series", F.explode("r.values").alias("v"))
    return v.select("window_id", "query", "series", F.try_element_at("v", F.lit(1)).cast("double").alias("t"), F.expr("try_cast(try_element_at(v, 2) as double)").alias("value"))


def metric_summary(samples: DataFrame) -> DataFrame:
    """(window_id, query, mean, spread, first, latest, peak): over all samples of a query; null samples don't count."""
    s = samples.filter("value is not null and not isnan(value)")
    return s.groupBy("window_id", "query").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("spread"), F.min_by("value", F.struct("t", "series")).alias("first"), F.max_by("value", F.struct("t", "series")).alias("latest"), F.max("value").alias("peak"))


def log_totals(blobs: DataFrame) -> DataFrame:
    """(window_id, n_logs, n_errors, n_warnings): the level of a JSON line's body counts before that of its stream."""
    s = blobs.select("window_id", F.explode("service_window.response.data.result").alias("r"))
    v = s.select("window_id", F.coalesce(F.try_element_at("r.stream", F.lit("level")), F.try_element_at("r.stream", F.lit("severity"))).alias("label"), F.explode("r.values").alias("v"))
    line = F.try_element_at("v", F.lit(2))
    level = F.lower(F.coalesce(F.get_json_object(line, "$.severity"), F.get_json_object(line, "$.level"), F.col("label"), F.lit("")))
    v = v.select("window_id", level.alias("level"))
    return v.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_logs"), F.count_if(F.col("level").isin("error", "err", "fatal", "critical")).alias("n_errors"), F.count_if(F.col("level").isin("warn", "warning")).alias("n_warnings"))


def spans(blobs: DataFrame) -> DataFrame:
    """(window_id, trace_id, name, is_root, ms, is_error) of all spans."""
    t = blobs.select("window_id", F.explode("traces").alias("trace_id", "t"))
    s = t.select("window_id", "trace_id", F.explode("t.response.batches").alias("b")).select("window_id", "trace_id", F.explode("b.scopeSpans").alias("ss")).select("window_id", "trace_id", F.explode("ss.spans").alias("s"))
    ms = (F.col("s.endTimeUnixNano").cast("bigint") - F.col("s.startTimeUnixNano").cast("bigint")) / 1e6

    def number(a):
        text = F.coalesce(F.try_element_at(a["value"], F.lit("intValue")), F.try_element_at(a["value"], F.lit("stringValue")))
        return F.when(text.rlike(r"^\d{1,6}$"), text).cast("int")

    failed = F.exists(
        F.coalesce("s.attributes", F.array().cast("array<struct<key: string, value: map<string, string>>>")),
        lambda a: F.coalesce((a["key"].isin("rpc.grpc.status_code") & (number(a) != 0)) | (a["key"].isin("http.status_code", "http.response.status_code") & (number(a) >= 500)) | ((a["key"] == "error") & (F.lower(F.coalesce(F.try_element_at(a["value"], F.lit("boolValue")), F.try_element_at(a["value"], F.lit("stringValue")))) == "true")), F.lit(False)),
    )
    status = F.upper(F.coalesce("s.status.code", F.lit("")))
    return s.select("window_id", "trace_id", F.col("s.name").alias("name"), (F.coalesce("s.parentSpanId", F.lit("")) == "").alias("is_root"), ms.alias("ms"), (status.isin("STATUS_CODE_ERROR", "ERROR", "2") | failed).alias("is_error"))


def span_summary(s: DataFrame) -> DataFrame:
    """(window_id, n_spans, n_traces, n_errors, error_rate, p50_ms, p95_ms): exact percentiles, interpolated."""
    return s.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("trace_id").alias("n_traces"), F.count_if("is_error").alias("n_errors"), F.avg(F.col("is_error").cast("double")).alias("error_rate"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"))
