"""Queries of the scalar and text functions, over the evidence of windows and the fields of tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.tables import table


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, t): each window's evidence."""
    return table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticket_id, t): each ticket's root cause and fix."""
    t = F.concat_ws(" ", "root_cause", "fix")
    return table(spark, sf_dir, "kg_tickets").groupBy("ticket_id").agg(F.max(t).alias("t"))


def _evidence(make) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evidence(spark, sf_dir).select("window_id", *make(F.col("t")))

    return query


def _tickets(make) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tickets(spark, sf_dir).select("ticket_id", *make(F.col("t")))

    return query


def _words(c: Column) -> list[Column]:
    return [F.array_join(c, " ").alias("words"), F.size(c).alias("n_words")]


def f15_header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text of a window: header fields, then its evidence; nulls left out."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("service_name").alias("s"), F.max("window_type").alias("k"), F.max("triage_evidence_text").alias("t"))
    return w.select("window_id", F.concat_ws("\n", F.concat(F.lit("service: "), "s"), F.concat(F.lit("phase: "), "k"), F.col("t")).alias("query_text"))


def f7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each ticket's services and components as sets."""
    k = table(spark, sf_dir, "kg_tickets").dropDuplicates(["ticket_id"])
    return k.select("ticket_id", F.round(T.jaccard(F.col("components"), F.array_append(F.coalesce("affected_services", F.array().cast("array<string>")), F.lit("request router"))), 6).alias("similarity"))


def f20_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities in one spelling, unknown ones as 'none', with their rank, and counts."""
    rank = F.create_map(*[F.lit(x) for kv in (("none", 0), ("minor", 1), ("major", 2), ("critical", 3)) for x in kv])
    k = table(spark, sf_dir, "kg_tickets").select("ticket_id", F.lower(F.btrim("severity")).alias("s")).distinct()
    s = F.when(F.col("s").isin("none", "minor", "major", "critical"), F.col("s")).otherwise("none")
    return k.select("ticket_id", s.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("severity_rank", rank[F.col("severity")])


def f23_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of windows as epoch microseconds, and their length, from times with mixed offsets and fractions."""
    w = table(spark, sf_dir, "telemetry_windows").select("window_id", "start_time", "end_time").distinct()
    start, end = (F.unix_micros(T.iso_timestamp(F.col(c))) for c in ("start_time", "end_time"))
    return w.select("window_id", start.alias("start_us"), end.alias("end_us"), F.greatest(end - start, F.lit(0)).alias("length_us"))


def f26_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of window ids, short digests and slugs."""
    w = table(spark, sf_dir, "telemetry_windows").select("window_id", "scenario_id").distinct()
    return w.select("window_id", F.regexp_extract("window_id", r"^win-(\d+)-", 1).alias("run_no"), F.substring(F.sha2(F.col("window_id"), 256), 1, 12).alias("short_id"), T.slug(F.col("scenario_id")).alias("scenario_slug"))


def p3_family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every stored family by the hash of its name."""
    f = table(spark, sf_dir, "window_states").filter("scenario_family is not null").select("scenario_family").distinct()
    return f.select("scenario_family", T.hash_mod_10(F.col("scenario_family")).alias("bucket"), T.family_split(F.col("scenario_family")).alias("split"))


def f16_latency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by band of their p95 latency; null for none."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_feature_trace_latency_p95_ms").alias("ms"))
    return w.groupBy(T.latency_band(F.col("ms")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def f6_pod_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of cluster objects by name (without the two trailing hashes), with their number of objects."""
    o = table(spark, sf_dir, "k8s_events").filter("object_name is not null").select("object_name").distinct()
    return o.groupBy(T.service_of_pod(F.col("object_name")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


def f28_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic score of a window's latency around half a second, and the run in its id where it names one."""
    w = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_feature_trace_latency_p95_ms").alias("ms"))
    return w.select("window_id", F.round(T.sigmoid((F.col("ms") - 500) / 200), 6).alias("score"), T.run_of_window(F.col("window_id")).alias("run"))


QUERIES = {
    "f1_words_a": _evidence(lambda t: _words(T.words_a(t))),
    "f2_words_b": _evidence(lambda t: _words(T.words_b(t))),
    "f3_words_c": _evidence(lambda t: _words(T.words_c(t))),
    "f4_symptom_words": _tickets(lambda t: _words(T.symptom_words(t))),
    "f5_corpus_words": _tickets(lambda t: _words(T.corpus_words(t))),
    "f6_rerank_words": _tickets(lambda t: [F.array_join(F.array_sort(T.rerank_words(t)), " ").alias("words")]),
    "f6_camel_parts": _tickets(lambda t: [F.array_join(T.camel_parts(t), " ").alias("parts")]),
    "f7_jaccard": f7_jaccard,
    "f8_strip_volatile": _evidence(lambda t: [T.strip_volatile(t).alias("text")]),
    "f9_normal_sequence": _evidence(lambda t: [T.normal_sequence(t).alias("text")]),
    "f15_header_text": f15_header_text,
    "f16_error_classes": _evidence(lambda t: [F.array_join(T.error_classes(t), ",").alias("error_classes")]),
    "f16_latency_bands": f16_latency_bands,
    "f6_pod_services": f6_pod_services,
    "f28_sigmoid": f28_sigmoid,
    "f18_reason_class": _tickets(lambda t: [T.reason_class(t).alias("reason")]),
    "f20_severity": f20_severity,
    "f23_times": f23_times,
    "f26_ids": f26_ids,
    "p3_family_split": p3_family_split,
}

_W = "with e as (select window_id, max(triage_evidence_text) as t from telemetry_windows group by window_id)"
_K = "with e as (select ticket_id, max(concat_ws(' ', root_cause, fix)) as t from kg_tickets group by ticket_id)"


def _list(key: str, head: str, words: str) -> str:
    return f"{head}, w as (select {key}, {words} as w from e) select {key}, array_to_string(w, ' ') as words, cast(len(w) as integer) as n_words from w"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _replace(expr: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, by in rules:
        flags = "'gi'" if pattern.startswith("(?i)") else "'g'"
        expr = f"regexp_replace({expr}, '{pattern.removeprefix('(?i)')}', '{by.replace("$1", chr(92) + "1")}', {flags})"
    return expr


# Keep the first of each value, in order.
_DISTINCT = "list_transform(list_sort(list_distinct(list_transform({w}, lambda x: list_position({w}, x)))), lambda i: {w}[i])"


def _distinct(key: str, head: str, words: str) -> str:
    return f"{head}, w as (select {key}, {words} as v from e), d as (select {key}, {_DISTINCT.format(w='v')} as w from w) select {key}, array_to_string(w, ' ') as words, cast(len(w) as integer) as n_words from d"


def _classes() -> str:
    cases = ", ".join(f"case when regexp_matches(coalesce(t, ''), '{p}') then '{name}' end" for name, p in T.ERROR_CLASSES)
    return f"{_W} select window_id, array_to_string(list_filter([{cases}], lambda x: x is not null), ',') as error_classes from e"


def _reason() -> str:
    cases = " ".join(f"when regexp_matches(coalesce(t, ''), '{p}') then '{name}'" for name, p in T.REASONS)
    return f"{_K} select ticket_id, case {cases} else 'other' end as reason from e"


_ISO = "epoch_us(cast(regexp_replace(regexp_replace(trim({c}), '(\\.\\d{{6}})\\d+', '\\1'), '([+-]\\d{{2}})(\\d{{2}})$', '\\1:\\2') as timestamptz))"
_MOD = "list_sum(list_transform(range(1, 64), lambda i: strpos('0123456789abcdef', sha256(scenario_family)[i]) - 1))"
_HASH = f"cast((6 * {_MOD} + strpos('0123456789abcdef', sha256(scenario_family)[64]) - 1) % 10 as integer)"
_STEM = " ".join(f"when x like '%{s}' and length(x) > {len(s) + 2} then left(x, length(x) - {len(s)})" for s in ("ing", "ed", "es", "s"))

_MS = "w as (select window_id, max(triage_feature_trace_latency_p95_ms) as ms from telemetry_windows group by 1)"
_BANDS = " ".join(f"when ms > 0 and ms >= {a} and ms < {b} then '{name}'" for a, b, name in T.LATENCY_BANDS)

SQL = {
    "f16_latency_bands": f"with {_MS} select case {_BANDS} end as band, count(*) as n from w group by 1",
    "f6_pod_services": "with o as (select distinct object_name as o, string_split(object_name, '-') as p from k8s_events where object_name is not null) select case when len(p) > 2 then array_to_string(p[1:len(p) - 2], '-') when len(p) = 2 then o end as service, count(*) as n from o group by 1",
    "f28_sigmoid": f"with {_MS} select window_id, round(case when (ms - 500) / 200 >= 0 then 1 / (1 + exp(-(ms - 500) / 200)) else exp((ms - 500) / 200) / (1 + exp((ms - 500) / 200)) end, 6) as score, regexp_extract(window_id, '^(.*?-r\\d+)-', 1) as run from w",
    "f1_words_a": _list("window_id", _W, "list_filter(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+'), lambda x: length(x) >= 2)"),
    "f2_words_b": _list("window_id", _W, "list_transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))"),
    "f3_words_c": _list("window_id", _W, f"list_filter(regexp_extract_all(coalesce({_replace('lower(t)', tuple((p, ' ') for p in T.CLEANED))}, ''), '[a-z0-9_]+'), lambda x: length(x) > 1 and x not in {_in(T.STOP_WORDS)})"),
    "f4_symptom_words": _distinct("ticket_id", _K, f"list_filter(regexp_extract_all(lower(coalesce(t, '')), '[a-z][a-z0-9_]{{2,}}'), lambda x: x not in {_in(T.SYMPTOM_STOP_WORDS)})"),
    "f5_corpus_words": _distinct("ticket_id", _K, "list_transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z_][A-Za-z_0-9]{2,}'), lambda x: lower(x))"),
    "f6_rerank_words": f"{_K}, w as (select ticket_id, list_filter(regexp_extract_all(lower(coalesce(t, '')), '[a-z][a-z0-9]{{2,}}'), lambda x: x not in {_in(T.STOP_WORDS)}) as w from e) select ticket_id, array_to_string(list_sort(list_distinct(list_concat(w, list_filter(list_transform(w, lambda x: case {_STEM} end), lambda x: x is not null)))), ' ') as words from w",
    "f7_jaccard": """
with k as (select distinct ticket_id, coalesce(components, []) as c, coalesce(affected_services, []) as s from kg_tickets),
x as (select ticket_id, list_distinct(list_filter(list_transform(c, lambda v: lower(trim(v))), lambda v: v is not null and v <> '')) as a,
  list_distinct(list_filter(list_transform(list_append(s, 'request router'), lambda v: lower(trim(v))), lambda v: v is not null and v <> '')) as b from k)
select ticket_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as similarity from x""",
    "f8_strip_volatile": f"{_W} select window_id, {_replace('t', T.VOLATILE)} as text from e",
    "f9_normal_sequence": f"{_W} select window_id, {_replace('t', T.SEQUENCE)} as text from e",
    "f15_header_text": "select window_id, concat_ws(chr(10), 'service: ' || max(service_name), 'phase: ' || max(window_type), max(triage_evidence_text)) as query_text from telemetry_windows group by window_id",
    "f16_error_classes": _classes(),
    "f18_reason_class": _reason(),
    "f20_severity": """
with k as (select distinct ticket_id, lower(trim(severity)) as s from kg_tickets),
n as (select ticket_id, case when s in ('none', 'minor', 'major', 'critical') then s else 'none' end as severity from k)
select severity, count(*) as n, cast(case severity when 'critical' then 3 when 'major' then 2 when 'minor' then 1 else 0 end as integer) as severity_rank from n group by severity""",
    "f23_times": f"with w as (select distinct window_id, {_ISO.format(c='start_time')} as a, {_ISO.format(c='end_time')} as b, start_time, end_time from telemetry_windows) select window_id, a as start_us, b as end_us, greatest(b - a, 0) as length_us from w",
    "f26_ids": "with w as (select distinct window_id, scenario_id from telemetry_windows) select window_id, regexp_extract(window_id, '^win-(\\d+)-', 1) as run_no, left(sha256(window_id), 12) as short_id, regexp_replace(regexp_replace(lower(scenario_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as scenario_slug from w",
    "p3_family_split": f"with h as (select distinct scenario_family, {_HASH} as b from window_states where scenario_family is not null) select scenario_family, b as bucket, case when b <= 1 then 'test' when b <= 3 then 'validation' else 'train' end as split from h",
}
