"""Files, raw telemetry and streams."""

import json

import pytest

from tidemark.sources import files, telemetry
from tidemark.streaming import state as streaming

SUPPRESS = [("w1", 1, "ticket_worthy", "T", "f", "active_fault"), ("w2", 2, "ticket_worthy", "T", "f", "active_fault"), ("w3", 3, "noise", None, "f", "recovery_window"), ("w4", 4, "ticket_worthy", "T", "f", "active_fault"), ("w5", 5, "ticket_worthy", "T", "f", "active_fault")]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"b": 1, "a": "x"}\n\n{"b": 2}\n', encoding="utf-8")
    got = files.read_jsonl(spark, str(p), "a string, b int")
    assert sorted(map(tuple, got.collect()), key=str) == [("x", 1), (None, 2)]
    files.write_jsonl(got.select("b", "a"), str(tmp_path / "out"))
    line = next(x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert list(json.loads(line)) == ["a", "b"]


def test_bad_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"b": 1}\n{oops\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(p), "b int", "DROPMALFORMED").collect()] == [(1,)]
    assert {r.bad for r in files.read_jsonl(spark, str(p), "b int", "PERMISSIVE", "bad").collect()} == {None, "{oops"}
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "b int").collect()


def test_csv_union(spark, tmp_path):
    a, b = spark.createDataFrame([(1, ["x"])], "i int, l array<string>"), spark.createDataFrame([("t",)], "s string")
    files.write_csv([a, b], str(tmp_path / "c"))
    got = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(map(str, map(tuple, got.select("i", "l", "s").collect()))) == ["('1', '[\"x\"]', None)", "(None, None, 't')"]


def test_runs_and_checksums(spark, tmp_path):
    for run in ("run-1", "run-2", "other"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "w.json").write_text('{"i": 1}\n')
    got = files.read_runs(spark, str(tmp_path), "run-", "i int")
    assert sorted(r.run_folder for r in got.collect()) == ["run-1", "run-2"]
    sums = files.checksums(spark, str(tmp_path))
    assert sums.count() == 3 and sums.select("sha256").distinct().count() == 1
    assert files.tree_checksum(sums).first().n_files == 3
    blobs = files.named_blobs(spark, str(tmp_path), r"^(w)\.(json)$", ["name", "kind"])
    assert blobs.count() == 3


def test_last_predictions(spark):
    a = spark.createDataFrame([("w", "bm25", 1)], "window_id string, pipeline_name string, v int")
    b = spark.createDataFrame([("w", "bm25_retrieval", 2)], "window_id string, pipeline_name string, v int")
    assert [tuple(r) for r in files.last_predictions([a, b], {"bm25": "bm25_retrieval"}).collect()] == [("w", "bm25_retrieval", 2)]


def test_missing_texts(spark):
    t = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    cache = files.missing_texts(t.filter("t = 'a'"), "t", spark.createDataFrame([], "sha256 string"))
    assert [r.text for r in files.missing_texts(t, "t", cache).collect()] == ["b"]


def blob(spark, tmp_path, schema, value):
    (tmp_path / "win-1.json").write_text(json.dumps(value))
    return telemetry.read_blobs(spark, str(tmp_path), schema)


def test_metrics(spark, tmp_path):
    value = {"queries": {"cpu": {"response": {"data": {"result": [{"metric": {"pod": "a"}, "values": [["1", "2.5"], ["2", "NaN"], ["3", "4.5"]]}]}}}, "none": None}}
    r = telemetry.metric_summary(telemetry.metric_samples(blob(spark, tmp_path, telemetry.METRICS, value))).first()
    assert (r.window_id, r.mean, r.spread, r["first"], r.latest, r.peak) == ("win-1", 3.5, 2.0, 2.5, 4.5, 4.5)


def test_logs(spark, tmp_path):
    value = {"service_window": {"response": {"data": {"result": [{"stream": {"level": "info"}, "values": [["1", '{"severity": "ERROR"}'], ["2", "plain"], ["3", '{"level": "warn"}']]}]}}}}
    assert tuple(telemetry.log_totals(blob(spark, tmp_path, telemetry.LOGS, value)).first()) == ("win-1", 3, 1, 1)


def test_spans(spark, tmp_path):
    span = {"name": "a", "startTimeUnixNano": "0", "endTimeUnixNano": "2000000"}
    bad = {**span, "parentSpanId": "x", "endTimeUnixNano": "4000000", "attributes": [{"key": "http.status_code", "value": {"intValue": "503"}}]}
    value = {"traces": {"t1": {"response": {"batches": [{"scopeSpans": [{"spans": [span, bad]}]}]}}}}
    s = telemetry.spans(blob(spark, tmp_path, telemetry.TRACES, value))
    assert sorted((r.is_root, r.is_error, r.ms) for r in s.collect()) == [(False, True, 4.0), (True, False, 2.0)]
    r = telemetry.span_summary(s).first()
    assert (r.n_spans, r.n_errors, r.p50_ms) == (2, 1, 3.0)


def test_suppressed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", *r) for r in SUPPRESS], "service string, window_id string, ts_us bigint, decision string, top1_match string, family string, window_type string")
    for i, part in enumerate((rows.filter("ts_us <= 2"), rows.filter("ts_us > 2"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.suppressed_stream(stream).writeStream.format("memory").queryName("sup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window_id: (r.suppressed, r.incident_id) for r in spark.table("sup").collect()}
    assert got == {"w1": (False, "w1"), "w2": (True, "w1"), "w3": (False, None), "w4": (False, "w4"), "w5": (True, "w4")}


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2026-01-01 00:50:00', 'a' union all select timestamp'2026-01-01 01:10:00', 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = streaming.windowed_counts(stream, "ts", ["k"])
    q = q.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("win").collect()) == [1, 2]
