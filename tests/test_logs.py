"""Log lines into entries: layouts, continuation lines, repeated rows, blocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.loglayouts import Router, iso_us, level_of
from tidemark.operators import logs

SCHEMA = "stream_id string, line_no bigint, service string, severity string, line string, received_at timestamp"
AT = dt.datetime(2026, 1, 7, 12, 0)
T = iso_us("2026-01-07T10:00:00Z")


def frame(spark, lines, stream="s", severity="info"):
    return spark.createDataFrame([(stream, i, "svc", severity, x, AT) for i, x in enumerate(lines, 1)], SCHEMA)


HEADS = [
    ("\x1b[2m2026-01-07T10:00:00Z\x1b[0m \x1b[35m WARN\x1b[0m \x1b[2mquota::keeper\x1b[0m: hello", (T, "warn", "quota::keeper", "hello")),
    ("2026/01/07 10:00:00 [error] 285#3: hello", (T, "error", None, "hello")),
    ("[2026-01-07T10:00:00Z] [err] [price.publisher] hello", (T, "error", "price.publisher", "hello")),
    ("W0107 10:00:00.000000    2458 refund_reader.go:314] hello", (T, "warn", "refund_reader.go", "hello")),
    ('ts=2026-01-07T12:00:00+02:00 level=crit caller=queue/p.go:12 msg="a \\"b\\"" took=3ms', (T, "fatal", "queue/p.go", 'a "b"')),
    ("2026-01-07 10:00:00,000 ERR   [worker-8] org.demo.Queue - hello", (T, "error", "org.demo.Queue", "hello")),
    ("1767780000000 [F] alert.cache: hello", (T, "fatal", "alert.cache", "hello")),
    ("[07/Jan/2026:15:30:00 +0530] a.b CRITICAL: hello", (T, "fatal", "a.b", "hello")),
    ('{"ts": 1767780000.000000, "lvl": "info", "mod": "x.y", "text": "a\\nb", "ctx": {"level": "n/a"}}', (T, "info", "x.y", "a\nb")),
    ("<131>Jan  7 10:00:00 node-3 replica.verifier[19323]: hello", (T, "error", "replica.verifier", "hello")),
    ("Jan  7 10:00:00 node-3 replica.verifier[19323]: hello", (T, None, "replica.verifier", "hello")),
    ("2026-01-07T10:00:00Z INFO  [cart.keeper] hello", (T, "info", "cart.keeper", "hello")),
]


@pytest.mark.parametrize("line,want", HEADS)
def test_layouts(line, want):
    r = Router()
    f = r.fields(r.clean(line + "\r"), 2026)
    assert (f.ts_us, f.level, f.component, f.message) == want


@pytest.mark.parametrize("line", ["", "  2026-01-07T10:00:00Z INFO [a] x", "\tat org.demo.A.run(A.java:3)", "SELECT id, state", "{", "| more", "2026-13-07T10:00:00Z INFO [a] x", "Traceback (most recent call last):", '{"state": "stale"}', None])
def test_no_heads(line):
    r = Router()
    assert r.fields(r.clean(line), 2026) is None


def test_levels():
    assert [level_of(x) for x in ("Notice", "dbg", "WRN", "c", "?", None)] == ["info", "debug", "warn", "fatal", None, None]


def test_entries_and_duplicates(spark):
    lines = ["cut off", HEADS[11][0], "  more", "", HEADS[10][0], None]
    df = frame(spark, lines)
    df = df.unionByName(df).withColumn("block", F.lit(9)).withColumn("is_head", F.lit("x"))
    got = sorted(map(tuple, logs.log_entries(df).collect()))
    assert got == [("s", 2, 4, T, "info", "cart.keeper", 5), ("s", 5, 6, T, "info", "replica.verifier", 5)]


def test_null_severity_gives_null_level(spark):
    assert logs.log_entries(frame(spark, [HEADS[10][0]], severity=None)).first().level is None


def test_blocks_do_not_matter(spark, monkeypatch):
    lines = []
    for i in range(40):
        lines += [HEADS[i % len(HEADS)][0]] + [f"  line {j}" for j in range(i % 7)]
    want = sorted(map(tuple, logs.log_entries(frame(spark, lines)).collect()))
    bodies = sorted(map(tuple, logs.entry_bodies(frame(spark, lines)).collect()))
    monkeypatch.setattr(logs, "BLOCK", 3)
    assert sorted(map(tuple, logs.log_entries(frame(spark, lines)).collect())) == want
    assert sorted(map(tuple, logs.entry_bodies(frame(spark, lines)).collect())) == bodies
    assert len(want) == 40 and len(bodies) == 40


def test_empty(spark):
    assert logs.log_entries(frame(spark, [])).count() == 0
    assert logs.log_entries(spark.createDataFrame([(None, 1, "a", "b", HEADS[0][0], AT), ("s", None, "a", "b", HEADS[0][0], AT)], SCHEMA)).count() == 0


def test_template():
    assert logs.template("  Took 12 MS\n for X9y  z ") == "took # ms for # z"


def test_very_long_lines():
    r = Router()
    for text in ("a" * 10**6, "<!--" * 10**5, "x:" * 10**5, " " * 10**6, "{" * 10**5, "word1 " * 10**5):
        assert r.fields(r.clean(text), 2026) is None
        assert len(logs.template(text)) <= len(text)
