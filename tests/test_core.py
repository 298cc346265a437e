"""Skew, time joins, metrics, telemetry and state on small frames with known results."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, metrics, rank, relations, search, skew, state, telemetry
from tidemark.operators.components import connected_components
from tidemark.plans import further
from tidemark.plans import telemetry as telemetry_plans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", None)] * 6 + [("b", "x")] * 3 + [(None, "<null>")], "f string, g string").withColumn("key_field", F.lit(1)).withColumn("n", F.lit(2))
    got = rows(skew.heavy_keys(df, ["f", "g"], 0.3).select("key_field", "key_value", "n"))
    assert got == [("f", "a", 6), ("f", "b", 3), ("g", "<null>", 6), ("g", "x", 3)]
    assert skew.heavy_keys(df.limit(0), ["f", "g"], 0.03).count() == 0


def test_eager_join_equals_join(spark):
    rnd = random.Random(1)
    a = spark.createDataFrame([(rnd.choice(["p", "p", "q", None]), rnd.randint(0, 5)) for _ in range(60)], "k string, v int")
    b = spark.createDataFrame([(rnd.choice(["p", "q", "z", None]), rnd.randint(0, 5)) for _ in range(40)], "k string, w int")
    got = skew.eager_join_aggregate(a, b, ["k"], left_sums={"sv": F.col("v")}, right_sums={"sw": F.col("w")})
    j = a.join(b.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).groupBy("k").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("v").alias("sv"), F.sum("w").alias("sw"))
    assert rows(got.select("k", "n_pairs", "sv", "sw")) == rows(j)
    assert skew.eager_join_aggregate(a, b.limit(0), ["k"]).count() == 0


def test_skew_join_equals_join(spark):
    a = spark.createDataFrame([("hot", i) for i in range(200)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    b = spark.createDataFrame([("hot", "H"), ("k3", "K"), ("zz", "Z")], "k string, w string")
    for how in ("inner", "left"):
        assert rows(skew.skew_join(a, b, "k", how, share=0.1, salts=4).select("k", "v", "w")) == rows(a.join(b, "k", how).select("k", "v", "w"))


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n")], "id string, t int, v string")
    assert rows(asof.latest_rows(df, ["id"], ["t"])) == [("a", 2, "z"), ("b", None, "n")]


@pytest.mark.parametrize("width,inclusive", [(1, False), (7, True), (1000, False)])
def test_asof_equals_brute(spark, width, inclusive):
    rnd = random.Random(width)
    left = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(30)])) for i in range(60)]
    right = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(30)]), f"v{i:02}") for i in range(40)]
    got = asof.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v string"), ["k"], "t", "u", "v", width, inclusive)
    want = []
    for i, k, t in left:
        seen = sorted((u, v) for kk, u, v in right if None not in (k, t, kk, u) and kk == k and (u <= t if inclusive else u < t))
        want.append((i, k, t, len(seen), seen[-1][1] if seen else None))
    assert rows(got) == sorted(want, key=str)


def test_recent_equals_brute(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["a", None]), t) for i, t in enumerate(rnd.sample(range(300), 60))]
    got = asof.with_recent(spark.createDataFrame(data, "id int, k string, t int"), ["k"], ["t"], ["id"], 3, F.floor(F.col("t") / 20))
    for r in got.collect():
        before = sorted((t, i) for i, k, t in data if k == r.k and t < r.t)[-3:][::-1]
        assert [x.id for x in r.recent] == [i for _, i in before]


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "d"), (None, "x"), ("y", "z"), ("b", "a"), ("f", "e"), ("g", "f"), ("h", "g"), ("e", "z")]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()))
    assert got == {"a": "a", "b": "a", "c": "a", "e": "e", "f": "e", "g": "e", "h": "e", "y": "e", "z": "e"}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_incident_groups(spark, tmp_path):
    data = [("i1", "dns-loss"), ("i2", " DNS_loss "), ("i2", "Config  Drift"), ("i3", "config-drift"), ("i4", "probe-00012"), ("~5", "probe_00012"), ("i6", "disk-saturation"), ("i6", None), ("i7", None), (None, "dns-loss")]
    spark.createDataFrame(data * 2, "incident_id string, scenario_family string").write.parquet(f"{tmp_path}/window_states.parquet")
    got = telemetry_plans.u6_incident_groups(spark, str(tmp_path))
    assert rows(got.select("n", "first_id", "last_id")) == [(1, "i6", "i6"), (2, "i4", "~5"), (3, "i1", "i3")]


def test_components_random(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randint(0, 120):03}", f"n{rnd.randint(0, 120):03}") for _ in range(90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()))
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_gold_and_deltas(spark):
    w = spark.createDataFrame([("w1", "f", "s", 10), ("w2", "f", None, 10), ("w3", None, "s", 10), ("w4", "f", "s", None)], "window_id string, family string, service string, start_us bigint")
    k = spark.createDataFrame([("k1", "f", ["s"], 9), ("k2", "f", ["t"], 9), ("k3", "f", ["s"], 10), ("k4", "f", None, 1)], "ticket_id string, family string, services array<string>, ts_us bigint")
    assert rows(relations.gold_counts(w, k)) == [("w1", 1, "k1", "k1"), ("w2", 3, "k1", "k4"), ("w3", 0, None, None), ("w4", 0, None, None)]
    every = w.select("window_id").crossJoin(k.select(F.col("ticket_id").alias("issue_id"))).withColumn("family", F.lit("z"))
    want = [("w1", "k1"), ("w2", "k1"), ("w2", "k2"), ("w2", "k4")]
    assert rows(relations.gold_pairs(every, w, k).select("window_id", "issue_id")) == want
    # With reasons and runs: equal reasons, other runs.
    w2, k2 = w.withColumn("reason", F.lit("a")).withColumn("run", F.lit("r1")), k.withColumn("reason", F.when(F.col("ticket_id") != "k2", "a")).withColumn("run", F.when(F.col("ticket_id") == "k4", "r1"))
    assert rows(relations.gold_pairs(every, w2, k2).select("window_id", "issue_id")) == [("w1", "k1"), ("w2", "k1")]
    assert rows(relations.gold_counts(w2, k2).select("window_id", "n_gold")) == [("w1", 1), ("w2", 1), ("w3", 0), ("w4", 0)]
    d = spark.createDataFrame([("e", "s", 1, "pre", 5.0), ("e", "s", 2, "pre", 7.0), ("e", "s", 3, "act", 9.0), ("x", "s", 1, "act", 3.0), ("e", "s", 4, "act", None)], "e string, s string, t int, p string, f double")
    got = relations.baseline_deltas(d, ["e", "s"], ["t"], F.col("p") == "pre", ["f"])
    assert rows(got.select("e", "t", "f_delta")) == [("e", 1, 0.0), ("e", 2, 0.0), ("e", 3, 2.0), ("e", 4, -7.0), ("x", 1, 0.0)]


def test_curves(spark):
    df = spark.createDataFrame([("g", 0.9, True), ("g", 0.9, False), ("g", 0.5, True), ("g", 0.1, False), ("one", 0.5, True), ("g", None, True)], "g string, s double, y boolean")
    got = {r.g: r for r in metrics.curve_areas(metrics.score_counts(df, ["g"], "s", F.col("y")), ["g"], "s").collect()}
    assert got["g"].pr_auc == pytest.approx(0.5 * 0.5 + 2 / 3 * 0.5, abs=1e-6)
    assert got["g"].roc_auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert got["one"].roc_auc == 0.0 and got["one"].pr_auc == 1.0


def test_constant_scores_give_the_base_rate(spark):
    df = spark.createDataFrame([("g", 0.5, i < 3) for i in range(10)], "g string, s double, y boolean")
    r = metrics.curve_areas(metrics.score_counts(df, ["g"], "s", F.col("y")), ["g"], "s").first()
    assert (r.pr_auc, r.roc_auc) == (0.3, 0.5)


def test_retrieval(spark):
    ranked = spark.createDataFrame([("p", "q1", x, i) for i, x in enumerate("ABCDE", 1)] + [("p", "q2", x, i) for i, x in enumerate("XYAZW", 1)] + [("r", "q1", "A", 1)], "p string, q string, d string, k int")
    gold = spark.createDataFrame([("q1", "A"), ("q2", "A"), ("q2", "A"), ("q3", "A")], "q string, d string")
    gold = gold.distinct()
    hits, numbers = ranked.join(gold, ["q", "d"]), gold.groupBy("q").agg(F.count(F.lit(1)).alias("n_gold"))
    got = {(r.p, r.q): r for r in metrics.retrieval_by_query(hits, numbers, ranked.select("p").distinct(), ["p"], "q", "k", (1, 3)).collect()}
    assert (got["p", "q1"].hit_1, got["p", "q2"].hit_1, got["p", "q2"].hit_3) == (True, False, True)
    assert got["p", "q2"].reciprocal_rank == pytest.approx(1 / 3) and got["r", "q2"].reciprocal_rank == 0.0
    assert len(got) == 6


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "n string, p double")
    got = {r.n: round(r.q_value, 6) for r in metrics.benjamini_hochberg(df, "p", ["n"]).collect()}
    assert got == {"a": 0.03, "c": 0.04, "b": 0.04}


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", f"k{i}", float(i % 2), float(i % 2)) for i in range(200)], "g string, k string, v double, w double")
    r = metrics.bootstrap_interval(df, ["g"], "k", "v", 100).first()
    assert r.low <= r.mean <= r.high and 0.3 < r.low and r.high < 0.7
    p = metrics.paired_bootstrap(df, "k", "v", "w", 50).first()
    assert (p.delta, p.low, p.high, p.p_value) == (0.0, 0.0, 0.0, 1.0)


def test_histogram_and_ranks(spark):
    inf = float("inf")
    b = spark.createDataFrame([("s", 10.0, 5), ("s", 20.0, 10), ("s", inf, 10), ("e", inf, 0), ("t", 10.0, 0), ("t", inf, 4)], "s string, le double, c bigint")
    got = {r.s: r.quantile for r in telemetry.histogram_quantile(b, ["s"], "le", "c", 0.75).collect()}
    assert got == {"s": 15.0, "e": None, "t": 10.0}
    v = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("g", None)], "g string, v double")
    assert telemetry.nearest_rank(v, ["g"], "v", 0.95).first().quantile == 10.0


def test_counter(spark):
    data = [(1, 5), (2, 9), (11, 12), (12, 3), (25, 4)]
    got = telemetry.counter_increase(spark.createDataFrame([("k", t, float(v)) for t, v in data], "k string, t int, v double"), ["k"], ["t"], "v", F.floor(F.col("t") / 10))
    assert {r.bucket: r.increase for r in got.collect()} == {0: 4.0, 1: 6.0, 2: 1.0}


def test_allocation():
    assert telemetry.allocate({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, 60) == {"a": 50, "b": 10}
    assert sum(telemetry.allocate({"a": 7, "b": 7, "c": 7}, {"a": 1, "b": 1, "c": 1}, 10).values()) == 10
    assert telemetry.allocate({"a": 1}, {"a": 1.0}, 5) == {"a": 1}


STATES = [("w1", 1, "ticket_worthy", "T", "f", "active_fault"), ("w2", 2, "ticket_worthy", "T", "f", "active_fault"), ("w3", 3, "noise", None, "f", "recovery_window"), ("w4", 4, "ticket_worthy", "T", "f", "active_fault"), ("w5", 5, "ticket_worthy", None, "f", "active_fault"), ("w6", 6, "ticket_worthy", "T", "g", "active_fault"), ("w7", 7, "ticket_worthy", "T", "f", "active_fault")]


def test_suppression(spark):
    df = spark.createDataFrame([("s", *r) for r in STATES], "service string, window_id string, ts_us bigint, decision string, top1_match string, family string, window_type string")
    for width in (1, 100):
        got = {r.window_id: r.source_window for r in state.suppression(df, "service", ["ts_us"], F.floor(F.col("ts_us") / width)).collect() if r.suppressed}
        assert got == {"w2": "w1", "w7": "w4"}


def test_runs(spark):
    rnd = random.Random(2)
    data = [("k", i, rnd.choice(["a", "a", "a", "b", None])) for i in range(80)]
    df = spark.createDataFrame(data, "k string, t bigint, v string")
    want, i = [], 0
    while i < len(data):
        j = i
        while j < len(data) and data[j][2] == data[i][2]:
            j += 1
        want.append(("k", data[i][2], i, j - i))
        i = j
    for width in (1, 7, 1000):
        assert rows(state.runs(df, ["k"], ["t"], "v", F.floor(F.col("t") / width))) == sorted(want, key=str)


def test_dense_top(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(99, None)], "id bigint, v array<double>").withColumn("score", F.lit(7))
    got = search.dense_top(df.filter("id = 0"), df, "id", "v", 3).select("doc_id", "score").collect()
    assert [r.doc_id for r in got] == [3, 6, 9] and all(r.score == 1.0 for r in got)
    assert search.dense_top(df.limit(0), df, "id", "v", 3).count() == 0 and search.dense_top(df, df.limit(0), "id", "v", 3).count() == 0


@pytest.mark.parametrize("query_bytes", [200, 1 << 20])
def test_dense_top_mixed_vectors(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(search, "MAX_QUERY_BYTES", query_bytes)
    rnd = random.Random(4)
    data = [(i, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(rnd.choice([2, 2, 2, 3]))]) for i in range(60)] + [(60, [0.0, 0.0]), (61, []), (62, None), (63, [None, 1.0])]
    df = spark.createDataFrame(data, "id bigint, v array<double>")

    def cosine(x, y):
        x, y = ([0.0 if v is None else v for v in z] for z in (x, y))
        a, b = (sum(v * v for v in z) ** 0.5 for z in (x, y))
        return round(sum(v * w for v, w in zip(x, y, strict=True)) / (a * b), 9) + 0.0 if len(x) == len(y) and a and b else 0.0

    known = [(k, v) for k, v in data if v is not None]
    want = [(q, d, s, i) for q, v in known for i, (s, d) in enumerate(((-s, d) for s, d in sorted((-cosine(v, w), d) for d, w in known if d != q)[:4]), 1)]
    got = [(r.query_id, r.doc_id, round(r.score, 9) + 0.0, r.rank_no) for r in search.dense_top(df, df, "id", "v", 4).collect()]
    assert sorted(got) == sorted(want)


def test_dense_cells_recall(spark, monkeypatch):
    rnd = random.Random(5)
    centers = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    data = [(i, [x + rnd.gauss(0, 0.5) for x in centers[rnd.randrange(30)]]) for i in range(1500)] + [(5000 + i, [1.0] * 16) for i in range(700)]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    monkeypatch.setattr(search, "CELL_ROWS", 200)
    asked = df.filter("id % 20 = 0")
    exact = {(r.query_id, r.doc_id) for r in search.dense_top(asked, df, "id", "v", 5).collect()}
    found = {(r.query_id, r.doc_id) for r in search.dense_cells(asked, df, "id", "v", 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert search.dense_cells(asked, df.limit(0), "id", "v", 5).count() == 0


def test_rrf_ties(spark):
    df = spark.createDataFrame([("w", "a", "x", 1), ("w", "b", "y", 1)], "w string, s string, d string, r int")
    got = {r.d: (round(r.score, 6), r.first_source) for r in rank.rrf(df, ["w"], "d", "s", "r").collect()}
    assert got == {"x": (round(1 / 61, 6), "a"), "y": (round(1 / 61, 6), "b")}


def test_entity_top_equals_brute(spark, monkeypatch):
    rnd = random.Random(8)
    kinds = {"service": "s", "error": "e"}
    weights = {"service": 2.0, "error": 3.0}

    def side(prefix, n):
        values = lambda: rnd.choice([None, [], [rnd.choice(["A ", "a", "b", "c", None, "", "hot"]) for _ in range(4)]])
        return [(f"{prefix}{i:02}", rnd.choice([None, "minor", "major"]), rnd.choice([None, "f", "g"]), rnd.choice([None, *range(20)]), values(), values()) for i in range(n)]

    left, right = side("l", 40), side("r", 50)
    schema = "id string, severity string, family string, t bigint, s array<string>, e array<string>"
    frames = [relations.entity_records(spark.createDataFrame(x + x[:5], schema).withColumnRenamed("id", "key"), "key", kinds, weights) for x in (left, right)]
    items = lambda r: {(k, v.strip().lower()) for k, c in (("service", r[4]), ("error", r[5])) for v in c or [] if v and v.strip()}
    for postings, first in ((20, 1), (8_000_000, 1), (8_000_000, 4096)):
        monkeypatch.setattr(search, "MAX_POSTINGS", postings)
        monkeypatch.setattr(search, "FIRST_POSTINGS", first)
        got = search.entity_top(*frames, 3, severity=0.5, family=1.0, earlier=True)
        want = []
        for x in left:
            found = []
            for y in right:
                shared = items(x) & items(y)
                if shared and x[3] is not None and y[3] is not None and y[3] < x[3]:
                    score = sum(weights[k] for k, _ in shared) + 0.5 * (x[1] is not None and x[1] == y[1]) + (x[2] is not None and x[2] == y[2])
                    found.append((-score, y[0], len(shared)))
            want += [(x[0], i, -s, n, k) for k, (s, i, n) in enumerate(sorted(found)[:3], 1)]
        assert rows(got.select("left_id", "right_id", "score", "n_shared", "rank_no")) == sorted(want, key=str)


@pytest.mark.parametrize("postings", [40, 8_000_000])
def test_sparse_top_equals_brute(spark, monkeypatch, postings):
    """Signed weights, long and short lists, ties, own ids, blocks: every score as the plain sum gives it."""
    monkeypatch.setattr(search, "MAX_POSTINGS", postings)
    rnd = random.Random(12)
    make = lambda n: {f"r{i:02}": {x: float(rnd.randint(-2, 3)) for x in rnd.sample(["hot", "warm", *map(str, range(12))], rnd.randint(0, 6))} | {"hot": 1.0} for i in range(n)}
    left, right = make(30), make(60)
    schema = "id string, items array<struct<item string, w double>>"
    frame = lambda side: spark.createDataFrame([(k, list(v.items())) for k, v in side.items()] + [(None, [("hot", 1.0)])], schema)
    want = []
    for k, x in left.items():
        found = sorted((-sum(w * y[i] for i, w in x.items() if i in y), d) for d, y in right.items() if d != k and set(x) & set(y))[:4]
        want += [(k, d, -s + 0.0, n) for n, (s, d) in enumerate(found, 1)]
    got = search.sparse_top(frame(left), frame(right), 4, with_self=False)
    assert sorted((r.left_id, r.right_id, r.score + 0.0, r.rank_no) for r in got.collect()) == sorted(want)
    # The same in one process, where the bound is looked at after the first list.
    monkeypatch.setattr(search, "FIRST_POSTINGS", 1)
    index = search.Index(frame(right).filter("id is not null").selectExpr("id", "cast(null as bigint) t", "cast(null as bigint) severity", "cast(null as bigint) family", "transform(items, x -> xxhash64(x.item)) items", "transform(items, x -> x.w) weights").toArrow())
    for r in frame(left).filter("id is not null").selectExpr("id", "transform(items, x -> xxhash64(x.item)) i", "transform(items, x -> x.w) w").collect():
        doc, s, _ = index.best(np.array(r.i), np.array(r.w), r.id, None, None, None, 4, 6, (0.0, 0.0), False, False)
        assert [(r.id, index.ids[d], v + 0.0, n) for n, (d, v) in enumerate(zip(doc, s, strict=True), 1)] == [w for w in want if w[0] == r.id]


def test_sparse_top_empty(spark):
    df = spark.createDataFrame([("a", [("x", 1.0)]), ("b", None), ("c", [])], "id string, items array<struct<item string, w double>>").withColumn("score", F.lit(1))
    assert rows(search.sparse_top(df, df, 2).select("left_id", "right_id")) == [("a", "a")]
    assert search.sparse_top(df.limit(0), df, 2).count() == 0 and search.sparse_top(df, df.limit(0), 2).count() == 0


def test_gold_counts_equal_pairs(spark):
    rnd = random.Random(21)
    day = 86_400_000_000
    w = spark.createDataFrame([(f"w{i}", rnd.choice(["f", "f", "g", None]), rnd.choice(["s", "t", None]), rnd.choice([None, rnd.randint(0, 3 * day)])) for i in range(60)], "window_id string, family string, service string, start_us bigint")
    k = spark.createDataFrame([(f"k{i:02}", rnd.choice(["f", "g", None]), rnd.choice([None, [], ["s"], ["s", "t", "s"]]), rnd.choice([None, rnd.randint(0, 3 * day)])) for i in range(40)], "ticket_id string, family string, services array<string>, ts_us bigint")
    every = w.select("window_id").crossJoin(k.select(F.col("ticket_id").alias("issue_id")))
    found = relations.gold_pairs(every, w, k).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("issue_id").alias("a"), F.max("issue_id").alias("b"))
    assert rows(relations.gold_counts(w, k).filter("n_gold > 0")) == rows(found)


def test_quantiles(spark):
    rnd = random.Random(3)
    data = [(g, rnd.choice([None, 5.0, rnd.random() * 100])) for g in ("a", "a", "b", None) for _ in range(80)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("n", F.lit("x"))
    got = {r.g: (r.p50, r.p95) for r in telemetry.quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in data if k == g and x is not None]
        assert got[g] == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.95)))
    assert "none" not in got and telemetry.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("digits", [1, 3])
def test_hashed_numbers(spark, digits):
    df = spark.createDataFrame([(g, f"k{i}") for g in ("a", None) for i in range(50)], "g string, k string").withColumn("n", F.lit(1))
    r = sorted(telemetry.hashed_numbers(df, ["g"], "k", "7", digits).collect(), key=lambda r: (r.g or "", r.place))
    import hashlib

    for g in ("a", None):
        here = [x for x in r if x.g == g]
        assert [x.place for x in here] == list(range(1, 51)) and all(x.of == 50 for x in here)
        digest = [hashlib.md5(f"7|{x.k}".encode()).hexdigest() for x in here]
        assert digest == sorted(digest)


@pytest.mark.parametrize("limit", [2, 1000])
def test_self_pairs(spark, limit):
    rnd = random.Random(6)
    data = [(rnd.choice(["hot", "hot", "a", None]), f"i{rnd.randint(0, 30):02}") for _ in range(80)]
    df = spark.createDataFrame(data, "k string, id string").distinct()
    got = rows(skew.self_pairs(df, ["k"], "id", limit))
    every = set(data)
    assert got == sorted({(k, a, b) for k, a in every for j, b in every if k == j and k is not None and a < b})


@pytest.mark.parametrize("width", [3, 1000])
def test_recent_others(spark, width):
    rnd = random.Random(width)
    data = [(rnd.choice(["s", "s", "t"]), f"w{i:03}", rnd.choice(["e1", "e1", "e1", "e2", "e3", "e4", None]), rnd.randint(0, 60)) for i in range(150)]
    df = spark.createDataFrame(data, "k string, id string, owner string, t bigint").withColumn("place", F.lit(0))
    want = []
    for k, i, e, t in data:
        found = sorted((-t2, j) for k2, j, e2, t2 in data if k2 == k and t2 < t and e2 != e)[:3]
        want += [(i, j, n) for n, (_, j) in enumerate(found, 1)]
    got = asof.recent_others(df, ["k"], "id", "owner", "t", 3, F.floor(F.col("t") / width))
    assert rows(got) == sorted(want, key=str)


def test_jaccard_top(spark, monkeypatch):
    rnd = random.Random(2)
    data = [(f"r{i:02}", rnd.choice(["f", "f", "g"]), rnd.choice([None, *range(9)]), rnd.sample([f"w{j}" for j in range(12)], rnd.randint(0, 7))) for i in range(60)]
    df = spark.createDataFrame(data, "id string, family string, t bigint, ws array<string>")
    want = []
    for i, f, t, x in data:
        found = sorted((-round(len(set(x) & set(y)) / len(set(x) | set(y)), 6), j) for j, g, u, y in data if g == f and t is not None and u is not None and u < t and set(x) & set(y))
        want += [(i, j, -s, n) for n, (s, j) in enumerate([p for p in found if -p[0] >= 0.3][:2], 1)]
    for first in (1, 4096):
        monkeypatch.setattr(search, "FIRST_POSTINGS", first)
        got = search.jaccard_top(df, df, F.col("ws"), F.col("ws"), 2, 0.3, within="family", earlier=True)
        assert rows(got.select("left_id", "right_id", "score", "rank_no")) == sorted(want, key=str)


def test_own_candidates_equal_brute(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(["pool", "disk", "cache", "probe", "queue", f"w{rnd.randint(0, 9)}x"]) for _ in range(rnd.randint(0, n)))
    docs = {f"d{i}": text(6) for i in range(12)}
    asked = {f"q{i}": (text(8), text(2), i % 2 == 0) for i in range(40)} | {"none": (None, None, False)}
    pairs = [(q, d) for q in asked for d in docs if rnd.random() < 0.4]
    k, q = spark.createDataFrame(list(docs.items()), "d string, text string"), spark.createDataFrame([(i, *x) for i, x in asked.items()], "q string, a string, b string, even boolean")
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a query's documents lie in several batches
    try:
        got = {(r.q, r.d): (r.even, r.score_0, r.score_1) for r in search.own_candidates(spark.createDataFrame(pairs, "q string, d string"), q, k, "q", "d", [words("a"), words("b")], words("text"), ["even"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, (a, b, even) in asked.items():
        own = {d: docs[d].split() for p, d in pairs if p == i and docs[d]}
        mean = sum(map(len, own.values())) / max(1, len(own))
        for d, ws in own.items():
            idf = {w: np.log((len(own) - n + 0.5) / (n + 0.5) + 1) for w in ws for n in [sum(w in x for x in own.values())]}
            s = [sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in (t or "").split() if w in ws) if set((t or "").split()) & set(ws) else None for t in (a, b)]
            if s != [None, None]:
                want[i, d] = even, *[None if x is None else pytest.approx(x) for x in s]
    assert len(want) > 50 and got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_signature_takes_no_pair_apart(spark):
    """The hits are read once for both scores, pairs stay rows of their own, and nothing that grows is broadcast."""
    plan = further.r5_signature(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hits.parquet") == 1 and plan.count("Exchange ") <= 12
    assert "Generate" not in plan and "BroadcastExchange" not in plan
