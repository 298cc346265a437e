"""Operators of the training-data problems against brute force, and their edge cases."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")

from tidemark.llm import bpe, leakage, overlap, queries, runs, setjoin, spam, splits, topn  # noqa: E402


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1. Splits that keep related records together


def records(spark, data):
    return spark.createDataFrame(data, "window_id string, fam string, inc string").withColumn("component", F.lit("x")).withColumn("node", F.lit(1))


def related(spark, data):
    df = records(spark, data)
    return dict(map(tuple, splits.related_groups(df, "window_id", [F.col("inc"), splits.family_key(F.col("fam"))]).collect()))


def test_related_groups(spark):
    got = related(spark, [("a", "Disk Full", None), ("b", "disk-full ", "i1"), ("c", None, "i1"), ("d", None, None), ("e", "x", None), ("e", "x", None), (None, "x", "i1"), ("f", "Disk__full", None)])
    assert len({got[k] for k in "abcf"}) == 1 and len(set(got.values())) == 3 and set(got) == set("abcdef")
    assert related(spark, []) == {}


def test_related_groups_random(spark):
    rnd = random.Random(4)
    data = [(f"w{rnd.randint(0, 150):03}", rnd.choice([None, *[f"f{i}" for i in range(60)]]), rnd.choice([None, *[f"i{i}" for i in range(90)]])) for _ in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for w, f, i in data:
        find(w)
        for e in (f, i):
            if e is not None:
                parent[find(e)] = find(w)
    want, got = defaultdict(set), defaultdict(set)
    for w, _, _ in data:
        want[find(w)].add(w)
    for w, c in related(spark, data).items():
        got[c].add(w)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_grouped_splits(spark):
    data = [(f"h{i:03}", "hot", None) for i in range(300)] + [(f"w{i:04}", f"f{i % 400}", None) for i in range(700)]
    got = splits.grouped_splits(records(spark, data), "window_id", [F.col("inc"), F.col("fam")]).collect()
    assert len(got) == 1000
    by = defaultdict(set)
    share = defaultdict(int)
    for r in got:
        by[r.group_key].add(r.split)
        share[r.split] += 1
    assert all(len(s) == 1 for s in by.values()) and len({r.split for r in got if r.window_id[0] == "h"}) == 1
    assert abs(share["train"] - 700) < 60 and abs(share["validation"] - 150) < 50 and abs(share["test"] - 150) < 50


def test_manifest_and_torn(spark):
    m = spark.createDataFrame([("r", 1, {"a": "train", "b": "test"}), ("r", 2, {"a": " TRAIN", "b": "Val", "z": "odd"}), ("r", 2, {"a": " TRAIN", "b": "Val", "z": "odd"}), (None, None, {"c": "test"}), ("q", 1, None)], "dataset_run_id string, generated_at int, window_assignment map<string,string>")
    assigned = splits.assigned_windows(m)
    assert rows(assigned) == [("a", "train"), ("b", "validation"), ("c", "test")]
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("0", "g"), ("c", "h")], "window_id string, component string")
    assert rows(splits.torn_groups(groups, assigned, "window_id")) == [("0", "train"), ("0", "validation")]


# 2. Similar pairs between set-valued records


def set_pairs(sets, t=0.7, least=5):
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    return sorted((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)


def test_t_occurrence():
    rnd = random.Random(1)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(30), rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9))]
        t = rnd.randint(1, 6)
        want = sorted((i, n) for i in range(30) if (n := sum(i in x for x in lists)) >= t)
        assert sorted(setjoin.t_occurrence(lists, t)) == want


@pytest.mark.parametrize(("block", "copies"), [(2, 0), (2000, 200_000)])
def test_similar_sets(spark, monkeypatch, block, copies):
    monkeypatch.setattr(setjoin, "MAX_COPIED", copies)
    monkeypatch.setattr(setjoin, "MAX_BROADCAST_PAIRS", copies)
    rnd = random.Random(block)
    sets = {}
    for i in range(120):
        base = rnd.choice(list(sets.values())) if sets and rnd.random() < 0.6 else {f"x{rnd.randint(0, 80)}" for _ in range(rnd.randint(2, 12))}
        sets[f"r{i:03}"] = (base - {rnd.choice(sorted(base) or ["x0"])} | ({f"x{rnd.randint(0, 80)}"} if rnd.random() < 0.5 else set())) if rnd.random() < 0.7 else set(base)
    data = [(k, sorted(v)) for k, v in sets.items()]
    df = spark.createDataFrame([*data, *data[:20], (None, ["a"] * 6), ("null", None), ("empty", [])], "id string, items array<string>").withColumn("rep", F.lit(1))
    assert rows(setjoin.id_pairs(*setjoin.similar_sets(df, list_block=block))) == set_pairs(sets)


def test_item_set(spark):
    df = spark.createDataFrame([(["A ", "a", None, " "], None, ["a"]), (None, None, None)], "c array<string>, s array<string>, e array<string>")
    assert [r[0] for r in df.select(setjoin.item_set([("c", "c"), ("s", "s"), ("e", "e")])).collect()] == [["c:a", "e:a"], []]


def test_hashed_sets_are_item_sets(spark):
    values = [None, "", " ", "a", "A ", "\u00a0a\u3000", "\x1fa", "É", "e\u0301", "İx", "b"]
    rnd = random.Random(3)
    pick = lambda: rnd.choice([None, [], [rnd.choice(values) for _ in range(5)]])
    df = spark.createDataFrame([(str(i), pick(), pick(), pick()) for i in range(60)], "id string, c array<string>, s array<string>, e array<string>")
    fields = [("c", "c"), ("s", "s"), ("e", "e")]
    named = {r.id: r["items"] for r in df.select("id", setjoin.item_set(fields).alias("items")).collect()}
    hashed = {r.id: r["items"] for r in setjoin.hashed_sets(df, "id", fields).collect()}
    code = {}
    for k, items in named.items():
        assert len(items) == len(hashed[k])
        for x in items:
            code.setdefault(x, set(hashed[k])).intersection_update(hashed[k])
    assert all(code.values())


def test_no_sets(spark):
    members, pairs = setjoin.similar_sets(spark.createDataFrame([], "id string, items array<string>"))
    assert members.count() == 0 and pairs.count() == 0


# 3. Top N of every group


def test_top_n(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["hot"] * 6 + [f"g{i}" for i in range(30)] + [None]), rnd.choice(["p", "q"]), rnd.choice([None, *[f"t{i}" for i in range(40)]]), rnd.choice([None, float("nan"), float("inf"), *[float(x) for x in range(-5, 6)]])) for _ in range(1500)]
    df = spark.createDataFrame(data, "g string, p string, item string, s double").withColumn("rank_no", F.lit(0)).withColumn("_score", F.lit(1.0))
    best = defaultdict(dict)
    for g, p, i, s in data:
        if i is not None and s is not None and not math.isnan(s):
            best[g, p][i] = max(s, best[g, p].get(i, -math.inf))
    want = [(g, p, k, i, s) for (g, p), d in best.items() for k, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    for scale in (None, "p"):
        assert rows(topn.top_n(df, ["g", "p"], "item", "s", 5, scale)) == sorted(want, key=str)
    assert topn.top_n(df.limit(0), ["g", "p"], "item", "s").count() == 0


# 5. Same or near-same records across splits


def test_cross_side(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(90):
        base = rnd.choice(list(texts.values())).split() if texts and rnd.random() < 0.6 else [rnd.choice(words) for _ in range(rnd.randint(10, 45))]
        base = [rnd.choice(words) if rnd.random() < 0.05 else w for w in base]
        texts[f"r{i:02}"] = " ".join(base)
    sides = {k: rnd.random() < 0.4 for k in texts}
    sides.pop("r05")
    t = spark.createDataFrame([*texts.items(), *list(texts.items())[:9], (None, "x"), ("n", None), ("e", "")], "id string, text string")
    s = spark.createDataFrame([*sides.items(), ("n", True), ("ghost", False)], "id string, is_eval boolean")
    grams = {}
    for k, x in texts.items():
        ws = x.split()
        if len(ws) >= 20 and k in sides:
            grams[k] = set(zip(ws, ws[1:], ws[2:], strict=False))
    want = sorted((a, b) for a in grams for b in grams if sides[a] and not sides[b] and len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b]) - 1e-9)
    got = overlap.record_pairs(*overlap.cross_side_classes(t, s))
    assert rows(got.select("eval_id", "train_id")) == want and want


def test_cross_side_many_copies(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MAX_COPIED", 0)
    monkeypatch.setattr(overlap, "MAX_BROADCAST_PAIRS", 0)
    text = " ".join(f"w{i}" for i in range(30))
    t = spark.createDataFrame([(f"c{i}", text) for i in range(12)] + [("v", text + " more words")], "id string, text string")
    s = spark.createDataFrame([(f"c{i}", i < 4) for i in range(12)] + [("v", False)], "id string, is_eval boolean")
    assert overlap.record_pairs(*overlap.cross_side_classes(t, s)).count() == 4 * 8 + 4
    members, pairs = overlap.cross_side_classes(t.limit(0), s)
    assert members.count() == 0 and pairs.count() == 0


def test_evidence():
    assert overlap.evidence("WINDOW a\nKeep\nWINDOW b\r\nx WINDOW y") == "\nkeep\n\r\nx window y"
    assert overlap.evidence(None) is None and overlap.words("a_b-c Ä1") == ["a", "b", "c", "Ä1"] and overlap.words("a_b-c d1") == ["a", "b", "c", "d1"]


# 7. Repeated consecutive events


def piece(i, sig, n=1, tokens=None):
    return runs.Piece(i, i, 0, i, i, n, sig, frozenset(tokens) if tokens else None)


def brute_cost(chain, penalty):
    reps = {p.sig: p for p in chain}.values()
    cost = lambda part: min(sum(runs.dissimilarity(r, x) * x.n for x in part) for r in reps)
    best = [0.0]
    for s in range(1, len(chain) + 1):
        best.append(min(best[t] + cost(chain[t:s]) + penalty for t in range(s)))
    return best[-1], cost


def test_segmentation_is_optimal():
    rnd = random.Random(9)
    for _ in range(150):
        kinds = [frozenset(rnd.sample(range(8), rnd.randint(2, 6))) for _ in range(5)]
        chain = [piece(i, (k := rnd.randrange(5)), rnd.randint(1, 3), kinds[k]) for i in range(rnd.randint(1, 14))]
        penalty = rnd.choice([0.1, 0.4, 1.0])
        found = runs.segment(chain, penalty)
        best, cost = brute_cost(chain, penalty)
        assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(chain)
        assert sum(cost(chain[a:b]) + penalty for a, b in found) == pytest.approx(best)


def test_equal_segments_are_those_of_the_recursion():
    """The comparison of neighbours gives what the dynamic programming gives over whole sequences, for any penalty below a half."""
    rnd = random.Random(10)
    for _ in range(200):
        sig = [rnd.choice([1, 1, 2, 3]) for _ in range(rnd.randint(1, 25))]
        chain = [piece(i, s) for i, s in enumerate(sig)]
        found = runs.segment(chain, rnd.choice([0.1, 0.25, 0.45]))
        first = np.zeros(len(sig), dtype=bool)
        first[0] = True
        assert [a for a, _ in found] == runs.equal_segments(np.array(sig), first).tolist()


def test_recursion_by_events_equals_segment():
    rnd = random.Random(12)
    for _ in range(300):
        chain = [piece(i, rnd.choice([1, 1, 2, 3]), rnd.choice([1, 1, 2])) for i in range(rnd.randint(1, 25))]
        penalty = rnd.choice([0.25, 0.4, 0.75, 1.5, 3.0])
        recursion, half = runs.Recursion(penalty), rnd.randint(0, len(chain))
        got = [*recursion.take(chain[:half]), *recursion.take(chain[half:]), *recursion.end()]
        want = [(chain[a].at, chain[b - 1].t_last, sum(p.n for p in chain[a:b])) for a, b in runs.segment(chain, penalty)]
        assert [(p.at, p.t_last, p.n) for p in got] == want


def test_every_event_goes_through_the_recursion(monkeypatch):
    """Without tokens too: runs of a block come from the recursion over its events, not from a comparison of neighbours."""
    import pyarrow as pa

    taken, take = [], runs.Recursion.take
    monkeypatch.setattr(runs, "equal_segments", None)
    monkeypatch.setattr(runs.Recursion, "take", lambda self, events: take(self, [taken.append(e[0]) or e for e in events]))
    rnd = random.Random(13)
    data = sorted((rnd.choice("ab"), rnd.randint(0, 2), i, rnd.choice([1, 1, 2])) for i in range(300))
    table = pa.table({"id": [x[0] for x in data], "block": [x[1] for x in data], "long": [False] * 300, "pos": [x[2] for x in data], "at": [x[2] for x in data], "at2": [0] * 300, "t": [x[2] for x in data], "sig": [x[3] for x in data]})
    got = [r for b in runs._collapse(iter(table.to_batches(max_chunksize=7)), ["id"], False, 0.25, 1) for r in b.to_pylist()]
    want = [list(g) for _, g in itertools.groupby(data, key=lambda x: (x[0], x[1], x[3]))]
    assert taken == [x[2] for x in data]
    assert [(r["id"], r["block"], r["first_pos"], r["t_last"], r["n"]) for r in got] == [(*g[0][:3], g[-1][2], len(g)) for g in want]


def test_blocks_by_rows(spark):
    """A sequence is cut into as many blocks as its rows need, dense stretches again."""
    data = [("hot", i) for i in range(3000)] + [("hot", 10**15 + i) for i in range(3000)] + [("short", i) for i in range(9)]
    df = spark.createDataFrame(data, "id string, at bigint")
    blocked = runs._blocked(df, runs.long_sequences(df, ["id"], "at", 100), ["id"])
    sizes = {(r["id"], r["block"]): r["count"] for r in blocked.groupBy("id", "block").count().collect()}
    assert sizes["short", 0] == 9 and len(sizes) > 20 and max(n for (k, _), n in sizes.items() if k == "hot") <= 300
    order = [r.block for r in blocked.filter("id = 'hot'").orderBy("at").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("block_rows", [3, 1000])
@pytest.mark.parametrize("with_tokens", [False, True])
def test_collapse_runs(spark, block_rows, with_tokens):
    rnd = random.Random(block_rows)
    data = [("k", rnd.choice(["hot", "hot", "a", "b"]), i, rnd.randint(0, 50), i, rnd.randint(0, 99), rnd.choice([1, 1, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(data, "kind string, id string, pos bigint, at bigint, at2 bigint, t bigint, sig bigint").withColumn("tokens", F.array("sig").cast("array<bigint>")).withColumn("block", F.lit(1))
    want = []
    for k in ("hot", "a", "b"):
        seq = sorted((r for r in data if r[1] == k), key=lambda r: (r[3], r[4]))
        i = 0
        while i < len(seq):
            j = i
            while j + 1 < len(seq) and seq[j + 1][6] == seq[i][6]:
                j += 1
            want.append(("k", k, seq[i][2], j - i + 1, seq[i][5], seq[j][5]))
            i = j + 1
    long = runs.long_sequences(df, ["kind", "id"], "at", block_rows)
    got = runs.collapse_runs(df, ["kind", "id"], long, with_tokens=with_tokens)
    assert rows(got) == sorted(want, key=str)
    assert runs.collapse_runs(df.limit(0), ["kind", "id"], long).count() == 0


def test_near_equal_events_join(spark):
    data = [("k", i, i, 0, i, i % 2, [1, 2, 3, 4, 5 + i % 2]) for i in range(6)] + [("k", 6, 6, 0, 6, 9, [7, 8])]
    df = spark.createDataFrame(data, "id string, pos bigint, at bigint, at2 bigint, t bigint, sig bigint, tokens array<bigint>")
    got = runs.collapse_runs(df, ["id"], runs.long_sequences(df, ["id"], "at"), penalty=2.0, with_tokens=True)
    assert rows(got.select("first_pos", "n_events", "t_first", "t_last")) == [(0, 6, 0, 5), (6, 1, 6, 6)]


def test_near_runs_of_events(spark, tmp_path):
    said = ["probe of cart api failed with no answer in time after retry one", "probe of cart api failed with no answer in time after retry two"]
    data = [("pod", f"{i}", i + 1, "Unhealthy", said[i % 2]) for i in range(6)] + [("pod", "6", 7, "Pulled", said[0]), ("pod", "7", 8, "Pulled", "image present"), ("other", "8", 9, "Pulled", "image present")]
    df = spark.createDataFrame(data, "object_name string, uid string, ts_ns bigint, reason string, message string").withColumn("ts_ns", F.col("ts_ns") * 1000)
    df.withColumn("event_uid", F.col("uid").cast("bigint")).write.parquet(f"{tmp_path}/k8s_events.parquet")
    lines = [("s", i, f"2026-05-01T10:00:0{i}Z INFO [cart] {said[i % 2]}") for i in range(4)]
    schema = "stream_id string, line_no bigint, line string, service string, severity string, received_at timestamp"
    spark.createDataFrame([(*x, None, None, None) for x in lines], schema).write.parquet(f"{tmp_path}/log_lines.parquet")
    found = rows(queries.p7_near(spark, str(tmp_path)))
    assert ("k8s", "pod", 0, 6, 5) in found and len([r for r in found if r[0] == "k8s"]) == 1
    assert [r[2:4] for r in found if r[0] == "log"] == [(0, 4)]
    assert queries.p7_found(spark, str(tmp_path)).count() == 0


# 8. Token ids


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def test_token_ids(spark):
    texts = ["", None, "Hello world, it's 2026!", "<|endoftext|> is text", "naïve café \r\n\t ñ 漢字かな🚑🧯", "a" * 5000, "é́ é", "x" * 3 + " " * 700 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in bpe.token_ids(df, "doc_id").collect()}
    ref = reference()
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_random_pieces():
    ref, e, rnd = reference(), bpe.encoder(), random.Random(3)
    for _ in range(3000):
        alphabet = rnd.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "the in an er on", " -=", "éüñ漢字かな", "  \n\t", "\x00\x7f\x80"])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        ids = e.encode(text)
        assert ids == ref.encode_ordinary(text)
        assert b"".join(e.bytes[i] for i in ids).decode() == text


# 9. Leaking passages


def test_winnowing_keeps_every_window():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 50):
        h = rnd.integers(0, 2**63, n, dtype=np.uint64)
        kept = set(leakage.winnow(h, 7).tolist())
        assert all(kept & set(h[i : i + 7].tolist()) for i in range(max(0, n - 6)))


def test_leaked(spark):
    rnd = random.Random(6)
    vocabulary = [f"word{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60)))) for i in range(20)]
    docs, want = [], set()
    for d in range(80):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        i, text = rnd.choice(items)
        part, n = text.split(), rnd.choice([8, 11, 12, 20])
        at = rnd.randint(0, len(part))
        piece_ = part[at : at + n]
        ws[len(ws) // 2 : len(ws) // 2] = piece_
        docs.append((d, " ".join(ws).upper() if d % 3 else "<p>" + "</p> <b>".join(ws) + "</b>"))
    grams = defaultdict(set)
    for i, text in items:
        ws = text.split()
        for k in range(len(ws) - 11):
            grams[tuple(ws[k : k + 12])].add(i)
    for d, text in docs:
        ws = leakage.plain_words(text)
        for k in range(len(ws) - 11):
            want |= {(d, i) for i in grams.get(tuple(ws[k : k + 12]), ())}
    frames = spark.createDataFrame([*docs, *docs[:5], (98, None), (None, docs[0][1]), (99, "")], "doc_id bigint, text string"), spark.createDataFrame([*items, (77, None), (78, "")], "item_id bigint, text string").withColumn("print", F.lit(1))
    got = leakage.leaked_passages(*frames)
    assert set(map(tuple, got.select("doc_id", "item_id").collect())) == want and got.count() == len(want) and want
    assert leakage.leaked_passages(frames[0].limit(0), frames[1]).count() == 0
    assert leakage.leaked_passages(frames[0], frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("limits", [("MAX_PASSAGE_CHARS",), ("MAX_PASSAGE_CHARS", "MAX_BROADCAST")])
def test_leaked_by_joins(spark, monkeypatch, limits):
    """The ways beyond the limits of what is sent, with many items too short for a hash, equal ids and several passages of an item."""
    for name in limits:
        monkeypatch.setattr(leakage, name, 0)
    ws = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(ws)), (1, " ".join(ws[5:20])), (2, " ".join(ws[:11])), (3, " ".join(ws[20:34]))], "doc_id bigint, text string")
    short = [(100 + i, " ".join(ws[i % 30 : i % 30 + 5])) for i in range(3000)]
    items = spark.createDataFrame([(1, " ".join(ws[:15])), (1, " ".join(ws[18:])), (2, " ".join(ws[20:33])), *short], "item_id bigint, text string")
    assert rows(leakage.leaked_passages(docs, items)) == [(1, 1, 22, 22), (1, 2, 13, 13), (3, 1, 14, 22), (3, 2, 13, 13)]


def test_only_passages_with_hits_are_sent(spark):
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, text)], "item_id bigint, text string").unionByName(spark.range(100_000).select((F.col("id") + 10).alias("item_id"), F.lit("a few words only").alias("text")))
    plan = leakage.leaked_passages(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items)
    assert rows(plan) == [(1, 1, 20, 20)] and "a few words" not in plan._jdf.queryExecution().toString()


def test_plain_words():
    assert leakage.plain_words("Ｆｕｌｌ​wi­dth <br/>ﬁne <!-- x --> a<b") == ["fullwidth", "fine", "a", "b"]
    assert leakage.plain_words(None) == []


# 10. Stuffed pages

SENTENCES = "The dashboard showed a slow rise of the error rate on the node, which turned out to be a stale cache. We traced it to a limit that was copied from staging. After an hour the team rolled back the release and the queue drained. "
STUFFED = [
    "\n".join(f"cheap dns monitor {a} {b}" for a in ("north", "south", "east", "west") for b in ("harbor", "river", "hill")),
    ", ".join(["secure log search", "free incident bot", "cheap tracing"] * 20),
    " ".join(f"#freetag{i}" for i in range(40)),
    "\n".join(f"- [log search {i}](https://a.test/x-{i})" for i in range(20)),
    "".join(f'<li><a href="https://a.test/{i}">free tracing</a></li>' for i in range(20)),
    "Buy log search. log search! Best log search. log search 2026, cheap tracing near you. " * 8,
    "\n".join(f"SKU-{i} log search | tags: free tracing, incident bot, north | 9.99" for i in range(20)),
    "アラート おすすめ 無料\n" * 30,
]
CLEAN = [
    SENTENCES * 3,
    SENTENCES * 2 + "\n\nTags: cheap tracing, log search, incident bot",
    SENTENCES * 2 + "\nSee https://a.test/x and https://b.test/y for details.",
    "\n".join(f"0{i % 10}:15 config reloaded from revision 9c5050e4" for i in range(30)),
    "QuotaError: token rejected\n" + "\n".join(f"\tat demo.quota.reader(line {i})" for i in range(30)),
    "metric | before | after\n--- | --- | ---\n" + "\n".join(f"disk wait | {i} | {i * 7}" for i in range(20)),
    "voucher-proxy again",
    "ノードを再起動する前に、まずキャッシュを確認してください。原因は接続数の上限を下げた設定変更と思われる。" * 4,
]


def test_stuffed_pages(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(STUFFED)] + [(100 + i, t) for i, t in enumerate(CLEAN)] + [(200, None), (201, ""), (202, " \n "), (None, STUFFED[0])], "doc_id bigint, text string").withColumn("spam_share", F.lit("x"))
    got = [r.doc_id for r in spam.stuffed_pages(df, "doc_id").select("doc_id").collect()]
    assert sorted(got, key=str) == sorted([*range(len(STUFFED)), None], key=str)
    assert spam.page_shares(df, "doc_id").filter("spam_share is null").count() == 3
    assert spam.page_shares(df.limit(0), "doc_id").count() == 0


def test_repeated_lines_and_words(spark):
    kinds = "dns cache monitor incident rollback latency alert trace quota shard replica kafka pod ingress canary probe lease socket buffer queue".split()
    shuffled = kinds * 4
    random.Random(5).shuffle(shuffled)
    found = ["monitor\n" * 300, "\n".join(kinds[:4] * 10), " ".join(shuffled), "監視\n" * 60, "Überwachung\nStörung\nNetzwerk\n" * 20]
    clean = ["\n".join(kinds), SENTENCES * 3 + "\nmonitor" * 5, "\n".join(f"0{i % 10}:15 monitor" for i in range(60)), "\n".join(f"0{i % 10}:15 {a}" for i, a in enumerate(shuffled)) + "\ncache probe\nqueue"]
    df = spark.createDataFrame(list(enumerate(found)) + [(100 + i, t) for i, t in enumerate(clean)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.stuffed_pages(df, "doc_id").collect()) == list(range(len(found)))


def test_short_pages_of_links_and_tags(spark):
    texts = ["#dns #cache #free #bot #log", "https://a.test/x\nhttps://b.test/y", "[log search](https://a.test)", "restart https://a.test after the weekly review", "voucher-proxy again", "fix #12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.stuffed_pages(df, "doc_id").collect()) == [0, 1, 2]


def test_early_answers_are_those_of_whole_texts():
    rnd = random.Random(8)
    lines = [x for t in [*STUFFED, *CLEAN] for x in t.split("\n")[:6]] + ["see www.a.test, x<b>y</b>z#tag and https://b.test/c?d=e", "#a #b", "[one](two) three"]
    for _ in range(400):
        text = "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12)))
        whole, early = spam.shares(text, {}), spam.shares(text, {}, 0.5)
        over = whole.n_words > 0 and whole.link_words + whole.tag_words + whole.keyword_words > 0.5 * whole.n_words
        assert over == (early is not None and early.link_words + early.tag_words + early.keyword_words > 0.5 * early.n_words)


def test_other_scripts_need_repetition(spark):
    prose = ["Кошка, собака, мышь, слон, лиса и волк пришли домой, а потом, как всегда, легли спать. ", "猫、狗、鸟、鱼、马都来了，然后回家了。", "Η γάτα, ο σκύλος, το άλογο, η αλεπού και ο λύκος γύρισαν σπίτι. "]
    stuffed = ["дешёвый мониторинг логов " * 40, "便宜监控 " * 60]
    df = spark.createDataFrame(list(enumerate(stuffed)) + [(100 + i, t * 3) for i, t in enumerate(prose)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.stuffed_pages(df, "doc_id").collect()) == [0, 1]


def test_short_keyword_pages(spark):
    df = spark.createDataFrame([(0, "dns, cache, dns, cache, dns, cache"), (1, "n/a"), (2, "+1")], "doc_id bigint, text string")
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id").collect()] == [0]


def test_very_long_texts():
    e = bpe.encoder()
    for text in ("a" * 10**5, "[" * 10**5, "<a " * 10**5, "<!--" * 10**5, "word " * 10**5, " " * 10**5, "#x " * 10**5, "x\n" * 10**5, "あ" * 10**5, "[](" * 10**5):
        assert spam.shares(text, {}).n_words >= 0
        assert len(leakage.plain_words(text)) >= 0 and len(e.encode(text)) > 0


def test_trimmed_and_families(spark):
    df = spark.createDataFrame([(" \t Volume  starvation_-00744 ",), ("",), (None,), (" " * 50_000 + "x",)], "f string")
    assert [r[0] for r in df.select(splits.family_key(F.col("f"))).collect()] == ["volume-starvation-00744", "", None, "x"]
