"""Queries of ranking and fusion. Searches take every twentieth record as a query, against all records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import rank as R
from tidemark.operators import search as N
from tidemark.operators.relations import entity_records, entity_rows, gold_pairs, top_rows
from tidemark.plans import views as V
from tidemark.plans.joins import FIELDS, WEIGHTS
from tidemark.tables import table


def _tickets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = V.tickets(spark, sf_dir).select("ticket_id", "ts_us", F.concat_ws(" ", "root_cause", "fix").alias("t"))
    asked = k.filter(F.pmod(F.regexp_extract("ticket_id", r"(\d+)$", 1).cast("bigint"), F.lit(20)) == 0)
    return asked.select(F.col("ticket_id").alias("query_id"), F.col("ts_us").alias("q_us"), F.col("t").alias("q")), k


def _texts(found: DataFrame) -> DataFrame:
    return found.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("ticket_id"), "score", "rank_no")


def r1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best tickets by BM25 for every twentieth ticket, itself left out."""
    q, k = _tickets(spark, sf_dir)
    return _texts(N.bm25_top(q, k, "query_id", "ticket_id", T.words_b(F.col("q")), T.words_b(F.col("t")), 5))


def r2_bm25_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among tickets that were there before: the time is applied before the cut."""
    q, k = _tickets(spark, sf_dir)
    return _texts(N.bm25_top(q, k, "query_id", "ticket_id", T.words_b(F.col("q")), T.words_b(F.col("t")), 5, query_time="q_us", doc_time="ts_us", with_self=True))


def r3_bm25_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best other ticket's BM25 as a share of the greatest."""
    q, k = _tickets(spark, sf_dir)
    two = N.bm25_top(q, k, "query_id", "ticket_id", T.words_b(F.col("q")), T.words_b(F.col("t")), 2, places=9, with_self=True)
    # Of the two best at most one is the query itself.
    best = two.groupBy("left_id").agg(F.max("score").alias("peak"), F.max(F.when(F.col("left_id") != F.col("right_id"), F.col("score"))).alias("other"))
    return best.select(F.col("left_id").alias("query_id"), F.round(F.col("other") / F.col("peak"), 6).alias("share"))


def r6_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best tickets by TF-IDF cosine for every twentieth ticket, itself left out."""
    q, k = _tickets(spark, sf_dir)
    return _texts(N.tfidf_top(q, k, "query_id", "ticket_id", T.words_b(F.col("q")), T.words_b(F.col("t")), 5))


def r8_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors for every twentieth vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return N.dense_top(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5, places=6).select("query_id", "doc_id", "score", "rank_no")


def r8_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of cells (recall 0.9 or more, measured in the tests)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return N.dense_cells(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5, places=6)


def r10_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of all tickets in 64 dimensions."""
    k = V.tickets(spark, sf_dir).select("ticket_id", F.concat_ws(" ", "root_cause", "fix").alias("t"))
    return R.hashed_vectors(k, "ticket_id", T.words_a(F.col("t")), 64).select("ticket_id", "dim", F.round("value", 6).alias("value"))


def r11_sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best tickets by the dot product of hashed embeddings in 4096 dimensions, for every twentieth ticket."""
    q, k = _tickets(spark, sf_dir)
    a = R.hashed_vectors(q, "query_id", T.words_a(F.col("q")), 4096)
    b = R.hashed_vectors(k, "ticket_id", T.words_a(F.col("t")), 4096)
    items = lambda df, key: df.groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct(F.col("dim").cast("string").alias("item"), F.col("value").alias("w"))).alias("items"))
    return _texts(N.sparse_top(items(a, "query_id"), items(b, "ticket_id"), 5, with_self=False).filter("score > 0"))


def r12_entity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best visible tickets of each window by shared entities, severity and family."""
    starts = V.windows(spark, sf_dir).select("window_id", F.col("start_us").alias("t"))
    times = V.tickets(spark, sf_dir).select("ticket_id", F.col("ts_us").alias("t"))
    a = entity_records(table(spark, sf_dir, "window_entities").join(starts, "window_id"), "window_id", FIELDS, WEIGHTS)
    b = entity_records(table(spark, sf_dir, "kg_tickets").join(times, "ticket_id"), "ticket_id", FIELDS, WEIGHTS)
    s = N.entity_top(a, b, 5, severity=0.5, family=1.0, earlier=True)
    return s.select(F.col("left_id").alias("window_id"), F.col("right_id").alias("ticket_id"), "score", "rank_no")


def r13_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused top five of all pipelines' top twenty by reciprocal ranks; ties by first list, rank and id."""
    f = R.rrf(V.ranked(spark, sf_dir), ["window_id"], "issue_id", "pipeline_name", "rank_no")
    f = f.withColumn("score", F.round("score", 9))
    return top_rows(f, ["window_id"], [F.col("score").desc(), F.col("first_source").asc(), F.col("first_rank").asc(), F.col("issue_id").asc()], 5, "place").select("window_id", "issue_id", F.round("score", 6).alias("score"), "place")


def r14_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ticket after fusing with twice the weight for the dense list; ties by id."""
    f = R.rrf(V.ranked(spark, sf_dir), ["window_id"], "issue_id", "pipeline_name", "rank_no", weights={"bi_encoder_retrieval": 2.0})
    f = f.withColumn("score", F.round("score", 9))
    return top_rows(f, ["window_id"], [F.col("score").desc(), F.col("issue_id").asc()], 1).select("window_id", "issue_id", F.round("score", 6).alias("score"))


def r15_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the anchor's top three the one with most votes of the other lists' top three (3, 2, 1) comes first; the rest by fused ranks."""
    r = V.ranked(spark, sf_dir)
    anchor = r.filter("pipeline_name = 'cross_encoder' and rank_no <= 3").select("window_id", "issue_id", F.col("rank_no").alias("anchor_rank"))
    votes = r.filter("pipeline_name <> 'cross_encoder' and rank_no <= 3").groupBy("window_id", "issue_id").agg(F.sum(4 - F.col("rank_no")).alias("votes"))
    first = top_rows(anchor.join(votes, ["window_id", "issue_id"], "left").withColumn("votes", F.coalesce("votes", F.lit(0))), ["window_id"], [F.col("votes").desc(), F.col("anchor_rank").asc()], 1).select("window_id", "issue_id")
    rest = R.rrf(r.filter("pipeline_name <> 'cross_encoder' and rank_no <= 10"), ["window_id"], "issue_id", "pipeline_name", "rank_no").join(first, ["window_id", "issue_id"], "left_anti")
    rows = first.select("window_id", "issue_id", F.lit(0).alias("part"), F.lit(0.0).alias("score"), F.lit("").alias("s"), F.lit(0).alias("k")).unionByName(
        rest.select("window_id", "issue_id", F.lit(1).alias("part"), F.round("score", 9).alias("score"), F.col("first_source").alias("s"), F.col("first_rank").alias("k"))
    )
    return top_rows(rows, ["window_id"], [F.col("part").asc(), F.col("score").desc(), F.col("s").asc(), F.col("k").asc(), F.col("issue_id").asc()], 5).select("window_id", "issue_id", "rank_no")


def r22_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ticket by 0.55 lexical + 0.45 dense, each scaled between the query's least and greatest (flat lists count 0)."""
    r = V.ranked(spark, sf_dir).filter(F.col("pipeline_name").isin("bm25_retrieval", "bi_encoder_retrieval"))
    s = R.min_max(r, ["window_id", "pipeline_name"], "score", 0.0)
    w = F.when(F.col("pipeline_name") == "bm25_retrieval", 0.55).otherwise(0.45)
    f = s.groupBy("window_id", "issue_id").agg(F.round(F.sum(w * F.col("scaled")), 9).alias("score"))
    return top_rows(f, ["window_id"], [F.col("score").desc(), F.col("issue_id").asc()], 1).select("window_id", "issue_id", F.round("score", 6).alias("score"))


def r23_global_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window mean and greatest of its pipelines' best scores, scaled over each pipeline (flat ones count 0.5)."""
    r = V.ranked(spark, sf_dir, 1)
    s = R.min_max(r, ["pipeline_name"], "score", 0.5)
    return s.groupBy("window_id").agg(F.round(F.avg("scaled"), 6).alias("mean_score"), F.round(F.max("scaled"), 6).alias("max_score"))


def r24_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused best ticket with the decision's novelty: novel only if every known flag is."""
    fused = r13_rrf(spark, sf_dir).filter("place = 1").select("window_id", "issue_id")
    s = table(spark, sf_dir, "window_states").groupBy("window_id").agg(F.every("is_novel").alias("is_novel"))
    return fused.join(s, "window_id", "left").select("window_id", "issue_id", "is_novel")


def r25_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical top twenty reordered by 0.6 cross-encoder + 0.4 lexical, both scaled within the window; tickets without a cross-encoder score keep the lexical part."""
    r = V.ranked(spark, sf_dir)
    base = R.min_max(r.filter("pipeline_name = 'bm25_retrieval'"), ["window_id"], "score", 1.0).select("window_id", "issue_id", F.col("scaled").alias("lex"), F.col("rank_no").alias("old"))
    cross = R.min_max(r.filter("pipeline_name = 'cross_encoder'"), ["window_id"], "score", 1.0).select("window_id", "issue_id", F.col("scaled").alias("ce"))
    s = base.join(cross, ["window_id", "issue_id"], "left").withColumn("score", F.round(0.4 * F.col("lex") + 0.6 * F.coalesce("ce", F.lit(0.0)), 9))
    return top_rows(s, ["window_id"], [F.col("score").desc(), F.col("old").asc()], 3).select("window_id", "issue_id", "rank_no", F.col("old").alias("lexical_rank"))


def r27_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ticket of a window by the rarity of shared entities, max(0.05, 1 - owners / tickets), and the number of bridges."""
    a = entity_rows(table(spark, sf_dir, "window_entities").filter("window_id is not null"), "window_id", FIELDS)
    b = entity_rows(table(spark, sf_dir, "kg_tickets").filter("ticket_id is not null"), "ticket_id", FIELDS)
    n = F.broadcast(b.select(F.count_distinct("ticket_id").alias("n")))
    rarity = b.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("owners")).crossJoin(n).select("kind", "value", F.greatest(F.lit(0.05), 1 - F.col("owners") / F.col("n")).alias("rarity"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("severity", "string"), ("family", "string"), ("t", "bigint"))]
    item = F.struct(F.concat_ws(":", "kind", "value").alias("item"), F.col("rarity").alias("w"))
    left = a.withColumn("rarity", F.lit(1.0)).groupBy(F.col("window_id").alias("id")).agg(F.collect_list(item).alias("items")).select("id", *none, "items")
    right = b.join(rarity, ["kind", "value"]).groupBy(F.col("ticket_id").alias("id")).agg(F.collect_list(item).alias("items")).select("id", *none, "items")
    s = N.entity_top(left, right, 1)
    return s.select(F.col("left_id").alias("window_id"), F.col("right_id").alias("ticket_id"), "score", F.col("n_shared").alias("bridges"))


def r30_error_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus of every retrieved ticket that shares error classes with its window: 0.5 + 0.5 rarity for each, rarity as in `r27_bridges`."""
    a = entity_rows(table(spark, sf_dir, "window_entities").filter("window_id is not null"), "window_id", FIELDS).filter("kind = 'error'")
    b = entity_rows(table(spark, sf_dir, "kg_tickets").filter("ticket_id is not null"), "ticket_id", FIELDS)
    n = F.broadcast(b.select(F.count_distinct("ticket_id").alias("n")))
    b = b.filter("kind = 'error'")
    rarity = b.groupBy("value").agg(F.count(F.lit(1)).alias("owners")).crossJoin(n).select("value", F.greatest(F.lit(0.05), 1 - F.col("owners") / F.col("n")).alias("rarity"))
    pairs = table(spark, sf_dir, "hits").filter("window_id is not null and issue_id is not null").select("window_id", "issue_id").distinct()
    x = pairs.join(a.select("window_id", "value"), "window_id").join(b.select(F.col("ticket_id").alias("issue_id"), "value"), ["issue_id", "value"]).join(rarity, "value")
    return x.groupBy("window_id", "issue_id").agg(F.round(F.sum(0.5 + 0.5 * F.col("rarity")), 6).alias("bonus"), F.count(F.lit(1)).alias("n_shared"))


def r28_kind_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of each kind of shared entity as evidence of a gold ticket, 0.05 at least, over the retrieved pairs that share one."""
    a = entity_rows(table(spark, sf_dir, "window_entities").filter("window_id is not null"), "window_id", FIELDS)
    b = entity_rows(table(spark, sf_dir, "kg_tickets").filter("ticket_id is not null"), "ticket_id", FIELDS).withColumnRenamed("ticket_id", "issue_id")
    pairs = V.ranked(spark, sf_dir).select("window_id", "issue_id").distinct()
    gold = gold_pairs(pairs, V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir)).withColumn("hit", F.lit(True))
    shared = pairs.join(a, "window_id").join(b, ["issue_id", "kind", "value"]).select("kind", "window_id", "issue_id").distinct().join(gold, ["window_id", "issue_id"], "left")
    c = shared.groupBy("kind").agg(F.count("hit").alias("n_hits"), F.count(F.lit(1)).alias("n_pairs"))
    return c.withColumn("weight", F.round(F.greatest(F.lit(0.05), F.col("n_hits") / F.col("n_pairs")), 6))


def r32_evidence_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused lists reordered by 0.4 / rank + 0.6 overlap of evidence words with the ticket's words (two shared words at least)."""
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t")).select("window_id", T.rerank_words(F.col("t")).alias("x"))
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("issue_id"), T.rerank_words(F.concat_ws(" ", "root_cause", "fix")).alias("y"))
    r = V.ranked(spark, sf_dir, 5).filter("pipeline_name = 'hybrid_rrf'").join(e, "window_id").join(k, "issue_id")
    n = F.size(F.array_intersect("x", "y"))
    overlap = F.when(n >= 2, n / F.greatest(F.size("x"), F.lit(1))).otherwise(0.0)
    s = r.select("window_id", "issue_id", "rank_no", F.round(0.4 / F.col("rank_no") + 0.6 * overlap, 6).alias("score"))
    return R.numbered(s, ["window_id"], [F.col("score").desc(), F.col("rank_no").asc()], "place").select("window_id", "issue_id", "score", "place")


def r36_top_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose first lexical ticket is wrong: it beside the first right one, and the latter's rank."""
    r = V.ranked(spark, sf_dir).filter("pipeline_name = 'bm25_retrieval'")
    right = gold_pairs(r, V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir)).groupBy("window_id").agg(F.min(F.struct("rank_no", "issue_id")).alias("g"))
    top = r.filter("rank_no = 1").select("window_id", F.col("issue_id").alias("top_ticket"))
    return top.join(right, "window_id").filter("g.rank_no > 1").select("window_id", "top_ticket", F.col("g.issue_id").alias("gold_ticket"), F.col("g.rank_no").alias("gold_rank"))


def _all() -> dict:
    return {f.__name__: f for f in (r1_bm25, r2_bm25_visible, r3_bm25_share, r6_tfidf, r8_dense, r8_cells, r10_hashed, r11_sparse_dot, r12_entity_score, r13_rrf, r14_weighted_rrf, r15_cascade, r22_blend, r23_global_scale, r24_ensemble, r25_rerank, r27_bridges, r28_kind_weights, r30_error_bonus, r32_evidence_rerank, r36_top_misses)}


QUERIES = _all()

_B = "list_transform(regexp_extract_all(coalesce({t}, ''), '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))"
_A = "list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+'), lambda x: length(x) >= 2)"
_DOCS = f"{V.TICKETS}, d as (select ticket_id, ts_us, {_B.format(t='concat_ws(chr(32), root_cause, fix)')} as ws from k), q as (select ticket_id as query_id, ts_us as q_us, ws from d where cast(regexp_extract(ticket_id, '(\\d+)$', 1) as bigint) % 20 = 0), p as (select ticket_id, word, count(*) as tf, max(n) as len from (select ticket_id, len(ws) as n, unnest(ws) as word from d) group by 1, 2), qp as (select query_id, word, count(*) as qtf from (select query_id, unnest(ws) as word from q) group by 1, 2), f as (select word, count(*) as df from p group by 1), c as (select count(*) as n_docs, avg(len(ws)) as avg_len from d)"
_BM = f"{_DOCS}, s as (select query_id, ticket_id, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score from qp join f using (word) join p using (word), c group by 1, 2)"
_TOP = "select query_id, ticket_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 6) desc, ticket_id) as integer) as rank_no from s {where} qualify rank_no <= 5"
_ENT = "select distinct {key}, kind, lower(trim(v)) as value from (" + " union all ".join(f"select {{key}}, '{kind}' as kind, unnest({c}) as v from {{table}} where {{key}} is not null" for kind, c in FIELDS.items()) + ") where v is not null and trim(v) <> ''"
_AB = f"a as ({_ENT.format(key='window_id', table='window_entities')}), b as ({_ENT.format(key='ticket_id', table='kg_tickets')})"
_KW = "case a.kind when 'service' then 2.0 when 'component' then 1.5 when 'error' then 3.0 else 1.0 end"
_RRF = "x as (select window_id, issue_id, round(sum({w} / (60 + rank_no)), 9) as score, min(pipeline_name || chr(1) || lpad(cast(rank_no as varchar), 4, '0')) as f from r {where} group by 1, 2)"
_HASH = "('0x' || left(sha256(word), 8))::bigint"


def _hashed(d: int, source: str, key: str) -> str:
    return f"(select {key}, cast({_HASH} % {d} as integer) as dim, sum(case when ('0x' || substring(sha256(word), 9, 2))::bigint % 2 = 0 then 1.0 else -1.0 end * (1 + ln(tf))) as x from (select {key}, word, count(*) as tf from (select {key}, unnest(ws) as word from {source}) group by 1, 2) group by 1, 2)"


_ADOCS = f"{V.TICKETS}, d as (select ticket_id, {_A.format(t='concat_ws(chr(32), root_cause, fix)')} as ws from k), q as (select ticket_id as query_id, ws from d where cast(regexp_extract(ticket_id, '(\\d+)$', 1) as bigint) % 20 = 0)"
_STEM = " ".join(f"when x like '%{s}' and length(x) > {len(s) + 2} then left(x, length(x) - {len(s)})" for s in ("ing", "ed", "es", "s"))


def _rerank(t: str) -> str:
    w = f"list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z0-9]{{2,}}'), lambda x: x not in ({', '.join(repr(x) for x in T.STOP_WORDS)}))"
    return f"list_distinct(list_concat({w}, list_filter(list_transform({w}, lambda x: case {_STEM} end), lambda x: x is not null)))"


SQL = {
    "r1_bm25": f"with {_BM} " + _TOP.format(where="where query_id <> ticket_id"),
    "r2_bm25_visible": f"with {_BM} select s.query_id, s.ticket_id, round(score, 6) as score, cast(row_number() over (partition by s.query_id order by round(score, 6) desc, s.ticket_id) as integer) as rank_no from s join q using (query_id) join d on s.ticket_id = d.ticket_id where d.ts_us < q_us qualify rank_no <= 5",
    "r3_bm25_share": f"with {_BM} select query_id, round(max(score) filter (query_id <> ticket_id) / max(score), 6) as share from s group by 1",
    "r6_tfidf": f"with {_DOCS}, i as (select word, ln((1 + n_docs) / (1 + df)) + 1 as idf from f, c), dw as (select ticket_id, word, (1 + ln(tf)) * idf as w from p join i using (word)), qw as (select query_id, word, (1 + ln(qtf)) * idf as w from qp join i using (word)), dn as (select ticket_id, sqrt(sum(w * w)) as n from dw group by 1), qn as (select query_id, sqrt(sum(w * w)) as n from qw group by 1), t as (select query_id, ticket_id, sum(qw.w * dw.w) as dot from qw join dw using (word) group by 1, 2), s as (select query_id, ticket_id, dot / (dn.n * qn.n) as score from t join dn using (ticket_id) join qn using (query_id)) " + _TOP.format(where="where query_id <> ticket_id"),
    "r8_dense": "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null), s as (select a.vec_id as query_id, b.vec_id as doc_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank_no from s qualify rank_no <= 5",
    "r10_hashed": f"with {_ADOCS}, v as {_hashed(64, 'd', 'ticket_id')}, n as (select ticket_id, sqrt(sum(x * x)) as n from v group by 1) select ticket_id, dim, round(x / n, 6) as value from v join n using (ticket_id) where x <> 0",
    "r11_sparse_dot": f"with {_ADOCS}, v as {_hashed(4096, 'd', 'ticket_id')}, n as (select ticket_id, sqrt(sum(x * x)) as n from v group by 1), u as (select ticket_id, dim, x / n as value from v join n using (ticket_id) where x <> 0), s as (select a.ticket_id as query_id, b.ticket_id, sum(a.value * b.value) as score from u a join u b on a.dim = b.dim and a.ticket_id <> b.ticket_id where a.ticket_id in (select query_id from q) group by 1, 2 having sum(a.value * b.value) > 0) " + _TOP.format(where=""),
    "r12_entity_score": f"with {V.WINDOWS}, {V.TICKETS}, {_AB}, x as (select window_id, ticket_id, sum({_KW}) as score from a join b on a.kind = b.kind and a.value = b.value group by 1, 2), m as (select window_id, max(severity) as ws, max(family) as wf from window_entities where window_id is not null group by 1), y as (select x.window_id, x.ticket_id, cast(score as double) + case when ws = k.severity then 0.5 else 0.0 end + case when wf = k.family then 1.0 else 0.0 end as score from x join m using (window_id) join w using (window_id) join k using (ticket_id) where k.ts_us < w.start_us) select window_id, ticket_id, cast(score as double) as score, cast(row_number() over (partition by window_id order by score desc, ticket_id) as integer) as rank_no from y qualify rank_no <= 5",
    "r13_rrf": f"with {V.RANKED}, {_RRF.format(w='1.0::double', where='')} select window_id, issue_id, round(score, 6) as score, cast(row_number() over (partition by window_id order by score desc, f, issue_id) as integer) as place from x qualify place <= 5",
    "r14_weighted_rrf": f"with {V.RANKED}, {_RRF.format(w=chr(39).join(('case pipeline_name when ', 'bi_encoder_retrieval', ' then 2.0::double else 1.0::double end')), where='')} select window_id, issue_id, round(score, 6) as score from x qualify row_number() over (partition by window_id order by score desc, issue_id) = 1",
    "r15_cascade": f"with {V.RANKED}, an as (select window_id, issue_id, rank_no from r where pipeline_name = 'cross_encoder' and rank_no <= 3), vo as (select window_id, issue_id, sum(4 - rank_no) as votes from r where pipeline_name <> 'cross_encoder' and rank_no <= 3 group by 1, 2), fi as (select an.window_id, an.issue_id from an left join vo using (window_id, issue_id) qualify row_number() over (partition by an.window_id order by coalesce(votes, 0) desc, rank_no) = 1), {_RRF.format(w='1.0::double', where=chr(39).join(('where pipeline_name <> ', 'cross_encoder', ' and rank_no <= 10')))}, y as (select window_id, issue_id, 0 as part, 0.0::double as score, '' as f from fi union all select x.window_id, x.issue_id, 1, score, f from x anti join fi using (window_id, issue_id)) select window_id, issue_id, cast(row_number() over (partition by window_id order by part, score desc, f, issue_id) as integer) as rank_no from y qualify rank_no <= 5",
    "r22_blend": f"with {V.RANKED}, e as (select *, min(score) over (partition by window_id, pipeline_name) as lo, max(score) over (partition by window_id, pipeline_name) as hi from r where pipeline_name in ('bm25_retrieval', 'bi_encoder_retrieval')), x as (select window_id, issue_id, round(sum(case pipeline_name when 'bm25_retrieval' then 0.55::double else 0.45::double end * case when hi - lo <= 1e-12 then 0.0 else (score - lo) / (hi - lo) end), 9) as score from e group by 1, 2) select window_id, issue_id, round(score, 6) as score from x qualify row_number() over (partition by window_id order by score desc, issue_id) = 1",
    "r23_global_scale": f"with {V.RANKED}, e as (select *, min(score) over (partition by pipeline_name) as lo, max(score) over (partition by pipeline_name) as hi from r where rank_no = 1), x as (select window_id, case when hi - lo <= 1e-12 then 0.5 else (score - lo) / (hi - lo) end as v from e) select window_id, round(avg(v), 6) as mean_score, round(max(v), 6) as max_score from x group by 1",
    "r24_ensemble": f"with {V.RANKED}, {_RRF.format(w='1.0::double', where='')}, t as (select window_id, issue_id from x qualify row_number() over (partition by window_id order by score desc, f, issue_id) = 1), n as (select window_id, bool_and(is_novel) as is_novel from window_states group by 1) select t.window_id, issue_id, is_novel from t left join n using (window_id)",
    "r25_rerank": f"with {V.RANKED}, e as (select *, min(score) over (partition by window_id, pipeline_name) as lo, max(score) over (partition by window_id, pipeline_name) as hi from r), z as (select window_id, pipeline_name, issue_id, rank_no, case when hi - lo <= 1e-12 then 1.0 else (score - lo) / (hi - lo) end as v from e), x as (select a.window_id, a.issue_id, a.rank_no as old, round(0.4 * a.v + 0.6 * coalesce(b.v, 0.0), 9) as score from z a left join z b on b.pipeline_name = 'cross_encoder' and a.window_id = b.window_id and a.issue_id = b.issue_id where a.pipeline_name = 'bm25_retrieval') select window_id, issue_id, cast(row_number() over (partition by window_id order by score desc, old) as integer) as rank_no, cast(old as integer) as lexical_rank from x qualify rank_no <= 3",
    "r27_bridges": f"with {_AB}, n as (select count(distinct ticket_id) as n from b), ra as (select kind, value, greatest(0.05, 1 - count(*) / (select n from n)) as rarity from b group by 1, 2), x as (select window_id, ticket_id, round(sum(rarity), 6) as score, count(*) as bridges from a join ra using (kind, value) join b using (kind, value) group by 1, 2) select window_id, ticket_id, score, bridges from x qualify row_number() over (partition by window_id order by score desc, ticket_id) = 1",
    "r28_kind_weights": f"with {V.WINDOWS}, {V.TICKETS}, {V.RANKED}, {_AB}, d as (select distinct window_id, issue_id from r), p as (select distinct a.kind, d.window_id, d.issue_id from d join a on d.window_id = a.window_id join b on d.issue_id = b.ticket_id and a.kind = b.kind and a.value = b.value), h as (select kind, coalesce(w.family = k.family and k.ts_us < w.start_us and (w.service is null or list_contains(k.services, w.service)), false) as hit from p left join w on p.window_id = w.window_id left join k on p.issue_id = k.ticket_id) select kind, count(*) filter (hit) as n_hits, count(*) as n_pairs, round(greatest(0.05, count(*) filter (hit) / count(*)), 6) as weight from h group by 1",
    "r30_error_bonus": f"with {_AB}, n as (select count(distinct ticket_id) as n from b), ra as (select value, greatest(0.05, 1 - count(*) / (select n from n)) as rarity from b where kind = 'error' group by 1), h as (select distinct window_id, issue_id from hits where window_id is not null and issue_id is not null) select h.window_id, h.issue_id, round(sum(0.5 + 0.5 * rarity), 6) as bonus, count(*) as n_shared from h join a on h.window_id = a.window_id and a.kind = 'error' join b on h.issue_id = b.ticket_id and b.kind = 'error' and a.value = b.value join ra on a.value = ra.value group by 1, 2",
    "r32_evidence_rerank": f"with {V.TICKETS}, {V.RANKED}, e as (select window_id, max(triage_evidence_text) as t from telemetry_windows group by 1), ew as (select window_id, {_rerank('t')} as x from e), kw as (select ticket_id, {_rerank('concat_ws(chr(32), root_cause, fix)')} as y from k), z as (select r.window_id, issue_id, rank_no, len(list_intersect(x, y)) as n, len(x) as m from r join ew using (window_id) join kw on issue_id = ticket_id where pipeline_name = 'hybrid_rrf' and rank_no <= 5), s as (select window_id, issue_id, rank_no, round(0.4 / rank_no + 0.6 * case when n >= 2 then n / greatest(m, 1) else 0.0 end, 6) as score from z) select window_id, issue_id, score, cast(row_number() over (partition by window_id order by score desc, rank_no) as integer) as place from s",
    "r36_top_misses": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED}, m as (select r.window_id, min(rank_no) as gold_rank, arg_min(issue_id, rank_no) as gold_ticket from r join g on r.window_id = g.window_id and issue_id = ticket_id where pipeline_name = 'bm25_retrieval' group by 1) select m.window_id, r.issue_id as top_ticket, gold_ticket, cast(gold_rank as integer) as gold_rank from m join r on r.window_id = m.window_id and r.pipeline_name = 'bm25_retrieval' and r.rank_no = 1 where gold_rank > 1",
}
