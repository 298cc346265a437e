"""Queries composed of the operators: candidate ranking, signatures, holdouts, assembled texts, cost roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import metrics as M
from tidemark.operators import rank as R
from tidemark.operators import search as N
from tidemark.operators import telemetry as A
from tidemark.operators.relations import top_rows
from tidemark.plans import evaluation as E
from tidemark.plans import ranking as K
from tidemark.plans import views as V
from tidemark.tables import table


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, ticket_id): retrieved tickets (twenty a pipeline) that were there before the window."""
    # By window at once, so that taking pairs once and the join need no shuffle of their own.
    r = V.ranked(spark, sf_dir).select("window_id", F.col("issue_id").alias("ticket_id")).repartition("window_id").distinct()
    w, k = V.windows(spark, sf_dir).select("window_id", "start_us"), V.tickets(spark, sf_dir).select("ticket_id", "ts_us")
    return r.join(w.hint("merge"), "window_id").join(k.hint("merge"), "ticket_id").filter("ts_us < start_us").select("window_id", "ticket_id")


def candidate_scores(spark: SparkSession, sf_dir: str, texts: Sequence[Column], **carried: Column) -> DataFrame:
    """(window_id, ticket_id, carried, score_0, ...): BM25 of a window's candidates for each of `texts` (of its evidence t), with document frequencies among its own candidates; `carried` are further columns of the evidence."""
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    d = V.tickets(spark, sf_dir).select("ticket_id", F.concat_ws(" ", "root_cause", "fix").alias("d"))
    s = N.own_candidates(candidates(spark, sf_dir), e.withColumns(carried), d, "window_id", "ticket_id", [T.words_b(x) for x in texts], T.words_b(F.col("d")), list(carried))
    return s.withColumns({f"score_{i}": F.round(f"score_{i}", 6) for i in range(len(texts))})


def r4_candidate_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of every window by BM25 with document frequencies among the window's own candidates: its retrieved tickets that were there before it."""
    s = candidate_scores(spark, sf_dir, [F.col("t")]).withColumnRenamed("score_0", "score")
    return top_rows(s, ["window_id"], [F.col("score").desc(), F.col("ticket_id").asc()], 1).select("window_id", "ticket_id", "score")


def r7_frequent_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best other ticket by TF-IDF cosine over words that two tickets or more hold, for every twentieth ticket."""
    q, k = K._tickets(spark, sf_dir)
    best = N.tfidf_top(q, k, "query_id", "ticket_id", T.words_a(F.col("q")), T.words_a(F.col("t")), 1, least_df=2)
    return best.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("ticket_id"), "score")


def r26_vector_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lexical candidate after half lexical (share of the peak), half positive dense score."""
    r = V.ranked(spark, sf_dir)
    lex = r.filter("pipeline_name = 'bm25_retrieval' and score > 0")
    peak = lex.groupBy("window_id").agg(F.max("score").alias("peak"))
    dense = r.filter("pipeline_name = 'bi_encoder_retrieval'").select("window_id", "issue_id", F.greatest(F.col("score"), F.lit(0.0)).alias("cos"))
    s = lex.join(peak, "window_id").join(dense, ["window_id", "issue_id"], "left").select("window_id", "issue_id", F.round(0.5 * F.col("score") / F.col("peak") + 0.5 * F.coalesce("cos", F.lit(0.0)), 6).alias("score"))
    return top_rows(s, ["window_id"], [F.col("score").desc(), F.col("issue_id").asc()], 1).select("window_id", "issue_id", "score")


def r31_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined score of a window's best graph ticket: 0.55 similarity + 0.45 graph + 0.05 a pipeline that agrees (five at most), between 0 and 1."""
    r = V.ranked(spark, sf_dir)
    kg = R.min_max(r.filter("pipeline_name = 'kg_retrieval'"), ["window_id"], "score", 1.0).select("window_id", "issue_id", F.col("scaled").alias("graph"))
    de = R.min_max(r.filter("pipeline_name = 'bi_encoder_retrieval'"), ["window_id"], "score", 1.0).select("window_id", "issue_id", F.col("scaled").alias("sim"))
    n = r.groupBy("window_id", "issue_id").agg(F.count(F.lit(1)).alias("agree"))
    s = kg.join(de, ["window_id", "issue_id"], "left").join(n, ["window_id", "issue_id"])
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.55 * F.coalesce("sim", F.lit(0.0)) + 0.45 * F.col("graph") + 0.05 * F.least(F.col("agree"), F.lit(5))))
    s = s.withColumn("score", F.round(score, 6))
    return top_rows(s, ["window_id"], [F.col("score").desc(), F.col("issue_id").asc()], 1).select("window_id", "issue_id", "score")


def a12_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature of each episode: its three error names with the greatest (a + 1) / (b + 1) between fault and baseline, each once with its best service; the most frequent name of any phase where there is none."""
    w = V.windows(spark, sf_dir).filter("episode is not null").select("window_id", "episode", F.coalesce("service", F.lit("")).alias("service"), "window_type")
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.max("triage_evidence_text").alias("t"))
    lines = e.select("window_id", F.explode(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"\b([A-Z][A-Za-z]+(?:Error|Exception|Fault|Failure))\b"), F.lit(1))).alias("name"))
    c = lines.join(w, "window_id").groupBy("episode", "service", "name").agg(F.count_if(F.col("window_type") == "active_fault").alias("a"), F.count_if(F.col("window_type") == "pre_fault_baseline").alias("b"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("score", (F.col("a") + 1) / (F.col("b") + 1))
    active = top_rows(c.filter("a >= 1 and score >= 2"), ["episode", "name"], [F.col("score").desc(), F.col("a").desc(), F.col("service").asc()], 1, "k")
    best = top_rows(active, ["episode"], [F.col("score").desc(), F.col("a").desc(), F.col("name").asc()], 3).select("episode", "name", "rank_no")
    rest = c.join(active.select("episode").distinct(), "episode", "left_anti").groupBy("episode", "name").agg(F.sum("n").alias("n"))
    fallback = top_rows(rest, ["episode"], [F.col("n").desc(), F.col("name").asc()], 1).select("episode", "name", "rank_no")
    return best.unionByName(fallback)


def m19_stratified_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the hit rate by phase for one pipeline; strata with fewer than ten windows are left out."""
    r = E._retrieval(spark, sf_dir).filter("pipeline_name = 'hybrid_rrf'").join(V.windows(spark, sf_dir).select("window_id", "window_type"), "window_id")
    big = r.groupBy("window_type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("window_type")
    rows = r.join(big, "window_type", "left_semi").select("window_type", "window_id", F.col("hit_5").cast("double").alias("v"))
    return M.bootstrap_interval(rows, ["window_type"], "window_id", "v", 100, seed="s")


def m24_leave_run_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank of each pipeline by run, averaged over runs (macro) and over windows (pooled)."""
    r = E._retrieval(spark, sf_dir).join(V.windows(spark, sf_dir).select("window_id", "run"), "window_id")
    run = r.groupBy("pipeline_name", "run").agg(F.avg("reciprocal_rank").alias("m"), F.count(F.lit(1)).alias("n"))
    return run.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("pooled"))


def z5_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis of a window from its fused candidates: greatest similarity of entities, consistent from 0.2, novel if none reaches 0.4; score 0.7 confidence + 0.3 fused."""
    items = lambda: F.array_distinct(F.transform(F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("components", "error_classes", "symptoms")]), lambda x: x.isNotNull() & (F.btrim(x) != "")), lambda x: F.lower(F.btrim(x))))
    a = table(spark, sf_dir, "window_entities").dropDuplicates(["window_id"]).select("window_id", items().alias("x"))
    b = table(spark, sf_dir, "kg_tickets").dropDuplicates(["ticket_id"]).select(F.col("ticket_id").alias("issue_id"), items().alias("y"))
    fused = R.rrf(V.ranked(spark, sf_dir), ["window_id"], "issue_id", "pipeline_name", "rank_no").select("window_id", "issue_id", F.round("score", 9).alias("fused"))
    pool = top_rows(fused, ["window_id"], [F.col("fused").desc(), F.col("issue_id").asc()], 10)
    j = pool.join(a, "window_id").join(b, "issue_id")
    sim = F.when(F.size(F.array_union("x", "y")) == 0, 0.0).otherwise(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")))
    j = j.withColumn("sim", sim)
    d = j.groupBy("window_id").agg(F.max("sim").alias("confidence"), F.count_if(F.col("sim") >= 0.2).alias("n_consistent"), F.max("fused").alias("fused"))
    novel = F.col("confidence") < 0.4
    return d.select("window_id", F.round("confidence", 6).alias("confidence"), "n_consistent", novel.alias("is_novel"), F.round(F.when(novel, 0.0).otherwise(0.7 * F.col("confidence")) + 0.3 * F.col("fused"), 6).alias("score"))


def z7_holdout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-run-out: windows held out, windows left, and held-out evidence that also occurs in other runs."""
    w = V.windows(spark, sf_dir).filter("run is not null").select("window_id", "run")
    e = table(spark, sf_dir, "telemetry_windows").groupBy("window_id").agg(F.md5(F.max("triage_evidence_text")).alias("h"))
    j = w.join(e, "window_id")
    spread = j.filter("h is not null").groupBy("h").agg(F.count_distinct("run").alias("n_runs"))
    total = w.agg(F.count(F.lit(1)).alias("n"))
    r = j.join(spread, "h", "left").groupBy("run").agg(F.count(F.lit(1)).alias("n_eval"), F.count_if(F.col("n_runs") > 1).alias("n_overlap"))
    return r.crossJoin(F.broadcast(total)).select("run", "n_eval", (F.col("n") - F.col("n_eval")).alias("n_train"), "n_overlap")


def z12_trace_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trace: per type calls, users, total and 95th percentile value at index int(0.95 (n - 1))."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    total = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))
    q = A.value_ranks(e, ["event_type"], "value").filter(F.col("upto") > F.floor(0.95 * (F.col("n") - 1))).groupBy(F.col("_g.event_type").alias("event_type")).agg(F.min("value").alias("p95"))
    return total.join(q, "event_type").select("event_type", "n_calls", "n_users", "total", "p95")


def f11_body_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of JSON log lines in brief: level, name and message (60 characters), the keys that are there, in order."""
    x = table(spark, sf_dir, "log_lines").groupBy("stream_id", "line_no").agg(F.max("line").alias("line")).filter("line like '{\"%' and line like '%}'")
    get = lambda *keys: F.coalesce(*[F.get_json_object("line", f"$.{k}") for k in keys])
    level, name, text = get("level", "severity", "lvl"), get("logger", "component", "mod"), get("msg", "message", "text")
    return x.select("stream_id", "line_no", F.concat_ws(" ", F.concat(F.lit("level="), F.lower(level)), F.concat(F.lit("name="), name), F.concat(F.lit("msg="), F.substring(text, 1, 60))).alias("summary"))


def f12_evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each window with events: header, counts, and the five most frequent reasons, 200 characters at most."""
    e = table(spark, sf_dir, "k8s_events").filter("window_id is not null").select("window_id", "event_uid", F.lower(F.btrim("reason")).alias("reason")).distinct()
    top = top_rows(e.groupBy("window_id", "reason").agg(F.count(F.lit(1)).alias("n")), ["window_id"], [F.col("n").desc(), F.col("reason").asc()], 5)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "reason", "n"))), lambda x: F.concat_ws(" x", x["reason"], x["n"].cast("string"))), "; ")
    parts = top.groupBy("window_id").agg(text.alias("t"), F.sum("n").alias("n"))
    w = V.windows(spark, sf_dir).select("window_id", "service", "window_type")
    full = F.concat_ws("\n", F.concat_ws(" ", "window_type", "service"), F.concat(F.lit("events: "), F.col("n").cast("string")), "t")
    return parts.join(w, "window_id").select("window_id", F.when(F.length(full) > 200, F.concat(F.substring(full, 1, 199), F.lit("…"))).otherwise(full).alias("text"))


def s16_timeline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets joined with the windows of their family and first service by day: a line per ticket with counts, and tickets without such windows after them."""
    k = V.tickets(spark, sf_dir).filter("family is not null and ts_us is not null").select("ticket_id", "family", F.get("services", F.lit(0)).alias("service"), F.expr("ts_us div 86400000000").alias("day_no"))
    w = V.windows(spark, sf_dir).filter("start_us is not null").groupBy("family", "service", F.expr("start_us div 86400000000").alias("day_no")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "ticket_worthy").alias("n_worthy"))
    j = k.join(w, ["family", "service", "day_no"])
    rest = k.join(j.select("ticket_id"), "ticket_id", "left_anti").select("ticket_id", F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("n_worthy"), F.lit("distractor").alias("kind"))
    return j.select("ticket_id", F.col("n").alias("n_windows"), "n_worthy", F.lit("ticket").alias("kind")).unionByName(rest)


_F = (r4_candidate_bm25, r7_frequent_tfidf, r26_vector_blend, r31_combined, a12_signature, m19_stratified_interval, m24_leave_run_out, z5_diagnosis, z7_holdout_audit, z12_trace_costs, f11_body_summary, f12_evidence_text, s16_timeline_join)
QUERIES = {f.__name__: f for f in _F}

_B = K._B
_A = K._A
_ITEMS = "list_distinct(list_transform(list_filter(list_concat(list_concat(coalesce(components, []), coalesce(error_classes, [])), coalesce(symptoms, [])), lambda v: v is not null and trim(v) <> ''), lambda v: lower(trim(v))))"
_SCALED = "case when hi - lo <= 1e-12 then 1.0 else (score - lo) / (hi - lo) end"


def _get(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(line, '$.{k}')" for k in keys) + ")"


def candidate_sql(text: str, p: str, first: bool = True) -> str:
    """CTEs up to `<p>_s` (window_id, ticket_id, score), for an expression over the evidence t."""
    base = f"{V.WINDOWS}, {V.TICKETS}, {V.RANKED}, cd as (select distinct r.window_id, ticket_id from r join w using (window_id) join k on issue_id = ticket_id where ts_us < start_us), " if first else ""
    return base + f"""{p}_e as (select window_id, max(triage_evidence_text) as t from telemetry_windows group by 1), {p}_q as (select window_id, word, count(*) as qtf from (select window_id, unnest({_B.format(t=text)}) as word from {p}_e) group by 1, 2),
{p}_d as (select ticket_id, word, count(*) as tf, max(n) as len from (select ticket_id, len(ws) as n, unnest(ws) as word from (select ticket_id, {_B.format(t='concat_ws(chr(32), root_cause, fix)')} as ws from k)) group by 1, 2), {p}_c as (select cd.window_id, {p}_d.* from cd join {p}_d using (ticket_id)),
{p}_st as (select window_id, count(*) as n_docs, avg(l) as avg_len from (select window_id, ticket_id, max(len) as l from {p}_c group by 1, 2) group by 1), {p}_f as (select window_id, word, count(*) as df from {p}_c group by 1, 2),
{p}_s as (select window_id, ticket_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score from {p}_c join {p}_q using (window_id, word) join {p}_f using (window_id, word) join {p}_st using (window_id) group by 1, 2)"""


SQL = {
    "r4_candidate_bm25": f"with {candidate_sql('t', 'l')} select window_id, ticket_id, score from l_s qualify row_number() over (partition by window_id order by score desc, ticket_id) = 1",
    "r7_frequent_tfidf": f"with {V.TICKETS}, d as (select ticket_id, {_A.format(t='concat_ws(chr(32), root_cause, fix)')} as ws from k), p as (select ticket_id, word, count(*) as tf from (select ticket_id, unnest(ws) as word from d) group by 1, 2), i as (select word, ln((1 + (select count(*) from d)) / (1 + count(*))) + 1 as idf from p group by 1 having count(*) >= 2), w_ as (select ticket_id, word, (1 + ln(tf)) * idf as w from p join i using (word)), n as (select ticket_id, sqrt(sum(w * w)) as n from w_ group by 1), u as (select ticket_id, word, w / n as w from w_ join n using (ticket_id)), s as (select a.ticket_id as query_id, b.ticket_id, round(sum(a.w * b.w), 6) as score from u a join u b on a.word = b.word and a.ticket_id <> b.ticket_id where cast(regexp_extract(a.ticket_id, '(\\d+)$', 1) as bigint) % 20 = 0 group by 1, 2) select query_id, ticket_id, score from s qualify row_number() over (partition by query_id order by score desc, ticket_id) = 1",
    "r26_vector_blend": f"with {V.RANKED}, l as (select *, max(score) over (partition by window_id) as peak from r where pipeline_name = 'bm25_retrieval' and score > 0), s as (select l.window_id, l.issue_id, round(0.5 * l.score / peak + 0.5 * coalesce(greatest(d.score, 0.0), 0.0), 6) as score from l left join r d on d.pipeline_name = 'bi_encoder_retrieval' and l.window_id = d.window_id and l.issue_id = d.issue_id) select * from s qualify row_number() over (partition by window_id order by score desc, issue_id) = 1",
    "r31_combined": f"with {V.RANKED}, e as (select *, min(score) over (partition by window_id, pipeline_name) as lo, max(score) over (partition by window_id, pipeline_name) as hi from r), z as (select window_id, pipeline_name, issue_id, {_SCALED} as v from e), n as (select window_id, issue_id, count(*) as agree from r group by 1, 2), s as (select a.window_id, a.issue_id, round(least(1.0, greatest(0.0, 0.55::double * coalesce(b.v, 0.0) + 0.45::double * a.v + 0.05::double * least(agree, 5))), 6) as score from z a left join z b on b.pipeline_name = 'bi_encoder_retrieval' and a.window_id = b.window_id and a.issue_id = b.issue_id join n on n.window_id = a.window_id and n.issue_id = a.issue_id where a.pipeline_name = 'kg_retrieval') select * from s qualify row_number() over (partition by window_id order by score desc, issue_id) = 1",
    "a12_signature": f"with {V.WINDOWS}, ev as (select window_id, max(triage_evidence_text) as t from telemetry_windows group by 1), li as (select window_id, unnest(regexp_extract_all(coalesce(t, ''), '\\b([A-Z][A-Za-z]+(?:Error|Exception|Fault|Failure))\\b', 1)) as name from ev), c as (select episode, coalesce(service, '') as service, name, count(*) filter (window_type = 'active_fault') as a, count(*) filter (window_type = 'pre_fault_baseline') as b, count(*) as n from li join w using (window_id) where episode is not null group by 1, 2, 3), ac as (select *, (a + 1) / (b + 1) as score from c where a >= 1 and (a + 1) / (b + 1) >= 2 qualify row_number() over (partition by episode, name order by (a + 1) / (b + 1) desc, a desc, service) = 1), be as (select episode, name, cast(row_number() over (partition by episode order by score desc, a desc, name) as integer) as rank_no from ac qualify rank_no <= 3), re as (select episode, name, sum(n) as n from c where episode not in (select episode from ac) group by 1, 2), fa as (select episode, name, 1 as rank_no from re qualify row_number() over (partition by episode order by n desc, name) = 1) select * from be union all select * from fa",
    "m19_stratified_interval": f"with {E._RT}, v0 as (select window_type, window_id, cast(hit_5 as double) as v from rq join w using (window_id) where pipeline_name = 'hybrid_rrf'), v as (select * from v0 where window_type in (select window_type from v0 group by 1 having count(*) >= 10)), bw as {E._draws('window_id', 100, 'v').replace(chr(39) + 'b|', chr(39) + 's|')}, bm as (select window_type, replicate, round(sum(weight * v) / sum(weight), 9) as m from bw where weight > 0 group by 1, 2), bl as (select window_type, list(m order by m) as ms from bm group by 1), pt as (select window_type, avg(v) as mean from v group by 1) select window_type, round(mean, 6) as mean, round(ms[cast(floor(len(ms) * 0.025) as integer) + 1], 6) as low, round(ms[cast(least(floor(len(ms) * 0.975), len(ms) - 1) as integer) + 1], 6) as high from pt join bl using (window_type)",
    "m24_leave_run_out": f"with {E._RT}, x as (select pipeline_name, run, avg(reciprocal_rank) as m, count(*) as n from rq join w using (window_id) group by 1, 2) select pipeline_name, count(*) as n_runs, round(avg(m), 6) as macro, round(sum(m * n) / sum(n), 6) as pooled from x group by 1",
    "z5_diagnosis": f"with {V.RANKED}, fu as (select window_id, issue_id, round(sum(1.0::double / (60 + rank_no)), 9) as fused from r group by 1, 2), po as (select * from fu qualify row_number() over (partition by window_id order by fused desc, issue_id) <= 10), a as (select distinct window_id, {_ITEMS} as x from window_entities), b as (select distinct ticket_id, {_ITEMS} as y from kg_tickets), j as (select window_id, fused, case when len(list_distinct(list_concat(x, y))) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end as sim from po join a using (window_id) join b on po.issue_id = b.ticket_id), d as (select window_id, max(sim) as confidence, count(*) filter (sim >= 0.2) as n_consistent, max(fused) as fused from j group by 1) select window_id, round(confidence, 6) as confidence, n_consistent, confidence < 0.4 as is_novel, round(case when confidence < 0.4 then 0.0 else 0.7 * confidence end + 0.3 * fused, 6) as score from d",
    "z7_holdout_audit": f"with {V.WINDOWS}, e as (select window_id, md5(max(triage_evidence_text)) as h from telemetry_windows group by 1), j as (select w.window_id, run, h from w join e using (window_id) where run is not null), s as (select h, count(distinct run) as n_runs from j where h is not null group by 1) select run, count(*) as n_eval, (select count(*) from j) - count(*) as n_train, count(*) filter (n_runs > 1) as n_overlap from j left join s using (h) group by 1",
    "z12_trace_costs": "with e as (select *, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, count(*) as n_calls, count(distinct user_id) as n_users, round(sum(value), 4) as total, min(value) filter (i = floor(0.95 * (n - 1))) as p95 from e group by 1",
    "f11_body_summary": f"with x as (select stream_id, line_no, max(line) as line from log_lines group by 1, 2), j as (select stream_id, line_no, line from x where line like '{{\"%' and line like '%}}') select stream_id, line_no, concat_ws(' ', 'level=' || lower({_get('level', 'severity', 'lvl')}), 'name=' || {_get('logger', 'component', 'mod')}, 'msg=' || left({_get('msg', 'message', 'text')}, 60)) as summary from j",
    "f12_evidence_text": f"with {V.WINDOWS}, e as (select distinct window_id, event_uid, lower(trim(reason)) as reason from k8s_events where window_id is not null), c as (select window_id, reason, count(*) as n from e group by 1, 2), t as (select *, row_number() over (partition by window_id order by n desc, reason) as k from c qualify k <= 5), p as (select window_id, string_agg(reason || ' x' || n, '; ' order by k) as t, sum(n) as n from t group by 1), f as (select window_id, concat_ws(chr(10), concat_ws(' ', window_type, service), 'events: ' || cast(n as bigint), t) as f from p join w using (window_id)) select window_id, case when length(f) > 200 then left(f, 199) || '…' else f end as text from f",
    "s16_timeline_join": f"with {V.WINDOWS}, {V.TICKETS}, t as (select ticket_id, family, services[1] as service, ts_us // 86400000000 as day_no from k where family is not null and ts_us is not null), c as (select family, service, start_us // 86400000000 as day_no, count(*) as n, count(*) filter (label = 'ticket_worthy') as n_worthy from w where start_us is not null group by 1, 2, 3) select ticket_id, coalesce(n, 0) as n_windows, coalesce(n_worthy, 0) as n_worthy, case when n is null then 'distractor' else 'ticket' end as kind from t left join c using (family, service, day_no)",
}
