"""Queries of joins, set operations and gold relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.asof import asof_join, latest_rows, recent_others
from tidemark.operators.manifest import assigned_windows, valid_manifest
from tidemark.operators.relations import attach_gold, baseline_deltas, common_to_all, entity_records, entity_rows, gold_counts, gold_pairs, top_rows
from tidemark.operators.search import entity_top, jaccard_top
from tidemark.operators.skew import self_pairs
from tidemark.operators.telemetry import hashed_numbers
from tidemark.plans import views as V
from tidemark.tables import table

WEIGHTS = {"service": 2.0, "component": 1.5, "error": 3.0, "symptom": 1.0}
FIELDS = {"service": "affected_services", "component": "components", "error": "error_classes", "symptom": "symptoms"}


def s7_gold_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the number of gold tickets and novelty; expectations from the decisions."""
    w = V.windows(spark, sf_dir)
    g = gold_counts(w.drop("run"), V.tickets(spark, sf_dir))
    s = V.states(spark, sf_dir).select("window_id", "expected_in_memory")
    out = attach_gold(w.join(s, "window_id", "left"), g, "label", "expected_in_memory")
    return out.select("window_id", "label", "n_gold", "is_novel")


def j1_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: how many tickets of its family were there before it, and the latest of them."""
    w, k = V.windows(spark, sf_dir), V.tickets(spark, sf_dir)
    out = asof_join(w.select("window_id", "family", "start_us"), k.select("ticket_id", "family", "ts_us"), ["family"], "start_us", "ts_us", "ticket_id", width=6 * 3_600_000_000)
    return out.select("window_id", "n_before", F.col("last_value").alias("latest_ticket"))


def j2_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold tickets of each window: how many, the first and the last by id."""
    return gold_counts(V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir)).filter("n_gold > 0")


def j4_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of windows less those of their episode's and service's last baseline window."""
    w = V.windows(spark, sf_dir)
    out = baseline_deltas(w, ["episode", "service"], ["start_us", "window_id"], F.col("window_type") == "pre_fault_baseline", V.FEATURES)
    return out.select("window_id", *[F.round(f"{f}_delta", 6).alias(f"{f.removeprefix('triage_feature_')}_delta") for f in V.FEATURES])


def j7_shared_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tickets of a family that share a component, with the similarity of their causes' words; weak ones and strong ones (> 0.15)."""
    k = table(spark, sf_dir, "kg_tickets").filter("family is not null").dropDuplicates(["ticket_id"])
    c = entity_rows(k, "ticket_id", {"component": "components"}).join(k.select("ticket_id", "family"), "ticket_id").select("ticket_id", "family", "value")
    pairs = self_pairs(c, ["family", "value"], "ticket_id").select("id_a", "id_b").distinct()
    words = k.select("ticket_id", T.symptom_words(F.col("root_cause")).alias("ws"))
    pairs = pairs.join(words.select(F.col("ticket_id").alias("id_a"), F.col("ws").alias("x")), "id_a").join(words.select(F.col("ticket_id").alias("id_b"), F.col("ws").alias("y")), "id_b")
    every = F.size(F.array_union("x", "y"))
    sim = F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("x", "y")) / every)
    return pairs.select("id_a", "id_b", F.round(sim, 6).alias("similarity"), (sim > 0.15).alias("strong"))


def j9_word_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ticket its five most similar earlier tickets of the family by words (Jaccard >= 0.10)."""
    k = V.tickets(spark, sf_dir).select(F.col("ticket_id").alias("id"), "family", F.col("ts_us").alias("t"), T.corpus_words(F.concat_ws(" ", "root_cause", "fix")).alias("ws"))
    best = jaccard_top(k, k, F.col("ws"), F.col("ws"), 5, 0.10, within="family", earlier=True)
    return best.select(F.col("left_id").alias("id"), F.col("right_id").alias("ticket_id"), F.col("score").alias("similarity"), "rank_no")


def j10_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window the ticket that shares most with it: weighted score and number of shared entities."""
    a = entity_records(table(spark, sf_dir, "window_entities"), "window_id", FIELDS, WEIGHTS)
    b = entity_records(table(spark, sf_dir, "kg_tickets"), "ticket_id", FIELDS, WEIGHTS)
    return entity_top(a, b, 1).select(F.col("left_id").alias("window_id"), F.col("right_id").alias("ticket_id"), "score", "n_shared")


def j13_common_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows for which every pipeline has a hit."""
    return common_to_all(V.ranked(spark, sf_dir), "window_id", "pipeline_name")


def j14_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top tickets of two pipelines side by side, for windows that have both."""
    r = V.ranked(spark, sf_dir, 1)
    a = r.filter("pipeline_name = 'bm25_retrieval'").select("window_id", F.col("issue_id").alias("bm25_top"))
    b = r.filter("pipeline_name = 'bi_encoder_retrieval'").select("window_id", F.col("issue_id").alias("dense_top"))
    return a.join(b, "window_id").withColumn("same", F.col("bm25_top") == F.col("dense_top"))


def j15_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by the number of tickets of their service at or before their start, in depth buckets."""
    w = V.windows(spark, sf_dir).select("window_id", "service", "start_us")
    k = V.tickets(spark, sf_dir).select("ticket_id", "ts_us", F.explode("services").alias("service"))
    out = asof_join(w, k, ["service"], "start_us", "ts_us", "ticket_id", width=6 * 3_600_000_000, inclusive=True)
    n = F.col("n_before")
    bucket = F.when(F.col("service").isNull(), "unknown").when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 20, "6-20").otherwise("21+")
    return out.groupBy(bucket.alias("depth")).agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_before").alias("n_tickets"))


def j16_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool of hard negatives: a window's retrieved tickets that are not gold and not among the lexical top five."""
    r = V.ranked(spark, sf_dir)
    pool = r.select("window_id", F.col("issue_id").alias("ticket_id")).distinct()
    gold = gold_pairs(pool, V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir), "ticket_id")
    lexical = r.filter("pipeline_name = 'bm25_retrieval' and rank_no <= 5").select("window_id", F.col("issue_id").alias("ticket_id"))
    left = pool.join(gold, ["window_id", "ticket_id"], "left_anti").join(lexical, ["window_id", "ticket_id"], "left_anti")
    return left.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_negatives"), F.min("ticket_id").alias("first_negative"))


def j17_same_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window the three latest earlier windows of its family from other episodes (of the same service)."""
    w = V.windows(spark, sf_dir)
    found = recent_others(w, ["family", "service"], "window_id", "episode", "start_us", 3, F.floor(F.col("start_us") / (6 * 3_600_000_000)))
    return found.select(F.col("id").alias("window_id"), "other", F.col("place").alias("rank_no"))


def u4_first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each object with the same reason and start of the message."""
    e = table(spark, sf_dir, "k8s_events").filter("object_name is not null and ts_ns > 0")
    k = e.select("object_name", F.lower(F.btrim("reason")).alias("reason"), F.substring("message", 1, 80).alias("start"), "ts_ns", "event_uid")
    return k.groupBy("object_name", "reason", "start").agg(F.min(F.struct("ts_ns", "event_uid")).alias("f"), F.count_distinct("event_uid").alias("n")).select("object_name", "reason", "start", F.col("f.event_uid").alias("event_uid"), "n")


def u5_complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a gold hit among the top five of one pipeline, of the other, of both."""
    hit = gold_pairs(V.ranked(spark, sf_dir, 5), V.windows(spark, sf_dir).drop("run"), V.tickets(spark, sf_dir))
    flags = hit.groupBy("window_id").agg(F.max(F.col("pipeline_name") == "kg_retrieval").alias("kg"), F.max(F.col("pipeline_name") == "bi_encoder_retrieval").alias("dense"))
    return flags.agg(F.count_if(F.col("kg") & F.col("dense")).alias("both"), F.count_if(F.col("kg") & ~F.col("dense")).alias("only_kg"), F.count_if(~F.col("kg") & F.col("dense")).alias("only_dense"))


def p1_manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of each window by its run's latest manifest; '__unassigned__' where it names none."""
    names = assigned_windows(table(spark, sf_dir, "split_manifest"))
    w = V.windows(spark, sf_dir).select("window_id").join(names, "window_id", "left")
    return w.select("window_id", F.coalesce("split", F.lit("__unassigned__")).alias("split"))


def p2_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of leave-one-family-out folds: windows held out and windows to train on; folds without windows left out."""
    w = V.windows(spark, sf_dir).filter("family is not null").select(T.family_key(F.col("family")).alias("family"))
    n = w.groupBy("family").agg(F.count(F.lit(1)).alias("n_eval"))
    folds = valid_manifest(table(spark, sf_dir, "split_manifest")).select(F.explode("leave_one_family_out_folds").alias("family")).filter("family is not null").select(T.family_key(F.col("family")).alias("family")).distinct()
    total = w.agg(F.count(F.lit(1)).alias("n"))
    return n.join(folds, "family", "left_semi").crossJoin(F.broadcast(total)).select("family", "n_eval", (F.col("n") - F.col("n_eval")).alias("n_train"))


def p4_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/15/15 within each family in a fixed hashed order; train and validation are rounded, test takes the rest."""
    r = hashed_numbers(V.windows(spark, sf_dir).filter("family is not null").select("window_id", "family"), ["family"], "window_id", "42")
    train, val = F.expr("(of * 70 + 50) div 100"), F.expr("(of * 15 + 50) div 100")
    return r.select("window_id", F.when(F.col("place") <= train, "train").when(F.col("place") <= train + val, "validation").otherwise("test").alias("split"))


def p7_flat_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes: windows, services, phases, first start and last start."""
    w = V.windows(spark, sf_dir).filter("episode is not null")
    return w.groupBy("episode").agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct("service").alias("n_services"), F.count_distinct("window_type").alias("n_phases"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


def s20_last_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of windows by label after late corrections: the row received last holds."""
    w = latest_rows(table(spark, sf_dir, "telemetry_windows").select("window_id", "triage_label", "source", "ingested_at"), ["window_id"], ["ingested_at", "triage_label"])
    return w.groupBy("triage_label", "source").agg(F.count(F.lit(1)).alias("n"))


def s22_entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of windows that have extracted entities, by phase."""
    e = table(spark, sf_dir, "window_entities").select("window_id").distinct().withColumn("has", F.lit(1))
    w = V.windows(spark, sf_dir).join(e, "window_id", "left")
    return w.groupBy("window_type").agg(F.count(F.lit(1)).alias("n_windows"), F.count("has").alias("n_covered"), F.round(F.count("has") / F.count(F.lit(1)), 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (s7_gold_attach, j1_visible, j2_gold, j4_deltas, j7_shared_components, j9_word_gold, j10_shared_entities, j13_common_windows, j14_paired, j15_depth, j16_negatives, j17_same_family, u4_first_messages, u5_complementarity)}
QUERIES |= {"split_manifest": p1_manifest_split, "split_leave_one_out": p2_leave_one_out, "split_stratified": p4_stratified_split, "flat_episodes": p7_flat_episodes, "s20_last_delivery": s20_last_delivery, "s22_entity_coverage": s22_entity_coverage}

_ENTITIES = " union all ".join(f"select {{key}}, '{kind}' as kind, unnest({c}) as v from {{table}} where {{key}} is not null" for kind, c in FIELDS.items())
_ENT = "select distinct {key}, kind, lower(trim(v)) as value from (" + _ENTITIES + ") where v is not null and trim(v) <> ''"
_SYM = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(root_cause, '')), '[a-z][a-z0-9_]{{2,}}'), lambda x: x not in ({', '.join(repr(w) for w in T.SYMPTOM_STOP_WORDS)})))"
_CORP = "list_distinct(list_transform(regexp_extract_all(coalesce(concat_ws(' ', root_cause, fix), ''), '[A-Za-z_][A-Za-z_0-9]{2,}'), lambda x: lower(x)))"
_DELTA = ", ".join(f"round(case when w.window_type = 'pre_fault_baseline' or b.episode is null and b.service is null and b.n is null then 0.0 else coalesce(w.{f}, 0.0) - coalesce(b.{f}, 0.0) end, 6) as {f.removeprefix('triage_feature_')}_delta" for f in V.FEATURES)

SQL = {
    "s7_gold_attach": f"with {V.WINDOWS}, {V.TICKETS}, {V.STATES}, {V.GOLD}, n as (select window_id, count(*) as n from g group by 1), x as (select w.window_id, label, case when label in ('ticket_worthy', 'borderline') and expected_in_memory is distinct from false then coalesce(n, 0) else 0 end as n_gold from w left join s on w.window_id = s.window_id left join n on w.window_id = n.window_id) select window_id, label, n_gold, case when label = 'ticket_worthy' then n_gold = 0 when label = 'borderline' then false end as is_novel from x",
    "j1_visible": f"with {V.WINDOWS}, {V.TICKETS}, x as (select window_id, count(ticket_id) as n_before, arg_max(ticket_id, (ts_us, ticket_id)) as latest_ticket from w left join k on w.family = k.family and k.ts_us < w.start_us group by 1) select window_id, n_before, latest_ticket from x",
    "j2_gold": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD} select window_id, count(*) as n_gold, min(ticket_id) as first_gold, max(ticket_id) as last_gold from g group by 1",
    "j4_deltas": f"with {V.WINDOWS}, b as (select *, 1 as n from w where window_type = 'pre_fault_baseline' qualify row_number() over (partition by episode, service order by start_us desc nulls last, window_id desc) = 1) select w.window_id, {_DELTA} from w left join b on w.episode is not distinct from b.episode and w.service is not distinct from b.service",
    "j7_shared_components": f"with k as (select distinct ticket_id, family, root_cause, components from kg_tickets where family is not null), c as (select distinct ticket_id, family, lower(trim(v)) as value from (select ticket_id, family, unnest(components) as v from k) where v is not null and trim(v) <> ''), p as (select distinct a.ticket_id as id_a, b.ticket_id as id_b from c a join c b on a.family = b.family and a.value = b.value and a.ticket_id < b.ticket_id), s as (select distinct ticket_id, {_SYM} as ws from k), x as (select id_a, id_b, len(list_intersect(a.ws, b.ws)) as n, len(list_distinct(list_concat(a.ws, b.ws))) as u from p join s a on id_a = a.ticket_id join s b on id_b = b.ticket_id) select id_a, id_b, round(case when u = 0 then 0.0 else n / u end, 6) as similarity, case when u = 0 then 0.0 else n / u end > 0.15 as strong from x",
    "j9_word_gold": f"with {V.TICKETS}, e as (select ticket_id, family, ts_us, {_CORP} as ws from k where family is not null), x as (select a.ticket_id as id, b.ticket_id, len(list_intersect(a.ws, b.ws)) as n, len(a.ws) + len(b.ws) as m from e a join e b on a.family = b.family and b.ts_us < a.ts_us), y as (select id, ticket_id, round(n / greatest(m - n, 1), 6) as similarity from x) select id, ticket_id, similarity, cast(row_number() over (partition by id order by similarity desc, ticket_id) as integer) as rank_no from y where similarity >= 0.10 qualify rank_no <= 5",
    "j10_shared_entities": f"with a as ({_ENT.format(key='window_id', table='window_entities')}), b as ({_ENT.format(key='ticket_id', table='kg_tickets')}), x as (select window_id, ticket_id, sum(case a.kind when 'service' then 2.0 when 'component' then 1.5 when 'error' then 3.0 else 1.0 end) as score, count(*) as n_shared from a join b on a.kind = b.kind and a.value = b.value group by 1, 2) select window_id, ticket_id, cast(score as double) as score, n_shared from x qualify row_number() over (partition by window_id order by score desc, ticket_id) = 1",
    "j13_common_windows": f"with {V.RANKED} select window_id from r group by 1 having count(distinct pipeline_name) = (select count(distinct pipeline_name) from r)",
    "j14_paired": f"with {V.RANKED}, a as (select window_id, issue_id as bm25_top from r where pipeline_name = 'bm25_retrieval' and rank_no = 1), b as (select window_id, issue_id as dense_top from r where pipeline_name = 'bi_encoder_retrieval' and rank_no = 1) select a.window_id, bm25_top, dense_top, bm25_top = dense_top as same from a join b on a.window_id = b.window_id",
    "j15_depth": f"with {V.WINDOWS}, {V.TICKETS}, t as (select ticket_id, ts_us, unnest(services) as svc from k), x as (select window_id, any_value(service) as service, count(ticket_id) as n from w left join t on w.service = t.svc and t.ts_us <= w.start_us group by 1) select case when service is null then 'unknown' when n = 0 then '0' when n <= 2 then '1-2' when n <= 5 then '3-5' when n <= 20 then '6-20' else '21+' end as depth, count(*) as n_windows, cast(sum(n) as bigint) as n_tickets from x group by 1",
    "j16_negatives": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED}, p as (select distinct window_id, issue_id from r except select window_id, ticket_id from g except select window_id, issue_id from r where pipeline_name = 'bm25_retrieval' and rank_no <= 5) select window_id, count(*) as n_negatives, min(issue_id) as first_negative from p group by 1",
    "j17_same_family": f"with {V.WINDOWS}, x as (select a.window_id, b.window_id as other, b.start_us as t from w a join w b on a.family = b.family and a.service = b.service and b.start_us < a.start_us and a.episode is distinct from b.episode) select window_id, other, cast(row_number() over (partition by window_id order by t desc, other) as integer) as rank_no from x qualify rank_no <= 3",
    "u4_first_messages": "with e as (select object_name, lower(trim(reason)) as reason, substring(message, 1, 80) as start, ts_ns, event_uid from k8s_events where object_name is not null and ts_ns > 0) select object_name, reason, start, arg_min(event_uid, (ts_ns, event_uid)) as event_uid, count(distinct event_uid) as n from e group by 1, 2, 3",
    "u5_complementarity": f"with {V.WINDOWS}, {V.TICKETS}, {V.GOLD}, {V.RANKED}, f as (select r.window_id, bool_or(pipeline_name = 'kg_retrieval') as kg, bool_or(pipeline_name = 'bi_encoder_retrieval') as dense from r join g on r.window_id = g.window_id and r.issue_id = g.ticket_id where rank_no <= 5 group by 1) select count(*) filter (kg and dense) as both, count(*) filter (kg and not dense) as only_kg, count(*) filter (dense and not kg) as only_dense from f",
    "split_manifest": f"with {V.WINDOWS}, m as (select distinct e.key as window_id, lower(trim(e.value)) as name from (select unnest(map_entries(window_assignment)) as e from split_manifest qualify generated_at is not distinct from max(generated_at) over (partition by dataset_run_id))), n as (select distinct window_id, case when name in ('train', 'training') then 'train' when name in ('val', 'valid', 'validation', 'dev') then 'validation' when name in ('test', 'testing') then 'test' end as split from m) select w.window_id, coalesce(split, '__unassigned__') as split from w left join (select * from n where split is not null) n on w.window_id = n.window_id",
    "split_leave_one_out": f"with {V.WINDOWS}, n as (select regexp_replace(lower(trim(family)), '[-_ ]+', '-', 'g') as family, count(*) as n_eval from w where family is not null group by 1), v as (select leave_one_family_out_folds as f from split_manifest qualify generated_at is not distinct from max(generated_at) over (partition by dataset_run_id)) select family, n_eval, (select sum(n_eval) from n)::bigint - n_eval as n_train from n where family in (select regexp_replace(lower(trim(x)), '[-_ ]+', '-', 'g') from (select unnest(f) as x from v) where x is not null)",
    "split_stratified": f"with {V.WINDOWS}, r as (select window_id, row_number() over (partition by family order by md5('42|' || window_id), window_id) as r, count(*) over (partition by family) as n from w where family is not null) select window_id, case when r <= (n * 70 + 50) // 100 then 'train' when r <= (n * 70 + 50) // 100 + (n * 15 + 50) // 100 then 'validation' else 'test' end as split from r",
    "flat_episodes": f"with {V.WINDOWS} select episode, count(*) as n_windows, count(distinct service) as n_services, count(distinct window_type) as n_phases, min(start_us) as first_us, max(start_us) as last_us from w where episode is not null group by 1",
    "s20_last_delivery": "with w as (select window_id, triage_label, source from telemetry_windows qualify row_number() over (partition by window_id order by ingested_at desc nulls last, triage_label desc nulls last) = 1) select triage_label, source, count(*) as n from w group by 1, 2",
    "s22_entity_coverage": f"with {V.WINDOWS}, e as (select distinct window_id from window_entities) select window_type, count(*) as n_windows, count(e.window_id) as n_covered, round(count(e.window_id) / count(*), 6) as coverage from w left join e on w.window_id = e.window_id group by 1",
}
