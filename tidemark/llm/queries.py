"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import token_ids
from tidemark.llm.leakage import leaked_passages
from tidemark.llm.overlap import cross_side_classes, evidence, record_pairs
from tidemark.llm.runs import collapse_runs, long_sequences
from tidemark.llm.setjoin import hashed_sets, id_pairs, similar_sets
from tidemark.llm.spam import stuffed_pages
from tidemark.llm.splits import assigned_windows, family_key, grouped_splits, related_groups, torn_groups, trimmed, valid_manifest
from tidemark.llm.topn import top_n
from tidemark.operators.logs import entry_bodies
from tidemark.session import cut, keep
from tidemark.tables import table


def _related(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    states = table(spark, sf_dir, "window_states").select("window_id", "scenario_family", "incident_id")
    return states, [F.col("incident_id"), family_key(F.col("scenario_family"))]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of related windows that the valid manifest tears apart, a row for each of their splits."""
    states, entities = _related(spark, sf_dir)
    groups = related_groups(states, "window_id", entities)
    found = torn_groups(groups, assigned_windows(table(spark, sf_dir, "split_manifest")), "window_id")
    return found.select(F.col("group_key").alias("group_window_id"), "split")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every window, with all related windows in the same one."""
    states, entities = _related(spark, sf_dir)
    return grouped_splits(states, "window_id", entities, seed="windows").withColumnRenamed("group_key", "group_window_id")


def p1_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out families of the valid manifest whose group also has windows outside the family: such a fold leaks."""
    states, entities = _related(spark, sf_dir)
    groups = cut(related_groups(states, "window_id", entities))
    families = states.select("window_id", family_key(F.col("scenario_family")).alias("family")).filter("window_id is not null").distinct()
    held = valid_manifest(table(spark, sf_dir, "split_manifest")).select(F.explode("leave_one_family_out_folds").alias("f")).select(family_key(F.col("f")).alias("family")).filter("family is not null").distinct()
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n_windows"), F.min("window_id").alias("group_window_id"))
    inside = families.join(groups, "window_id").groupBy("family", "component").agg(F.count(F.lit(1)).alias("n_held_out"))
    return inside.join(held, "family").join(sizes, "component").filter("n_held_out < n_windows").select("family", "group_window_id", "n_held_out", (F.col("n_windows") - F.col("n_held_out")).alias("n_others"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best tickets of every window and pipeline."""
    top = top_n(table(spark, sf_dir, "hits"), ["window_id", "pipeline_name"], "issue_id", "score", n=5, scale="pipeline_name")
    return top.select("window_id", "pipeline_name", F.col("rank_no").alias("hit_rank"), "issue_id")


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    windows = table(spark, sf_dir, "telemetry_windows")
    texts = windows.select(F.col("window_id").alias("id"), F.col("triage_evidence_text").alias("text"))
    sides = assigned_windows(table(spark, sf_dir, "split_manifest")).select(F.col("window_id").alias("id"), (F.col("split") != "train").alias("is_eval"))
    return cross_side_classes(texts, sides, threshold=0.6, n=3, least=20, prepare=evidence)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a validation or test window and a train window with nearly the same evidence."""
    pairs = record_pairs(*_overlaps(spark, sf_dir)).filter("eval_id <> train_id")
    return pairs.select(F.least("eval_id", "train_id").alias("window_id_a"), F.greatest("eval_id", "train_id").alias("window_id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, source and expected_in_memory: leaking evaluation windows, their pairs, and the mean best containment.

    The containment of an evaluation window in a train window is the share of
    its word 3-grams that the train window holds. Counts are by class, so copies
    are not expanded into pairs. A window's source is that of its row received
    last, its expected_in_memory that of its decision recorded last.
    """
    members, pairs = _overlaps(spark, sf_dir)
    members = cut(members)
    trains = members.filter("not is_eval").groupBy("rep").agg(F.count(F.lit(1)).alias("n_train")).withColumnRenamed("rep", "rep_b")
    best = pairs.join(trains, "rep_b").groupBy("rep_a").agg(F.sum("n_train").alias("n_pairs"), F.max(F.col("shared") / F.col("size_a")).alias("containment"))
    leaks = members.filter("is_eval").join(best, F.col("rep") == F.col("rep_a")).select("id", "n_pairs", "containment")
    split = assigned_windows(table(spark, sf_dir, "split_manifest")).filter("split <> 'train'").withColumnRenamed("window_id", "id")
    source = table(spark, sf_dir, "telemetry_windows").groupBy(F.col("window_id").alias("id")).agg(F.max_by("source", "ingested_at").alias("source"))
    memory = table(spark, sf_dir, "window_states").groupBy(F.col("window_id").alias("id")).agg(F.max_by("expected_in_memory", "recorded_at").alias("expected_in_memory"))
    rows = leaks.join(split, "id").join(source, "id", "left").join(memory, "id", "left")
    return rows.groupBy("split", "source", "expected_in_memory").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_pairs").alias("n_pairs"), F.round(F.avg("containment"), 6).alias("containment"))


def _template(c):
    """Lower-cased, each run that holds a digit as '#', runs of white space as one space, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)(?<!\S)[^\s0-9]*+[0-9]\S*", "#"), r"(?U)\s+", " "))


def _marks(kind: str, group: list, text):
    """Tokens of an event: the words of its text without digits, each together with `group`, so that events of other groups have nothing in common."""
    words = F.array_distinct(F.filter(F.split(text, " "), lambda w: (w != "") & (w != "#")))
    return F.transform(words, lambda w: F.xxhash64(F.lit(kind), *[x for c in group for x in (F.coalesce(c, F.lit("")), F.lit("/"))], w)).alias("tokens")


def _event_runs(spark: SparkSession, sf_dir: str, with_tokens: bool) -> DataFrame:
    lines, events = table(spark, sf_dir, "log_lines"), table(spark, sf_dir, "k8s_events")
    kind = lambda k: F.lit(k).alias("seq_kind")
    entries = entry_bodies(lines, templated=True).select(
        kind("log"), F.col("stream_id").alias("seq_id"), F.col("first_line").alias("pos"), F.col("first_line").alias("at"), F.lit(0).cast("bigint").alias("at2"), F.col("ts_us").alias("t"), F.xxhash64(F.lit("log"), "level", F.lit("/"), "component", F.lit("/"), "body").alias("sig"), *([_marks("log", [F.col("level"), F.col("component")], F.col("body"))] if with_tokens else [])
    )
    events = events.filter("object_name is not null and event_uid is not null and ts_ns is not null and ts_ns <> 0").dropDuplicates(["object_name", "event_uid", "ts_ns"])
    events = events.select(
        kind("k8s"), F.col("object_name").alias("seq_id"), F.col("event_uid").alias("pos"), F.col("ts_ns").alias("at"), F.col("event_uid").alias("at2"), F.col("ts_ns").alias("t"), F.xxhash64(F.lit("k8s"), F.lower(trimmed(F.col("reason"))), F.lit("/"), _template(F.col("message"))).alias("sig"), *([_marks("k8s", [F.lower(trimmed(F.col("reason")))], _template(F.col("message")))] if with_tokens else [])
    )
    keys = ["seq_kind", "seq_id"]
    rows = lines.select(kind("log"), F.col("stream_id").alias("seq_id"), F.col("line_no").alias("at")).unionByName(events.select("seq_kind", "seq_id", "at"))
    runs = collapse_runs(entries.unionByName(events), keys, long_sequences(rows.filter("seq_id is not null"), keys, "at"), penalty=0.25, least=2, with_tokens=with_tokens)
    us = F.when(F.col("seq_kind") == "k8s", F.expr("(t_last - t_first) div 1000")).otherwise(F.col("t_last") - F.col("t_first"))
    return runs.select("seq_kind", "seq_id", "first_pos", "n_events", us.cast("bigint").alias("duration_us"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more alike log entries of a stream, and alike events of a cluster object."""
    return _event_runs(spark, sf_dir, False)


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more near-identical log entries or events: level and component, or reason, are equal, messages share most words."""
    return _event_runs(spark, sf_dir, True)


_ITEMS = [("c", "components"), ("s", "symptoms"), ("e", "error_classes")]


def _similar_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    windows, tickets = table(spark, sf_dir, "window_entities"), table(spark, sf_dir, "kg_tickets")
    sets = hashed_sets(windows, "window_id", _ITEMS).unionByName(hashed_sets(tickets, "ticket_id", _ITEMS))
    return similar_sets(sets, threshold=0.7, least=5, n_records=windows.count() + tickets.count())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of windows and tickets whose items overlap with a Jaccard similarity of 0.7 or more."""
    return id_pairs(*_similar_entities(spark, sf_dir))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record in a set class: its class, the class's records and its links to other classes."""
    members, pairs = _similar_entities(spark, sf_dir)
    members, pairs = keep(members), keep(pairs)
    ends = pairs.select(F.col("rep_a").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_equal"))
    return members.join(sizes, "rep").join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), "n_equal", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of an evaluation item."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents, sources and the longest passage found, in words and as a share of the item."""
    docs = table(spark, sf_dir, "documents")
    runs = leaked_passages(docs, table(spark, sf_dir, "eval_passages")).join(docs.select("doc_id", "source"), "doc_id")
    found = runs.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.max("longest").alias("longest"), F.max("item_words").alias("item_words"))
    return found.withColumn("share", F.round(F.col("longest") / F.col("item_words"), 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which more than half of the words are repeated keywords, links or tags."""
    return stuffed_pages(table(spark, sf_dir, "documents"), "doc_id").select("doc_id")


QUERIES = {"p10_found": p10_found, "p2_found": p2_found, "p2_links": p2_links, "p8_ids": p8_ids, "p9_found": p9_found, "p9_report": p9_report, "p7_found": p7_found, "p7_near": p7_near, "p5_found": p5_found, "p5_report": p5_report, "p1_found": p1_found, "p1_splits": p1_splits, "p1_folds": p1_folds, "p3_found": p3_found}

_VALID = """m as (
  select distinct e.key as window_id, case when lower(trim(e.value)) in ('train', 'training') then 'train'
    when lower(trim(e.value)) in ('val', 'validation') then 'validation' when lower(trim(e.value)) = 'test' then 'test' end as split
  from (select unnest(map_entries(window_assignment)) as e from split_manifest
        qualify generated_at is not distinct from max(generated_at) over (partition by dataset_run_id)))"""
_GROUPS = """e as (
  select window_id, '0:' || incident_id as n from window_states where incident_id is not null
  union select window_id, '1:' || regexp_replace(lower(trim(scenario_family)), '[-_ ]+', '-', 'g') from window_states where scenario_family is not null),
sym as (select distinct a.n as a, b.n as b from e a join e b on a.window_id = b.window_id),
reach as (select distinct n, n as m from e union select r.n, sym.b from reach r join sym on r.m = sym.a),
c as (select n, min(m) as c from reach group by 1),
g as (select w.window_id, coalesce(min(c.c), '2:' || w.window_id) as c from (select distinct window_id from window_states where window_id is not null) w
      left join e on w.window_id = e.window_id left join c on e.n = c.n group by w.window_id)"""


def _items(key: str, source: str) -> str:
    parts = [f"select {key} as id, '{k}:' || lower(trim(v)) as item from (select {key}, unnest({c}) as v from {source}) where v is not null and trim(v) <> ''" for k, c in _ITEMS]
    return " union ".join(parts)


SQL = {
    "p1_found": f"""
with recursive {_VALID}, {_GROUPS},
s as (select c, min(g.window_id) as group_window_id, list(distinct split) filter (split is not null) as splits from g left join m on g.window_id = m.window_id group by c)
select group_window_id, unnest(splits) as split from s where len(splits) > 1""",
    "p2_found": f"""
with i as ({_items("window_id", "window_entities")} union {_items("ticket_id", "kg_tickets")}),
n as (select id, count(*) as n from i group by 1 having count(*) >= 5),
x as (select a.id as id_a, b.id as id_b, count(*) as k from i a join i b on a.item = b.item and a.id < b.id group by 1, 2)
select id_a, id_b from x join n a on id_a = a.id join n b on id_b = b.id where k >= 0.7 * (a.n + b.n - k) - 1e-9""",
    "p5_found": f"""
with {_VALID},
t as (select window_id, max(triage_evidence_text) as t from telemetry_windows where triage_evidence_text is not null group by 1),
l as (select window_id, array_to_string(list_filter(regexp_split_to_array(t, '[\\r\\n]'), lambda x: not starts_with(x, 'WINDOW ')), chr(10)) as t from t),
w as (select window_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') as w from l),
g as (select distinct window_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from w where len(w) >= 20),
n as (select window_id, count(*) as n from g group by 1),
ev as (select distinct window_id from m where split <> 'train'), tr as (select distinct window_id from m where split = 'train'),
x as (select a.window_id as a, b.window_id as b, count(*) as k from g a join ev on a.window_id = ev.window_id join g b on a.gram = b.gram join tr on b.window_id = tr.window_id where a.window_id <> b.window_id group by 1, 2)
select distinct least(a, b) as window_id_a, greatest(a, b) as window_id_b from x join n na on a = na.window_id join n nb on b = nb.window_id where k >= 0.6 * (na.n + nb.n - k) - 1e-9""",
    "p3_found": """
with best as (
  select window_id, pipeline_name, issue_id, max(score) as score from hits
  where issue_id is not null and score is not null and not isnan(score) group by 1, 2, 3),
ranked as (
  select *, row_number() over (partition by window_id, pipeline_name order by score desc, issue_id) as r from best)
select window_id, pipeline_name, cast(r as integer) as hit_rank, issue_id from ranked where r <= 5""",
}
