"""Relations between windows and tickets: gold, baselines, shared entities, pools of negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join


#: Width of the time buckets in which tickets and windows meet.
GOLD_BUCKET_US = 6 * 3_600_000_000


def gold_counts(windows: DataFrame, tickets: DataFrame) -> DataFrame:
    """(window_id, n_gold, first_gold, last_gold): gold tickets of each window, and the least and greatest id among them.

    A ticket is gold for a window of its family and service that starts after
    it; a window without service takes any service, one without family or start
    has no gold. `windows` has window_id, family, service, start_us; `tickets`
    has ticket_id, family, services (array), ts_us. Where both have `reason`, it
    must be equal too; where both have `run`, tickets of the window's own run
    don't count (then the two ids are null). Counted along time by buckets, no
    pair is formed. Windows without gold have a row with 0.
    """
    reason = [c for c in ("reason",) if c in windows.columns and c in tickets.columns]
    runs = "run" in windows.columns and "run" in tickets.columns
    t = tickets.filter("family is not null and ts_us is not null").select("ticket_id", "family", "services", "ts_us", *reason, *(["run"] if runs else [])).distinct()
    by_service = t.select(*[c for c in t.columns if c != "services"], F.explode(F.array_distinct("services")).alias("service")).distinct()
    w = windows.select("window_id", "family", "service", "start_us", *reason, *(["run"] if runs else []))

    def counted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        join = lambda k, ends: asof_join(left, right.drop(*[c for c in ("run",) if c not in k]), k, "start_us", "ts_us", "ticket_id", width=GOLD_BUCKET_US, ends=ends)
        found = join(keys, not runs)
        if not runs:
            return found.select("window_id", F.col("n_before").alias("n_gold"), F.col("low_value").alias("first_gold"), F.col("high_value").alias("last_gold"))
        own = join([*keys, "run"], False).select("window_id", F.col("n_before").alias("_own"))
        none = F.lit(None).cast("string")
        return found.join(own, "window_id").select("window_id", (F.col("n_before") - F.col("_own")).alias("n_gold"), none.alias("first_gold"), none.alias("last_gold"))

    one = counted(w.filter("service is not null"), by_service, ["family", *reason, "service"])
    other = counted(w.filter("service is null"), t.drop("services"), ["family", *reason])
    return one.unionByName(other)


def gold_pairs(pairs: DataFrame, windows: DataFrame, tickets: DataFrame, item: str = "issue_id") -> DataFrame:
    """The rows of `pairs` (window_id, `item`, ...) whose ticket is gold for the window, by the rule of `gold_counts`.

    Each pair is tested on its own, so a hot family costs no more than its
    retrieved pairs. Pairs of unknown windows or tickets are no gold.
    """
    both = [c for c in ("reason", "run") if c in windows.columns and c in tickets.columns]
    w = windows.select("window_id", *[F.col(c).alias(f"_w_{c}") for c in ("family", "service", "start_us", *both)])
    t = tickets.select(F.col("ticket_id").alias(item), *[F.col(c).alias(f"_t_{c}") for c in ("family", "services", "ts_us", *both)])
    rule = (F.col("_w_family") == F.col("_t_family")) & (F.col("_t_ts_us") < F.col("_w_start_us")) & (F.col("_w_service").isNull() | F.array_contains("_t_services", F.col("_w_service")))
    if "reason" in both:
        rule = rule & (F.col("_w_reason") == F.col("_t_reason"))
    if "run" in both:
        rule = rule & ~F.col("_w_run").eqNullSafe(F.col("_t_run"))
    return pairs.join(w, "window_id").join(t, item).filter(rule).select(*pairs.columns)


def attach_gold(windows: DataFrame, counts: DataFrame, label: str, expected: str) -> DataFrame:
    """Windows with n_gold and is_novel.

    Only ticket_worthy and borderline windows are matched; a ticket_worthy one
    without match is novel. Where `expected` is false, there is no gold, and a
    ticket_worthy window is novel; null leaves the matches as they are.
    """
    rows = windows.join(counts.select("window_id", F.col("n_gold").alias("_n")), "window_id", "left")
    orphan = F.col(expected).eqNullSafe(False)
    matched = F.col(label).isin("ticket_worthy", "borderline") & ~orphan
    n_gold = F.when(matched, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    novel = F.when(F.col(label) == "ticket_worthy", n_gold == 0).otherwise(F.when(F.col(label) == "borderline", F.lit(False)))
    return rows.withColumn("n_gold", n_gold).withColumn("is_novel", novel).drop("_n")


def baseline_deltas(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_baseline: Column, features: Sequence[str]) -> DataFrame:
    """Rows with `<feature>_delta`: the feature less that of the last baseline row of the same keys.

    Zero for baseline rows and where there is no baseline; a null feature counts
    as zero. The last baseline is a maximum per key, combined before the shuffle.
    """
    base = rows.filter(is_baseline).groupBy(*keys).agg(F.max(F.struct(*order, *features)).alias("_base"))
    joined = rows.join(base.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_base"), F.expr(" and ".join(f"{k} <=> _k_{k}" for k in keys)), "left")
    zero = is_baseline | F.col("_base").isNull()
    return joined.select(*rows.columns, *[F.when(zero, F.lit(0.0)).otherwise(F.coalesce(F.col(f), F.lit(0.0)) - F.coalesce(F.col("_base")[f], F.lit(0.0))).alias(f"{f}_delta") for f in features])


def entity_rows(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, kind, value): distinct entities of array columns, trimmed and lower-cased; null and empty ones don't count."""
    arrays = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _entity(kind)) for kind, c in fields.items()]
    return df.select(key, F.explode(F.concat(*arrays)).alias("e")).select(key, "e.kind", "e.value").filter("value is not null and value <> ''").distinct()


def _entity(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(F.btrim(x)).alias("value"))


def top_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first n rows of every group in a total order. Spark cuts each task's rows to n before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def common_to_all(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key): keys that occur with every value of `member`."""
    total = df.select(F.count_distinct(member).alias("_all"))
    n = df.groupBy(key).agg(F.count_distinct(member).alias("_n"))
    return n.join(F.broadcast(total), F.col("_n") == F.col("_all")).select(key)


def entity_records(df: DataFrame, key: str, fields: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """(id, severity, family, t, items) for entity ranking: distinct entities of a record with the weight of their kind.

    Takes the greatest severity, family and t of a record's rows; missing
    columns are null.
    """
    arrays = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _weighted(kind, weights[kind])) for kind, c in fields.items()]
    plain = F.array_distinct(F.filter(F.concat(*arrays), lambda x: x["item"].isNotNull() & ~x["item"].isin(*[f"{k}:" for k in fields])))
    have = set(df.columns)
    other = [F.max(F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in (("severity", "string"), ("family", "string"), ("t", "bigint"))]
    rows = df.filter(F.col(key).isNotNull())
    return rows.groupBy(F.col(key).alias("id")).agg(*other, F.array_distinct(F.flatten(F.collect_set(plain))).alias("items"))


def _weighted(kind: str, weight: float):
    return lambda x: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(F.btrim(x))).alias("item"), F.lit(float(weight)).alias("w"))
