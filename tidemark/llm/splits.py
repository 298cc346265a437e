"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import family_key, trimmed  # noqa: F401 - used by the queries
from tidemark.operators.components import connected_components
from tidemark.operators.manifest import SPLIT_NAMES, assigned_windows, split_name, valid_manifest  # noqa: F401 - used by the queries
from tidemark.operators.skew import skew_join
from tidemark.session import cut

def related_groups(records: DataFrame, key: str, entities: Sequence[Column]) -> DataFrame:
    """(key, component): records that share an entity, directly or over others, share a component.

    `entities` are string columns with distinct prefixes, in the order in which
    one is preferred to stand for the record; null ones link nothing. A record
    may have several rows, and repeated rows count once. A record without
    entities is a component of its own. Records with a null key are left out.
    The graph has entities as nodes, not records: a record only adds an edge
    where it holds two of them.
    """
    marked = [F.concat(F.lit(f"{i}:"), c) for i, c in enumerate(entities)]
    own = F.concat(F.lit(f"{len(marked)}:"), F.col(key))
    long = records.filter(F.col(key).isNotNull()).select(F.col(key), F.explode(F.array(*marked, own)).alias("_e")).filter("_e is not null").distinct()
    lead = long.groupBy(key).agg(F.min("_e").alias("_lead"))
    plain = f"{len(marked)}:"
    edges = long.filter(~F.col("_e").startswith(plain)).join(lead, key).filter("_e <> _lead").select(F.col("_e").alias("src"), F.col("_lead").alias("dst")).distinct()
    parts = connected_components(edges)
    joined = skew_join(lead.withColumnRenamed("_lead", "node"), parts, "node", "left")
    return joined.select(key, F.coalesce("component", "node").alias("component"))


def split_of(component: Column, shares: Sequence[tuple[str, float]], seed: str = "") -> Column:
    """The split of a component: its hash falls into one of the ranges that the shares cut from [0, 1)."""
    at = F.pmod(F.xxhash64(F.lit(seed), component), F.lit(1 << 40)) / F.lit(float(1 << 40))
    total, done, out = sum(s for _, s in shares), 0.0, None
    for name, share in shares[:-1]:
        done += share / total
        out = F.when(at < done, name) if out is None else out.when(at < done, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def _balance(heavy: Sequence[tuple[str, int]], n: int, shares: Sequence[tuple[str, float]]) -> tuple[dict[str, str], list[tuple[str, float]]]:
    """Splits of the heavy components (largest first, each to the split that lacks most), and what the splits still lack."""
    total = sum(s for _, s in shares)
    lack = {name: n * s / total for name, s in shares}
    placed = {}
    for component, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        name = max(lack, key=lambda k: (lack[k], k))
        placed[component] = name
        lack[name] -= size
    left = [(name, max(0.0, lack[name])) for name, _ in shares]
    return placed, left if sum(x for _, x in left) > 0 else list(shares)


def grouped_splits(records: DataFrame, key: str, entities: Sequence[Column], shares: Sequence[tuple[str, float]] = (("train", 0.7), ("validation", 0.15), ("test", 0.15)), seed: str = "", heavy: float = 0.01) -> DataFrame:
    """(key, group_key, split): every record with its group's smallest key and the group's split.

    The component's hash falls into ranges proportional to the shares. A hash
    spreads many small groups well but not a few large ones, so components with
    at least `heavy` of all records (1 / heavy of them at most) are placed
    first, largest first, and the ranges of the others are cut from what the
    splits still lack. A group never lies in two splits; one that is larger than
    every split's share takes its split beyond it.
    """
    groups = cut(related_groups(records, key, entities))
    sizes = cut(groups.groupBy("component").agg(F.min(key).alias("group_key"), F.count(F.lit(1)).alias("n")))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    placed, left = _balance([tuple(r) for r in sizes.filter(F.col("n") >= max(1.0, n * heavy)).select("component", "n").collect()] if n * heavy >= 1 else [], n, shares)
    split = split_of(F.col("component"), left, seed)
    for component, name in placed.items():
        split = F.when(F.col("component") == component, name).otherwise(split)
    named = sizes.select("component", "group_key", split.alias("split"))
    return skew_join(groups, named, "component").select(key, "group_key", "split")


def torn_groups(groups: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """(group_key, split): groups whose records lie in two splits or more, a row for each of these.

    `groups` is (key, component), `assigned` is (key, split). Records without a
    split count for the group's smallest key only.
    """
    rows = groups.join(assigned, key, "left")
    found = rows.groupBy("component").agg(F.min(key).alias("group_key"), F.collect_set("split").alias("splits"))
    return found.filter(F.size("splits") > 1).select("group_key", F.explode("splits").alias("split"))
