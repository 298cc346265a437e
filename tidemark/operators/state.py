"""Per-service state over ordered decisions: recent windows, suppressed pages, inherited incidents, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import with_recent

LOOKBACK = 3


def suppression(df: DataFrame, service: str, order: Sequence[str], block: Column, lookback: int = LOOKBACK) -> DataFrame:
    """Rows with `suppressed` and `source_window`.

    A ticket-worthy row with a top match is suppressed if, going back over the
    last `lookback` rows of its service and stopping at a recovery window, one
    has the same top match and family; source_window is that row's window.
    Needs window_id, decision, top1_match, family, window_type. Null services
    are a service of their own; a null top match or family never matches.
    """
    r = with_recent(df, [service], order, ["window_id", "top1_match", "family", "window_type"], lookback, block)
    stop = F.array_position(F.transform("recent", lambda x: F.coalesce(x["window_type"], F.lit("")) == "recovery_window"), True)
    seen = F.when(stop > 0, F.slice("recent", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("recent"))
    match = F.filter(seen, lambda x: (x["top1_match"] == F.col("top1_match")) & (x["family"] == F.col("family")))
    worthy = (F.col("decision") == "ticket_worthy") & F.col("top1_match").isNotNull()
    r = r.withColumn("suppressed", F.coalesce(worthy & (F.size(match) > 0), F.lit(False)))
    return r.withColumn("source_window", F.when(F.col("suppressed"), F.get(match, F.lit(0))["window_id"])).select(*df.columns, "suppressed", "source_window")


def recent_views(df: DataFrame, service: str, order: Sequence[str], block: Column, n: int = 12) -> DataFrame:
    """Rows with views of the last n rows of their service: n_recent, n_same_top (leading rows with the latest top match), n_recoveries, saw_recovery, seen_family."""
    r = with_recent(df, [service], order, ["top1_match", "family", "window_type"], n, block)
    top = F.get("recent", F.lit(0))["top1_match"]
    differ = F.array_position(F.transform("recent", lambda x: ~F.coalesce(x["top1_match"] == top, F.lit(False))), True)
    other = F.array_position(F.transform("recent", lambda x: F.coalesce(x["window_type"], F.lit("")) != "recovery_window"), True)
    size = F.size("recent")
    return r.select(
        *df.columns,
        size.alias("n_recent"),
        F.when(differ > 0, differ - 1).otherwise(size.cast("bigint")).alias("n_same_top"),
        F.when(other > 0, other - 1).otherwise(size.cast("bigint")).alias("n_recoveries"),
        F.exists("recent", lambda x: F.coalesce(x["window_type"], F.lit("")) == "recovery_window").alias("saw_recovery"),
        F.exists("recent", lambda x: F.coalesce(x["family"] == F.col("family"), F.lit(False))).alias("seen_family"),
    )


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column) -> DataFrame:
    """Runs of equal consecutive values: keys, run value, first_order, n_rows. Runs are found per block and joined at the blocks' ends."""
    here = Window.partitionBy(*keys, "_b").orderBy(*order)
    r = df.withColumn("_b", block).withColumn("_new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(here))).cast("int"), F.lit(0)))
    r = r.withColumn("_i", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = r.groupBy(*keys, "_b", "_i").agg(F.first(value).alias("run_value"), F.min(F.struct(*order)).alias("_o"), F.count(F.lit(1)).alias("n_rows"))
    # Only the first piece of a block can continue the last piece of the block before.
    seq = Window.partitionBy(*keys).orderBy("_b", "_i")
    edge = pieces.groupBy(*keys, "_b").agg(F.max("_i").alias("_last"))
    p = pieces.join(edge, [*keys, "_b"])
    ends = p.filter((F.col("_i") == F.col("_last")) | (F.col("_i") == F.lit(1)) | (F.col("_i") == F.lit(0)))
    marked = ends.withColumn("_join", (F.col("_i") <= 1) & F.lag("run_value").over(seq).eqNullSafe(F.col("run_value")) & (F.lag("_b").over(seq) != F.col("_b")))
    marked = marked.withColumn("_g", F.sum(F.when(F.coalesce("_join", F.lit(False)), 0).otherwise(1)).over(seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    glued = marked.groupBy(*keys, "_g").agg(F.first("run_value").alias("run_value"), F.min("_o").alias("_o"), F.sum("n_rows").alias("n_rows"))
    inner = p.filter((F.col("_i") != F.col("_last")) & (F.col("_i") > 1)).select(*keys, "run_value", "_o", "n_rows")
    both = glued.select(*keys, "run_value", "_o", "n_rows").unionByName(inner)
    return both.select(*keys, "run_value", F.col("_o")[order[0]].alias("first_order"), "n_rows")
