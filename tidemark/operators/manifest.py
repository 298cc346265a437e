"""Split manifests: the rows that hold, and the windows they assign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trimmed

#: Spellings of split names.
SPLIT_NAMES = {"train": "train", "training": "train", "val": "validation", "valid": "validation", "validation": "validation", "dev": "validation", "test": "test", "testing": "test"}


def split_name(c: Column) -> Column:
    """train, validation or test; null for any other name."""
    names = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return F.try_element_at(names, F.lower(trimmed(c)))


def valid_manifest(manifest: DataFrame) -> DataFrame:
    """The rows that hold: of each dataset_run_id those with its latest generated_at (a null time is earliest)."""
    latest = manifest.groupBy("dataset_run_id").agg(F.max("generated_at").alias("_latest")).withColumnRenamed("dataset_run_id", "_run")
    return manifest.join(latest, manifest["dataset_run_id"].eqNullSafe(latest["_run"]) & manifest["generated_at"].eqNullSafe(latest["_latest"])).drop("_run", "_latest")


def assigned_windows(manifest: DataFrame) -> DataFrame:
    """(window_id, split) of the valid manifest, each once. Unknown split names and null maps give no row."""
    rows = valid_manifest(manifest).select(F.explode("window_assignment").alias("window_id", "name"))
    return rows.select("window_id", split_name(F.col("name")).alias("split")).filter("window_id is not null and split is not null").distinct()
