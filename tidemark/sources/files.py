"""Readers and writers of files: JSON lines, CSV, trees of files, runs by prefix, prediction files, embedding cache."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, mode: str = "FAILFAST", bad: str | None = None) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a byte-order mark is dropped.

    mode FAILFAST raises on a bad line, DROPMALFORMED skips it, PERMISSIVE
    keeps it as nulls and, where `bad` names a column, its text there.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if bad and bad not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.btrim("value") != "")
    options = {"mode": "PERMISSIVE" if mode == "DROPMALFORMED" else mode, "columnNameOfCorruptRecord": bad or "_bad_line"}
    if mode == "FAILFAST":
        parsed = lines.select(F.from_json("value", schema, options).alias("r"))
        return parsed.select("r.*")
    probe = schema if bad else T.StructType([*schema.fields, T.StructField("_bad_line", T.StringType())])
    parsed = lines.select(F.from_json("value", probe, options).alias("r")).select("r.*")
    if mode == "DROPMALFORMED":
        parsed = parsed.filter(F.col(bad or "_bad_line").isNull())
    return parsed if bad else parsed.drop("_bad_line")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with keys in order; null fields are written."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Columns as CSV cells: nested ones as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(frames: Sequence[DataFrame], path: str) -> None:
    """Rows of all frames as CSV under the union of their columns."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [csv_ready(f) for f in frames])
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_runs(spark: SparkSession, root: str, prefix: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of all runs whose folder starts with a prefix, with the folder as run_folder."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = spark.read.schema(schema).json(f"{root}/{prefix}*")
    return rows.withColumn("run_folder", F.element_at(F.split(F.input_file_name(), "/"), -2))


def checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(F.substring_index(base, root.rstrip("/") + "/", -1).alias("path"), F.col("length").alias("size"), F.sha2(F.col("content"), 256).alias("sha256"))


def tree_checksum(files: DataFrame) -> DataFrame:
    """(sha256, n_files) of a table of checksums: the digest of its 'path sha256' lines in order of path."""
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", "path", "sha256")))
    return files.agg(F.sha2(F.concat_ws("\n", lines), 256).alias("sha256"), F.count(F.lit(1)).alias("n_files"))


def named_blobs(spark: SparkSession, root: str, pattern: str, keys: Sequence[str]) -> DataFrame:
    """Text files whose names hold keys: the keys (groups of `pattern` on the file name) and the content; other files are left out."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root).withColumn("_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.filter(F.col("_name").rlike(pattern)).select(*[F.regexp_extract("_name", pattern, i).alias(k) for i, k in enumerate(keys, 1)], F.col("value").alias("content"))


def last_predictions(frames: Sequence[DataFrame], aliases: dict[str, str]) -> DataFrame:
    """Predictions (window_id, pipeline_name, ...) of several files under canonical names; of a window and pipeline the last file holds."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_file", F.lit(i)) for i, f in enumerate(frames)])
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.col("pipeline_name")), F.col("pipeline_name")) if aliases else F.col("pipeline_name")
    rows = rows.withColumn("pipeline_name", name)
    rest = [c for c in rows.columns if c not in ("window_id", "pipeline_name", "_file")]
    last = rows.groupBy("window_id", "pipeline_name").agg(F.max_by(F.struct(*rest), "_file").alias("_r"))
    return last.select("window_id", "pipeline_name", "_r.*")


def missing_texts(texts: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """(sha256, text): distinct texts that a cache (sha256, ...) doesn't hold yet; nulls are left out."""
    t = texts.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("sha256"), F.col(text).alias("text")).dropDuplicates(["sha256"])
    return t.join(cache.select("sha256"), "sha256", "left_anti")
