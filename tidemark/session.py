"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").config(
        map=DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset, one of our own.

    A cluster names a folder that all executors share. The fallback is for a
    single-machine session, where driver and executors are one process.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (eager)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder: smaller on disk than a checkpoint, and columns are pruned when it is read.

    The tables of an application lie in one folder, which is removed when the
    Python process ends.
    """
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_tidemark_kept", False):
        spark.sparkContext._tidemark_kept = True
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    made = os.path.join(tempfile.mkdtemp(prefix="tidemark-package-"), "tidemark.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("tidemark") / p.relative_to(here))
    sc.addPyFile(made)
    sc._tidemark_shipped = True
