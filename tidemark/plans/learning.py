"""Queries of the models; they have no SQL and are checked by held-out areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import models
from tidemark.plans import views as V


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    w = V.windows(spark, sf_dir)
    features = models.feature_columns(w)
    return models.prepared(w, features, F.col("label") == "ticket_worthy").select("window_id", "family", "label", "weight", *features), features


def ml1_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out areas of a weighted logistic model by fold."""
    rows, features = _rows(spark, sf_dir)
    s = models.out_of_fold(rows, features, "window_id", 5)
    return M.curve_areas(M.score_counts(s, ["fold"], "score", F.col("label") == 1), ["fold"], "score")


def ml4_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold score of every window: what a stacker is trained on."""
    rows, features = _rows(spark, sf_dir)
    return models.out_of_fold(rows, features, "window_id", 5).select("window_id", "fold", F.round("score", 6).alias("score"))


QUERIES = {"ml1_triage": ml1_triage, "ml4_stacked": ml4_stacked}
SQL: dict[str, str] = {}
