"""Models over numeric features: weighted logistic regression, boosted trees, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "triage_feature_"


def feature_columns(df: DataFrame) -> list[str]:
    """The model inputs of a frame: columns with the feature prefix, by name. Labels, severities and families never are."""
    return sorted(c for c in df.columns if c.startswith(PREFIX))


def prepared(df: DataFrame, features: Sequence[str], label: Column) -> DataFrame:
    """Rows with label and balanced weight; missing features count as zero, rows without label are left out."""
    rows = df.withColumn("label", label.cast("double")).filter("label is not null").na.fill(0.0, list(features))
    share = rows.agg(F.avg("label").alias("_p"))
    w = F.when(F.col("label") == 1, 0.5 / F.greatest(F.col("_p"), F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("_p"), F.lit(1e-9)))
    return rows.crossJoin(F.broadcast(share)).withColumn("weight", w).drop("_p")


def classifier(features: Sequence[str], kind: str = "logistic") -> Pipeline:
    """An unfitted model on scaled features."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    if kind == "logistic":
        stages.append(LogisticRegression(featuresCol="_x", weightCol="weight", regParam=0.002, maxIter=50))
    elif kind == "boosted":
        stages.append(GBTClassifier(featuresCol="_x", weightCol="weight", maxIter=20, maxDepth=3, seed=42))
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages)


def scores(model, rows: DataFrame) -> DataFrame:
    """Rows with the model's probability as score."""
    keep = rows.columns
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*keep, "score")


def fold_of(key: Column, folds: int) -> Column:
    """A row's fold by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, features: Sequence[str], key: str, folds: int = 5, kind: str = "logistic") -> DataFrame:
    """Rows with score and fold, each scored by a model that hasn't seen its fold."""
    rows = rows.withColumn("fold", fold_of(F.col(key), folds))
    parts = []
    for k in range(folds):
        train = rows.filter(F.col("fold") != k)
        parts.append(scores(classifier(features, kind).fit(train), rows.filter(F.col("fold") == k)))
    return reduce(lambda a, b: a.unionByName(b), parts)
