"""Classifiers of difficulty on features and embeddings, from Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.operators.features import FEATURES
from readq.operators.metrics import class_weights


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight`, so that every label weighs alike."""
    w = class_weights(df, label).select(label, "weight")  # one row for each label
    return df.join(F.broadcast(w), label)


def boosted_trees(df: DataFrame, label: str = "label", trees: int = 300, depth: int = 5, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """One boosted classifier for each class against the rest, on the 14 features."""
    one = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    both = OneVsRest(classifier=one, labelCol=label, featuresCol="features", weightCol="weight")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), both]).fit(weighted(df, label))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Mean importance of each feature over the classes, the largest first."""
    each = [m.featureImportances.toArray() for m in model.stages[-1].models]
    mean = sum(each) / len(each)
    return sorted(zip(FEATURES, map(float, mean)), key=lambda x: (-x[1], x[0]))


def as_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add `features`, the array as a vector."""
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def linear_probe(df: DataFrame, label: str = "label", vector: str = "embedding", rounds: int = 300) -> PipelineModel:
    """Multinomial logistic regression on embeddings, with the ridge of strength 1 over the number of rows. The model reads `as_features`."""
    rows = df.where(F.col(label).isNotNull())
    n = max(1, rows.count())
    lr = LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", standardization=False, regParam=1 / n, maxIter=rounds)
    return Pipeline(stages=[lr]).fit(as_features(rows, vector))


def leaderboard(reports: dict[str, DataFrame]) -> DataFrame:
    """(model, accuracy, macro_f1) of the class reports, the best macro F1 first."""
    from functools import reduce

    rows = [
        r.where(F.col("class").isin("macro", "accuracy")).agg(F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"), F.max(F.when(F.col("class") == "macro", F.col("f1"))).alias("macro_f1")).select(F.lit(name).alias("model"), "accuracy", "macro_f1")
        for name, r in reports.items()
    ]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("macro_f1"), "model")


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted model, in place of one that may be there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
