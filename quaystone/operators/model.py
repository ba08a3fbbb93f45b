"""A confidence head: class-weighted logistic regression, with Spark's own estimator."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_confidence(rows: DataFrame, features: str, label: str, rounds: int = 50) -> LogisticRegressionModel:
    """Fit on an array column and a 0/1 label; the rarer class weighs more, so that both count alike."""
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    data = rows.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(weightCol="weight", maxIter=rounds, regParam=1e-3).fit(data)


def confidence(model: LogisticRegressionModel, rows: DataFrame, features: str) -> DataFrame:
    scored = model.transform(rows.withColumn("features", array_to_vector(features)))
    return scored.withColumn("confidence", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
