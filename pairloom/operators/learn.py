"""Learned ensembles on pyspark.ml: logistic regression, forests, boosted trees, searches and importances."""

from __future__ import annotations

import itertools
import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def f1_of_positives() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, labelCol="label")


def _pipeline(columns: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip"), estimator])


def logistic(train: DataFrame, columns: list[str], l2: float = 1e-3, weight: str | None = None):
    """The converged form of regularised logistic regression on standardised columns.

    With weight, a row stands for so many equal ones. Spark's deviation of weighted rows has another denominator, so the columns are
    scaled here by that of the rows themselves.
    """
    if weight is None:
        return _pipeline(columns, LogisticRegression(labelCol="label", regParam=l2, elasticNetParam=0.0, standardization=True)).fit(train)
    own = train.dropna(subset=columns)
    n = F.sum(weight)
    means = own.agg(*((F.sum(F.col(c) * F.col(weight)) / n).alias(c) for c in columns)).first()
    spread = own.agg(*(F.sqrt(F.sum((F.col(c) - F.lit(means[c])) ** 2 * F.col(weight)) / F.greatest(n - 1, F.lit(1))).alias(c) for c in columns)).first()
    scale = ElementwiseProduct(scalingVec=Vectors.dense([1 / spread[c] if spread[c] else 0.0 for c in columns]), inputCol="assembled", outputCol="features")
    model = LogisticRegression(labelCol="label", weightCol=weight, regParam=l2, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="assembled", handleInvalid="skip"), scale, model]).fit(train)


def forest(train: DataFrame, columns: list[str], trees: int = 100, depth: int = 10, least: int = 1, seed: int = 0):
    return _pipeline(columns, RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)).fit(train)


def boosted(train: DataFrame, columns: list[str], rounds: int = 50, depth: int = 5, step: float = 0.1, seed: int = 0):
    return _pipeline(columns, GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)).fit(train)


def forest_search(train: DataFrame, columns: list[str], trees=(100, 200, 300), depths=(30, 5, 10), least=(2, 4, 6), folds: int = 5, parallelism: int = 4, seed: int = 0):
    """Grid search by F1. Spark's deepest tree has 30 levels, which stands for no limit."""
    model = RandomForestClassifier(labelCol="label", seed=seed)
    grid = ParamGridBuilder().addGrid(model.numTrees, list(trees)).addGrid(model.maxDepth, list(depths)).addGrid(model.minInstancesPerNode, list(least)).build()
    return CrossValidator(estimator=_pipeline(columns, model), estimatorParamMaps=grid, evaluator=f1_of_positives(), numFolds=folds, parallelism=parallelism, seed=seed).fit(train)


def boosted_search(train: DataFrame, columns: list[str], draws: int = 100, folds: int = 3, parallelism: int = 4, seed: int = 0, rounds=(50, 100, 200), depths=(3, 5, 7)):
    """Random search over rounds, depth, step, row share and minimum gain."""
    model = GBTClassifier(labelCol="label", seed=seed)
    space = list(itertools.product(rounds, depths, (0.01, 0.05, 0.1, 0.2), (0.6, 0.8, 1.0), (0.0, 0.01, 0.1)))
    params = (model.maxIter, model.maxDepth, model.stepSize, model.subsamplingRate, model.minInfoGain)
    grid = [dict(zip(params, point)) for point in random.Random(seed).sample(space, min(draws, len(space)))]
    return CrossValidator(estimator=_pipeline(columns, model), estimatorParamMaps=grid, evaluator=f1_of_positives(), numFolds=folds, parallelism=parallelism, seed=seed).fit(train)


def search_table(found) -> DataFrame:
    """(point, f1) of each point that a search tried, best first: the points are as few as the search's grid."""
    from pyspark.sql import SparkSession

    name = lambda grid: ", ".join(f"{p.name}={v}" for p, v in sorted(grid.items(), key=lambda x: x[0].name))
    rows = [(name(grid), float(f1)) for grid, f1 in zip(found.getEstimatorParamMaps(), found.avgMetrics)]
    return SparkSession.active().createDataFrame(rows, "point string, f1 double").orderBy(F.col("f1").desc(), "point")


def probabilities(model, frame: DataFrame) -> DataFrame:
    """frame with score, the probability of class 1."""
    return model.transform(frame).withColumn("score", vector_to_array("probability")[1]).drop("assembled", "features", "rawPrediction", "probability", "prediction")


def importances(model, columns: list[str]) -> DataFrame:
    """(measure, importance), largest first; one row a column."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(columns, values)), "measure string, importance double").orderBy(F.col("importance").desc(), "measure")


def argmax_label(logits: str = "logits"):
    """Predicted class of an array of logits, the first of equals."""
    return F.array_position(F.col(logits), F.array_max(logits)) - 1
