"""A cross-validated decision tree: train, predict, report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import libsvm


@dataclass
class Trained:
    model: PipelineModel
    accuracy: float
    parameters: dict[str, int]
    tried: list[tuple[dict[str, int], float]]

    def to_json(self) -> str:
        return json.dumps(self.parameters | {"accuracy": self.accuracy}, indent=2)


def train(df: DataFrame, depths: Sequence[int] = (5, 10, 15), bins: Sequence[int] = (32, 64), instances: Sequence[int] = (1, 2), folds: int = 3, parallelism: int = 2, seed: int = 42) -> Trained:
    """The best tree over a grid for (label, features)."""
    tree = DecisionTreeClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).addGrid(tree.maxBins, list(bins)).addGrid(tree.minInstancesPerNode, list(instances)).build()
    search = CrossValidator(estimator=Pipeline(stages=[tree]), estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, parallelism=parallelism, seed=seed)
    df = df.select("label", "features").cache()
    try:
        found = search.fit(df)
    finally:
        df.unpersist()
    best = found.bestModel.stages[-1]
    tried = [({p.name: v for p, v in g.items()}, m) for g, m in zip(grid, found.avgMetrics)]
    return Trained(found.bestModel, max(found.avgMetrics), {p: best.getOrDefault(p) for p in ("maxDepth", "maxBins", "minInstancesPerNode")}, tried)


def save(trained: Trained, path: str, spark: SparkSession) -> None:
    """The model under path/model and its parameters, as JSON, under path/metadata; what is there is replaced."""
    trained.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(trained.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_metadata(path: str, spark: SparkSession) -> dict[str, float]:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/metadata", wholetext=True).collect()))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(label, prediction, probability_str) for each row."""
    return model.transform(df).select("label", "prediction", F.col("probability").cast("string").alias("probability_str"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def predict_job(spark: SparkSession, model: str, source: str, target: str, n_features: int | None = None) -> None:
    """What an upload sets off: predictions of a saved model for a LibSVM file, as CSV under target, which is replaced."""
    predict(load(model), libsvm(spark, source, n_features)).write.mode("overwrite").option("header", True).csv(target)
