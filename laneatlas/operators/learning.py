"""Feature vectors: scaling, weights and classifiers on Spark ML."""

from __future__ import annotations

import gc
import warnings
from collections.abc import Iterator

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.functions.shapes import finite
from laneatlas.operators.boosting import BoostedStumps
from laneatlas.operators.perceptron import EarlyStoppingPerceptron
from laneatlas.session import checkpointed

NAMES = ["aspect_ratio", "circularity", "solidity", "extent", "orientation", "hu_moments_0", "hu_moments_1", "hu_moments_2", "hu_moments_3"]
#: Nodes of trees that are held at once, and how far apart the seeds of a forest's parts are (Spark adds a partition's number to a seed).
_NODES, _APART = 400_000, 1_000_003


def standardized(samples: DataFrame, features: str = "f") -> DataFrame:
    """Each feature less its mean, over its population deviation (1 if that is 0). One aggregation; its one row is broadcast."""
    n = len(NAMES)
    stats = samples.agg(
        F.array(*[F.avg(F.get(features, F.lit(i))) for i in range(n)]).alias("_mean"),
        F.array(*[F.stddev_pop(F.get(features, F.lit(i))) for i in range(n)]).alias("_sd"),
    )
    z = F.zip_with(F.zip_with(features, "_mean", lambda x, m: x - m), "_sd", lambda d, s: d / F.when(s == 0, 1.0).otherwise(s))
    return samples.crossJoin(F.broadcast(stats)).withColumn(features, z).drop("_mean", "_sd")


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """label, n and weight = rows / (classes x rows of the class)."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k")))).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def finite_only(samples: DataFrame, features: str = "f") -> DataFrame:
    return samples.where(finite(F.col(features)))


def argmax(values) -> F.Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def classifiers(n_features: int, n_classes: int, seed: int = 42) -> dict:
    """The bake-off: forests of three sizes, boosted trees (one against the rest for more than two classes), boosted stumps and two perceptrons that stop early. Leaves of
    the smallest forest hold 2 rows at least, of the others 1."""
    common = {"featuresCol": "vector", "labelCol": "target", "seed": seed}
    forest = lambda n, depth, leaf: RandomForestClassifier(numTrees=n, maxDepth=depth, minInstancesPerNode=leaf, weightCol="weight", **common)
    out = {"forest_200": forest(200, 15, 2), "forest_500": forest(500, 20, 1), "forest_1000": forest(1000, 25, 1)}
    boosted = GBTClassifier(maxIter=200, maxDepth=10, stepSize=0.1, **common)
    out["boosted"] = boosted if n_classes == 2 else OneVsRest(classifier=boosted, featuresCol="vector", labelCol="target")
    out["stumps"] = BoostedStumps(featuresCol="vector", labelCol="target", rounds=200, rate=0.5)
    out["perceptron_3"] = EarlyStoppingPerceptron(featuresCol="vector", labelCol="target", hidden=[256, 128, 64], epochs=1000, seed=seed)
    out["perceptron_2"] = EarlyStoppingPerceptron(featuresCol="vector", labelCol="target", hidden=[512, 256], epochs=1000, seed=seed)
    return out


def prepared(samples: DataFrame, label: str = "label", features: str = "f") -> DataFrame:
    """Finite, standardised samples with vector, target (labels in their order, from 0) and balancing weight."""
    clean = standardized(finite_only(samples, features), features)
    w = class_weights(clean, label)
    rank = F.broadcast(w.select(label, "weight").withColumn("target", F.expr(f"cast(row_number() over (order by {label}) - 1 as double)")))  # a row a class
    return clean.join(rank, label).withColumn("vector", array_to_vector(features))


def train_forest(samples: DataFrame, trees: int = 200, depth: int = 15, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, weightCol="weight", featuresCol="vector", labelCol="target", seed=seed)]).fit(samples)


def _nodes(samples: DataFrame, depth: int) -> int:
    """What a tree has at most: its leaves hold two rows at least."""
    return max(1, min(samples.count(), 2 ** (depth + 1)))


def forest_parts(samples: DataFrame, nodes: int, trees: int = 200, depth: int = 15, seed: int = 42) -> Iterator[PipelineModel]:
    """A forest as forests of so few trees that the driver, and each executor that is sent one, holds some `_NODES` nodes at once; `nodes`: of a tree at
    most, for the first one, whose own count tells how many trees the next ones have. Let go of each before taking the next."""
    k = 0
    while trees:
        n = min(trees, max(1, _NODES // nodes))
        part = train_forest(samples, n, depth, seed + _APART * k)
        nodes, k, trees = max(1, part.stages[-1].totalNumNodes // n), k + 1, trees - n
        yield part
        del part
        gc.collect()  # Py4J's objects stand in cycles, and with them the JVM's forest


def forest_predicted(samples: DataFrame, trees: int = 200, depth: int = 15, seed: int = 42) -> DataFrame:
    """samples with the prediction of a forest trained on them. One too large to be held at once votes part by part; the votes so far go to the shared folder."""
    nodes = _nodes(samples, depth)
    if nodes * trees <= _NODES:
        return train_forest(samples, trees, depth, seed).transform(samples)
    samples = scored = checkpointed(samples)
    for part in forest_parts(samples, nodes, trees, depth, seed):
        raw = vector_to_array("rawPrediction")
        votes = F.zip_with("_votes", raw, lambda a, b: a + b) if "_votes" in scored.columns else raw
        scored = checkpointed(part.transform(scored).select(*samples.columns, votes.alias("_votes")))
        del part
    return scored.withColumn("prediction", argmax(F.col("_votes")).cast("double")).drop("_votes")


def forest_importances(samples: DataFrame, trees: int = 200, depth: int = 15, seed: int = 42) -> list[tuple[str, float]]:
    """importances() of a forest trained on samples; one too large to be held at once is summed tree by tree, each to 1 as Spark does."""
    nodes = _nodes(samples, depth)
    if nodes * trees <= _NODES:
        return importances(train_forest(samples, trees, depth, seed).stages[-1])
    total = np.zeros(len(NAMES))
    for part in forest_parts(checkpointed(samples), nodes, trees, depth, seed):
        for tree in part.stages[-1].trees:
            total += tree.featureImportances.toArray()
            del tree
        del part
    return _ranked(total / (total.sum() or 1))


def best_classifier(samples: DataFrame, models: dict, folds: int = 5, parallelism: int = 2) -> tuple[str, dict[str, float], object]:
    """Mean accuracy of each model over folds; the best is fitted on all samples. A model that fails to train is left out with a warning;
    if all fail, the forest of 200 trees is fitted and no scores are given."""
    judge = MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy")
    scores, fitted = {}, {}
    for name, model in models.items():
        cv = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=42)
        try:
            made = cv.fit(samples)
        except Exception as e:  # noqa: BLE001 whatever a model cannot train on
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
            continue
        scores[name], fitted[name] = made.avgMetrics[0], made.bestModel
    if not scores:
        return "forest_200", {}, train_forest(samples).stages[-1]
    best = max(scores, key=scores.get)
    return best, scores, fitted[best]


def importances(model) -> list[tuple[str, float]]:
    """Feature names with their importance, largest first."""
    return _ranked(model.featureImportances.toArray())


def _ranked(values: np.ndarray) -> list[tuple[str, float]]:
    return sorted(zip(NAMES, values.tolist(), strict=True), key=lambda x: -x[1])
