"""AdaBoost over decision stumps, as an estimator for pipelines and cross-validation."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneatlas.session import checkpointed

#: Rounds after which the weights are cut from what made them.
CUT = 20


class BoostedStumps(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """SAMME for any number of classes (labels 0, 1, ...): each round fits a tree of one split on the current row weights, votes with
    rate (ln((1 - e) / e) + ln(classes - 1)) for its weighted error e, and multiplies the weights of the rows it misses by e to the vote.

    Ends early at an error of 0 (that stump alone then decides) or one no better than chance (it is left out, unless it is the first).
    Rounds follow each other by nature; each is a pass over the rows, whose weight is the only state and stays in the table.
    """

    rounds = Param(Params._dummy(), "rounds", "stumps at most", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", rounds: int = 200, rate: float = 0.5) -> None:
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(rounds=200, rate=0.5)

    def _fit(self, samples: DataFrame) -> BoostedStumpsModel:
        features, label, rate = self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault(self.rate)
        rows = samples.select(F.col(features).alias("f"), vector_to_array(features).alias("a"), F.col(label).cast("double").alias("y"))
        size = rows.agg(F.count("*").alias("n"), F.max("y").alias("top")).first()
        if not size["n"]:
            raise ValueError("no samples")
        classes = max(2, int(size["top"]) + 1)
        rows = checkpointed(rows.withColumn("w", F.lit(1.0 / size["n"])))
        tree = DecisionTreeClassifier(maxDepth=1, maxBins=256, featuresCol="f", labelCol="y", weightCol="w", predictionCol="p", rawPredictionCol="_raw", probabilityCol="_prob")
        stumps: list[tuple] = []
        for k in range(self.getOrDefault(self.rounds)):
            fitted = tree.fit(rows)
            stump = _stump(fitted)
            feature, threshold, low, high = stump
            miss = (F.when(F.get("a", F.lit(feature)) <= threshold, F.lit(low)).otherwise(F.lit(high)) != F.col("y")).cast("double")
            total, missed = rows.agg(F.sum("w"), F.sum(F.col("w") * miss)).first()
            e = missed / total
            if e <= 0:
                stumps = [(*stump, 1.0)]
                break
            if e >= 1 - 1 / classes:
                stumps = stumps or [(*stump, 1.0)]
                break
            vote = rate * (math.log((1 - e) / e) + math.log(classes - 1))
            stumps.append((*stump, vote))
            rows = rows.withColumn("w", F.col("w") * F.exp(F.lit(vote) * miss) / F.lit(total))
            if k % CUT == CUT - 1:
                rows = checkpointed(rows)
        return self._copyValues(BoostedStumpsModel(stumps, classes))


class BoostedStumpsModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """stumps: (feature, threshold, class at or below, class above, vote)."""

    def __init__(self, stumps: list[tuple], classes: int) -> None:
        super().__init__()
        self.stumps, self.classes = stumps, classes

    def _transform(self, rows: DataFrame) -> DataFrame:
        """With the class of most votes, the lowest of equals; one expression a row over an array of the stumps."""
        named = ("feature", "threshold", "low", "high", "vote")
        stumps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(named, s, strict=True)]) for s in self.stumps])
        f = vector_to_array(F.col(self.getFeaturesCol()))
        chosen = lambda s: F.when(F.get(f, s["feature"]) <= s["threshold"], s["low"]).otherwise(s["high"])

        def votes_for(k: int) -> Column:
            return F.aggregate(stumps, F.lit(0.0), lambda a, s: a + F.when(chosen(s) == k, s["vote"]).otherwise(0.0))

        votes = F.array(*[votes_for(k) for k in range(self.classes)])
        return rows.withColumn(self.getPredictionCol(), (F.array_position(votes, F.array_max(votes)) - 1).cast("double"))


def _stump(tree) -> tuple[int, float, float, float]:
    """A fitted tree of one split as (feature, threshold, class at or below, class above); a leaf alone has equal classes."""
    root = tree._call_java("rootNode")
    if tree.numNodes == 1:
        return 0, 0.0, float(root.prediction()), float(root.prediction())
    split = root.split()
    return int(split.featureIndex()), float(split.threshold()), float(root.leftChild().prediction()), float(root.rightChild().prediction())
