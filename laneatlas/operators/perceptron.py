"""A perceptron that stops early, as an estimator: mini-batch descent in the partitions, weights averaged over them after each epoch."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import checkpointed, shared_folder, ship

Weights = list[np.ndarray]


def started(sizes: list[int], seed: int) -> Weights:
    """Uniform weights of a bound that the layers' sizes give, zero offsets: w, b, w, b, ..."""
    rng = np.random.default_rng(seed)
    out: Weights = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = np.sqrt(6 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), np.zeros(b)]
    return out


def scores(x: np.ndarray, weights: Weights) -> list[np.ndarray]:
    """The input and what each layer gives: rectified, the last one as shares of the classes."""
    out = [x]
    for k in range(0, len(weights), 2):
        z = out[-1] @ weights[k] + weights[k + 1]
        out.append(np.maximum(z, 0) if k + 2 < len(weights) else z)
    z = out[-1] - out[-1].max(axis=1, keepdims=True)
    e = np.exp(z)
    out[-1] = e / e.sum(axis=1, keepdims=True)
    return out


def gradient(x: np.ndarray, y: np.ndarray, weights: Weights, decay: float) -> Weights:
    """Of the mean cross-entropy, and of decay / 2 times the weights' squares over the batch's size."""
    layers = scores(x, weights)
    d = layers[-1].copy()
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    out: Weights = []
    for k in range(len(weights) - 2, -1, -2):
        own = layers[k // 2]
        out = [own.T @ d + decay / len(y) * weights[k], d.sum(axis=0), *out]
        d = (d @ weights[k].T) * (own > 0)
    return out


class Steps:
    """Descent with first and second moments of the gradient (Adam); the moments are kept and averaged like the weights."""

    def __init__(self, weights: Weights, moments: Weights | None = None, count: int = 0, rate: float = 1e-3) -> None:
        self.w, self.count, self.rate = [w.copy() for w in weights], count, rate
        self.m = [m.copy() for m in moments] if moments else [np.zeros_like(w) for w in weights * 2]

    def step(self, g: Weights) -> None:
        self.count += 1
        n = len(self.w)
        rate = self.rate * np.sqrt(1 - 0.999**self.count) / (1 - 0.9**self.count)
        for k in range(n):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.m[n + k] = 0.999 * self.m[n + k] + 0.001 * g[k] * g[k]
            self.w[k] = self.w[k] - rate * self.m[k] / (np.sqrt(self.m[n + k]) + 1e-8)


def epoch(x: np.ndarray, y: np.ndarray, steps: Steps, batch: int, decay: float, rng: np.random.Generator) -> None:
    """One pass over rows in a drawn order, `batch` rows a step."""
    order = rng.permutation(len(y))
    for at in range(0, len(y), batch):
        part = order[at : at + batch]
        steps.step(gradient(x[part], y[part], steps.w, decay))


def _packed(arrays: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> Weights:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        return [f[k] for k in f.files]


class EarlyStoppingPerceptron(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Layers of rectified units for labels 0, 1, ...; a tenth of the rows is held out, and training ends once their accuracy has not risen by `tolerance`
    over the best for `patience` epochs, or after `epochs`. The weights of the best epoch are the model's.

    An epoch is one pass: each partition steps over its rows, a chunk of `chunk` in memory at a time, from the common weights; weights and moments are averaged by the partitions' rows.
    They are small (their number follows from the layers alone) and are kept in the shared folder after each epoch. Which rows are held out, and in which order rows come, follows
    from the seed; with one partition an epoch is plain mini-batch descent. Weights travel with the tasks: one copy a task, of a size that the layers bound.
    """

    hidden = Param(Params._dummy(), "hidden", "units of the hidden layers", TypeConverters.toListInt)
    epochs = Param(Params._dummy(), "epochs", "epochs at most", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without a rise", TypeConverters.toInt)
    tolerance = Param(Params._dummy(), "tolerance", "what counts as a rise of accuracy", TypeConverters.toFloat)
    batch = Param(Params._dummy(), "batch", "rows of a step", TypeConverters.toInt)
    decay = Param(Params._dummy(), "decay", "penalty of squared weights", TypeConverters.toFloat)
    rate = Param(Params._dummy(), "rate", "step size", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", hidden: list[int] = (64,), epochs: int = 500, patience: int = 10, tolerance: float = 1e-4, batch: int = 200, decay: float = 1e-4, rate: float = 1e-3, seed: int = 42) -> None:
        super().__init__()
        self._setDefault(hidden=[64], epochs=500, patience=10, tolerance=1e-4, batch=200, decay=1e-4, rate=1e-3, seed=42)
        self._set(**{k: list(v) if k == "hidden" else v for k, v in self._input_kwargs.items()})

    def _fit(self, samples: DataFrame) -> EarlyStoppingPerceptronModel:
        spark = samples.sparkSession
        ship(spark)
        get = lambda p: self.getOrDefault(p)
        seed, batch, decay, rate = get(self.seed), get(self.batch), get(self.decay), get(self.rate)
        rows = samples.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        rows = checkpointed(rows.withColumn("held", F.pmod(F.xxhash64(F.lit(seed), "x", "y"), F.lit(10)) == 0))
        size = rows.agg(F.count("*").alias("n"), F.max("y").alias("top"), F.max(F.size("x")).alias("wide"), F.count_if("held").alias("held")).first()
        if not size["n"]:
            raise ValueError("no samples")
        weights = started([size["wide"], *get(self.hidden), max(2, size["top"] + 1)], seed)
        n, count, moments = len(weights), 0, None
        learn = rows.where("not held") if size["held"] < size["n"] else rows
        judge = rows.where("held") if size["held"] else rows
        path = f"{shared_folder(spark)}/perceptron-{uuid.uuid4().hex}"
        best, best_weights, since, self_epochs = -1.0, weights, 0, 0
        for k in range(get(self.epochs)):
            state = _packed([*weights, *(moments or [])])

            def run(batches: Iterator[pa.RecordBatch], state=state, k=k, count=count, moments=moments) -> Iterator[pa.RecordBatch]:
                from pyspark import TaskContext

                arrays = _unpacked(state)
                steps = Steps(arrays[:n], arrays[n:] or None, count, rate)
                rng = np.random.default_rng([seed, k, TaskContext.get().partitionId()])
                seen = 0
                for b in batches:
                    if b.num_rows:
                        x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                        epoch(x, np.asarray(b.column(1)), steps, batch, decay, rng)
                        seen += b.num_rows
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([steps.count - count], pa.int64()), pa.array([_packed([*steps.w, *steps.m])], pa.binary())], names=["n", "steps", "state"])

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """Of the states of some partitions their weighted sum."""
                total, all_, most = 0, None, 0
                for b in batches:
                    for m, s, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        own = [m * a for a in _unpacked(data)]
                        all_ = own if all_ is None else [p + q for p, q in zip(all_, own, strict=True)]
                        total, most = total + m, max(most, s)
                if total:
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([most], pa.int64()), pa.array([_packed([a / total for a in all_])], pa.binary())], names=["n", "steps", "state"])

            kind = "n long, steps long, state binary"
            made = learn.select("x", "y").mapInArrow(run, kind)
            # a tree of two levels: some sixteen states meet in a task, what they give meets in one
            made = made.repartition(max(1, learn.rdd.getNumPartitions() // 16)).mapInArrow(sums, kind).repartition(1).mapInArrow(sums, kind)
            made.write.mode("overwrite").parquet(f"{path}/{k}")
            done = spark.read.parquet(f"{path}/{k}").first()
            arrays = _unpacked(bytes(done["state"]))
            weights, moments, count = arrays[:n], arrays[n:], count + done["steps"]
            right = EarlyStoppingPerceptronModel(weights)._set(featuresCol="x", predictionCol="p").guessed(judge, F.col("x")).agg(F.avg((F.col("p") == F.col("y")).cast("double"))).first()[0]
            self_epochs = k + 1
            since = 0 if right > best + get(self.tolerance) else since + 1
            if right > best:
                best, best_weights = right, weights
            if since > get(self.patience):
                break
        model = EarlyStoppingPerceptronModel(best_weights, self_epochs, best)
        return self._copyValues(model)


class EarlyStoppingPerceptronModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """weights: of the best epoch; epochs: those that ran; accuracy: on the held-out rows."""

    def __init__(self, weights: Weights, epochs: int = 0, accuracy: float = 0.0) -> None:
        super().__init__()
        self.weights, self.epochs, self.accuracy = weights, epochs, accuracy

    def guessed(self, rows: DataFrame, array) -> DataFrame:
        """rows with the class of the largest share, the lowest of equals, for a column of arrays."""
        import pandas as pd

        state, name = _packed(self.weights), self.getPredictionCol()

        def guess(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = _unpacked(state)
            for v in batches:
                yield pd.Series(scores(np.stack(v.to_numpy()), weights)[-1].argmax(axis=1).astype(float) if len(v) else np.zeros(0))

        guess.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return rows.withColumn(name, F.pandas_udf(guess, "double")(array))

    def _transform(self, rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        return self.guessed(rows, vector_to_array(F.col(self.getFeaturesCol())))
