"""The early-stopping perceptron against loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from laneatlas.operators import perceptron as P


def _rings(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, (np.hypot(*x.T) > 1.1).astype(int)


def _df(spark, x, y, parts=1):
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "a array<double>, label int")
    return df.repartition(parts).withColumn("features", array_to_vector("a"))


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 4, 7)
    w = [a + rng.normal(size=a.shape) * 0.1 for a in P.started([3, 5, 4], 2)]

    def loss(w):
        p = P.scores(x, w)[-1]
        return -np.log(p[np.arange(7), y]).mean() + 0.3 / 2 / 7 * sum((a * a).sum() for a in w[::2])

    g = P.gradient(x, y, w, 0.3)
    for k, a in enumerate(w):
        for at in np.ndindex(a.shape):
            up, down = [v.copy() for v in w], [v.copy() for v in w]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_steps_equal_a_loop_over_numbers():
    rng = np.random.default_rng(3)
    w = [rng.normal(size=(2, 2)), rng.normal(size=2)]
    steps, want = P.Steps(w, rate=0.01), [a.copy() for a in w]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, 6):
        g = [rng.normal(size=a.shape) for a in w]
        steps.step(g)
        for k, a in enumerate(want):
            for at in np.ndindex(a.shape):
                m[k][at] = 0.9 * m[k][at] + 0.1 * g[k][at]
                v[k][at] = 0.999 * v[k][at] + 0.001 * g[k][at] ** 2
                a[at] -= 0.01 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k][at] / (np.sqrt(v[k][at]) + 1e-8)
    assert all(np.allclose(p, q) for p, q in zip(steps.w, want, strict=True))


def test_one_partition_is_plain_descent(spark):
    x, y = _rings(150)
    df = _df(spark, x, y).withColumn("held", F.pmod(F.xxhash64(F.lit(5), "a", "label"), F.lit(10)) == 0)
    rows = df.where("not held").collect()
    a, b = np.array([r.a for r in rows]), np.array([r.label for r in rows])
    steps = P.Steps(P.started([2, 8, 2], 5), rate=0.01)
    for k in range(3):
        P.epoch(a, b, steps, 16, 1e-4, np.random.default_rng([5, k, 0]))
    fitted = P.EarlyStoppingPerceptron(hidden=[8], epochs=3, patience=99, batch=16, rate=0.01, seed=5).fit(df)
    held = [r for r in df.where("held").collect()]
    assert fitted.epochs == 3
    share = lambda w: np.mean([P.scores(np.array([r.a]), w)[-1].argmax() == r.label for r in held])
    assert share(fitted.weights) == pytest.approx(fitted.accuracy) and fitted.accuracy >= share(steps.w) - 1e-9
    last = P.EarlyStoppingPerceptron(hidden=[8], epochs=1, patience=99, batch=16, rate=0.01, seed=5).fit(df)
    one = P.Steps(P.started([2, 8, 2], 5), rate=0.01)
    P.epoch(a, b, one, 16, 1e-4, np.random.default_rng([5, 0, 0]))
    assert all(np.allclose(p, q) for p, q in zip(last.weights, one.w, strict=True))


def test_stops_before_its_limit_and_learns(spark):
    x, y = _rings(1200, 4)
    fitted = P.EarlyStoppingPerceptron(hidden=[16], epochs=60, patience=4, batch=32, rate=0.02).fit(_df(spark, x, y, 3))
    assert fitted.epochs < 60 and fitted.accuracy > 0.9
    tx, ty = _rings(300, 9)
    got = fitted.transform(_df(spark, tx, ty)).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert got > 0.9
    with pytest.raises(ValueError, match="no samples"):
        P.EarlyStoppingPerceptron().fit(_df(spark, x[:3], y[:3]).limit(0))
