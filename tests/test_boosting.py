"""Boosted stumps against plain loops, and headers of GeoTIFF files."""

import math
import struct

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from laneatlas.operators import learning
from laneatlas.operators.boosting import BoostedStumps
from laneatlas.sources import geotiff


def _plain(x, y, rounds, rate):
    """The same votes by trying every split."""
    k = int(y.max()) + 1
    w, stumps = np.full(len(y), 1 / len(y)), []
    one = np.eye(k)[y]
    impurity = lambda m: m.sum() - (m**2).sum() / m.sum() if m.sum() else 0.0
    for _ in range(rounds):
        best = (math.inf,)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                a, b = (one[low] * w[low, None]).sum(axis=0), (one[~low] * w[~low, None]).sum(axis=0)
                best = min(best, (impurity(a) + impurity(b), f, t, int(a.argmax()), int(b.argmax())))
        _, f, t, a, b = best
        miss = np.where(x[:, f] <= t, a, b) != y
        e = w[miss].sum() / w.sum()
        if e <= 0 or e >= 1 - 1 / k:
            stumps = [(f, t, a, b, 1.0)] if e <= 0 else stumps
            break
        vote = rate * (math.log((1 - e) / e) + math.log(k - 1))
        stumps.append((f, t, a, b, vote))
        w = w * np.exp(vote * miss) / w.sum()
    return stumps


@pytest.mark.parametrize("classes", [2, 3])
def test_stumps_against_loops(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 15, (120, 3)).astype(float)
    y = ((x[:, 0] + 2 * x[:, 1] + rng.integers(0, 9, 120)) // (54 / classes)).clip(0, classes - 1).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "v array<double>, y int").select(array_to_vector("v").alias("features"), F.col("y").alias("label"))
    model = BoostedStumps(rounds=6, rate=0.5).fit(df)
    want = _plain(x, y, 6, 0.5)
    assert len(model.stumps) == len(want) == 6
    for got, plain in zip(model.stumps, want, strict=True):
        assert got == pytest.approx(plain)
    votes = np.zeros((len(y), classes))
    for f, t, a, b, v in want:
        votes[np.arange(len(y)), np.where(x[:, f] <= t, a, b)] += v
    assert [int(r.prediction) for r in model.transform(df).collect()] == votes.argmax(axis=1).tolist()


def test_stumps_end_early(spark):
    easy = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "v double, label int").select(array_to_vector(F.array("v")).alias("features"), "label")
    model = BoostedStumps(rounds=5).fit(easy)
    assert len(model.stumps) == 1 and model.transform(easy).where("prediction <> label").count() == 0
    alike = easy.withColumn("features", array_to_vector(F.array(F.lit(1.0))))
    assert len(BoostedStumps(rounds=5).fit(alike).stumps) == 1
    with pytest.raises(ValueError):
        BoostedStumps(rounds=5).fit(easy.limit(0))


def test_stumps_in_the_bake_off(spark):
    assert learning.classifiers(9, 2)["stumps"].getOrDefault("rounds") == 200
    rows = [(i % 2, [float(i % 2 + (i % 5) / 6)] + [float((i * k) % 7) for k in range(1, 9)]) for i in range(60)]
    p = learning.prepared(spark.createDataFrame(rows, "label int, f array<double>"))
    name, scores, model = learning.best_classifier(p, {"stumps": BoostedStumps(featuresCol="vector", labelCol="target", rounds=2)}, folds=2)
    assert name == "stumps" and scores["stumps"] == 1.0 and len(model.stumps) == 1


def _tiff(order, tags):
    """A file of one directory; values of over four bytes follow it."""
    mark = {"<": b"II", ">": b"MM"}[order]
    head, tail, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *values)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(tail))
        tail += raw if len(raw) > 4 else b""
        head += struct.pack(order + "HHI", tag, kind, len(values)) + inline
    return mark + struct.pack(order + "HIH", 42, 8, len(tags)) + head + b"\0" * 4 + tail


def test_geotiff_headers(spark, tmp_path):
    shape = [(256, 4, [200]), (257, 3, [100]), (277, 3, [3])]
    (tmp_path / "a.tif").write_bytes(_tiff("<", [*shape, (33550, 12, [0.01, 0.02, 0.0]), (33922, 12, [10.0, 5.0, 0.0, -73.9, 40.8, 0.0])]))
    (tmp_path / "b.TIFF").write_bytes(_tiff(">", [*shape, (34264, 12, [0.5, 0, 0, 10.0, 0, -0.25, 0, 60.0, 0, 0, 0, 0, 0, 0, 0, 1])]))
    (tmp_path / "c.tif").write_bytes(_tiff("<", shape[:2]))
    (tmp_path / "d.tif").write_bytes(b"no picture")
    (tmp_path / "f.png").write_bytes(_tiff("<", shape))
    read = geotiff.geotiffs(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r[1:] for r in read.collect()}
    assert set(got) == {"a.tif", "b.TIFF", "c.tif", "d.tif"}
    assert got["a.tif"] == pytest.approx((200, 100, 3, 38.9, 40.9, -74.0, -72.0))
    assert got["b.TIFF"] == pytest.approx((200, 100, 3, 35.0, 60.0, 10.0, 110.0))
    assert got["c.tif"][:3] == (200, 100, 1) and got["d.tif"] == (None,) * 7 and geotiff.header(b"") is None
    given = read.select("path", *[F.lit(1.0).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    out = {r.path.rsplit("/", 1)[1]: r[1:] for r in geotiff.header_first(given, read).collect()}
    assert out["a.tif"] == pytest.approx((38.9, 40.9, -74.0, -72.0)) and out["c.tif"] == out["d.tif"] == (1.0,) * 4
