"""Ring measures, ellipse fits, fills and one-pass chains against loops and known shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from laneatlas.engine import Engine
from laneatlas.functions import polygons as P
from laneatlas.functions import shapes
from laneatlas.operators import chains, contours, fill, raster
from laneatlas.sources import frames
from laneatlas.sources.adapters import view

SF = "/root/testdata/sf0.001"
RING = "id int, ring array<struct<x:double,y:double>>"


def _rings(spark, *rings):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)], RING)


def _ellipse(a, b, turn, cx=50.0, cy=40.0, n=24):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False) + 0.1
    x, y = a * np.cos(t), b * np.sin(t)
    c, s = math.cos(turn), math.sin(turn)
    return list(zip(cx + c * x - s * y, cy + s * x + c * y, strict=True))


def test_known_measures(spark):
    bar, back, line = [(10, 10), (100, 10), (100, 20), (10, 20)], [(10, 20), (100, 20), (100, 10), (10, 10)], [(0, 0), (5, 0)]
    block = [(0, 0), (39, 0), (39, 7), (0, 7)]
    df = _rings(spark, bar, back, line, [], block)
    ring = F.col("ring")
    rows = df.select("id", P.area(ring).alias("a"), P.perimeter(ring).alias("p"), P.moments(ring)["m00"].alias("m"), P.hu(P.moments(ring)).alias("h")).orderBy("id").collect()
    assert [(r.a, r.p) for r in rows] == [(900, 200), (900, 200), (0, 10), (0, 0), (273, 92)]
    assert rows[0].m == rows[1].m == 900 and rows[0].h == pytest.approx(rows[1].h)
    assert rows[4].h[0] == pytest.approx((39**2 + 7**2) / (12 * 39 * 7)) and rows[2].h == [0.0] * 4


def test_invariants_do_not_turn_or_move(spark):
    shape = np.array([(0, 0), (30, 2), (33, 14), (12, 9), (5, 20)], float)
    c, s = math.cos(0.7), math.sin(0.7)
    turned = shape @ np.array([[c, s], [-s, c]]) + (5000, -300)
    a, b, d = (r.h for r in _rings(spark, shape, turned, 3 * shape).select("id", P.hu(P.moments(F.col("ring"))).alias("h")).orderBy("id").collect())
    assert a == pytest.approx(b, rel=1e-6) and a == pytest.approx(d, rel=1e-9)


def test_ellipses_are_recovered(spark):
    turns = [0.0, 0.3, 1.0, math.pi / 2, 2.5]
    odd = [[(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], [(0, 0), (9, 0), (9, 4), (0, 4)], [(3, 3)] * 6, []]
    df = _rings(spark, *[_ellipse(20, 7, t) for t in turns], *odd)
    got = [r.o for r in df.select("id", P.orientation(F.col("ring")).alias("o")).orderBy("id").collect()]
    for t, o in zip(turns, got, strict=False):  # the shorter axis is a quarter turn on
        away = (o * math.pi - t - math.pi / 2) % math.pi
        assert min(away, math.pi - away) < 1e-6
    assert got[len(turns) :] == [0.5] * 4
    noisy = np.array(_ellipse(30, 10, 0.6, n=60)) + np.random.default_rng(1).normal(0, 0.3, (60, 2))
    (o,) = P.ellipse_angles(np.array([_rings(spark, noisy).select(P.scatter(F.col("ring"))).first()[0]]))
    assert abs(o * math.pi - 0.6 - math.pi / 2) < 0.05


def test_vector_of_a_bar(spark):
    image = [(0, r, c) for r in range(10, 21) for c in range(10, 101)]
    (row,) = contours.contours(spark.createDataFrame(image, "k int, r int, c int"), "k", 40, 120).collect()
    f = row.features
    assert (row.area, row.perimeter) == (900, 200)
    assert f[0] == pytest.approx(9) and f[1] == pytest.approx(4 * math.pi * 900 / 200**2) and f[2] == 1.0 and f[3] == pytest.approx(900 / (91 * 11)) and f[4] == 0.5
    mu20, mu02 = 90**3 * 10 / 12, 90 * 10**3 / 12
    assert f[5] == pytest.approx(-math.log10((mu20 + mu02) / 900**2 + 1e-10))
    (dot,) = contours.contours(spark.createDataFrame([(0, 3, 3)], "k int, r int, c int"), "k", 9, 9).collect()
    assert dot.features == [0.0] * 9 and dot.area == 0


def test_fills_equal_the_dense_kernel_and_later_ones_win(spark):
    rng = np.random.default_rng(4)
    rings = [[(int(x), int(y)) for x, y in rng.integers(-3, 25, (rng.integers(3, 8), 2))] for _ in range(40)]
    df = _rings(spark, *rings).withColumn("height", F.lit(20)).withColumn("width", F.lit(22)).withColumn("part", F.lit(1))
    got = {}
    for r in fill.painted(df, ["id"], F.lit(1)).collect():
        got.setdefault(r.id, set()).add((r.r, r.c))
    for i, ring in enumerate(rings):
        assert got.get(i, set()) == set(zip(*map(np.ndarray.tolist, np.nonzero(contours.filled(ring, 20, 22))), strict=True))
    two = spark.createDataFrame([(0, 1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (0, 2, [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)])], "id int, part int, ring array<struct<x:double,y:double>>").withColumn("height", F.lit(9)).withColumn("width", F.lit(9))
    at = {(r.r, r.c): r.v for r in fill.painted(two, ["id"], F.col("part")).collect()}
    assert at[0, 0] == 1 and at[3, 3] == 2 and at[6, 6] == 2 and len(at) == 25 + 25 - 9


@pytest.mark.parametrize("element", [raster.rectangle(3, 3), raster.rectangle(2, 2), raster.ellipse(5), raster.rectangle(1, 7)])
def test_dense_steps_equal_the_relational_ones(spark, element):
    rng = np.random.default_rng(6)
    images = [rng.random((11, 13)) < p for p in (0.2, 0.5, 0.8)]
    df = spark.createDataFrame([(k, int(r), int(c)) for k, m in enumerate(images) for r, c in zip(*np.nonzero(m), strict=True)], "k int, r int, c int")
    for name in ("opened", "closed"):
        got = {tuple(r) for r in getattr(raster, name)(df, "k", element, 11, 13).collect()}
        assert got == {(k, int(r), int(c)) for k, m in enumerate(images) for r, c in zip(*np.nonzero(getattr(chains, name)(m, element)), strict=True)}


def _images(spark):
    return frames.from_pixels(view(spark, SF, "mosaics").withColumn("video", F.lit("m")), "video", "k", 64, 64)


def _by_loops(gray, mask, roundness, least):
    """The class mask of one image: shapes in turn, filled by the dense kernel."""
    out = np.zeros(gray.shape, int)
    for s in contours.shapes_of(mask, True):
        ring = [(p["x"], p["y"]) for p in s[2]]
        area, around, long, short = contours.shoelace(ring), contours.perimeter(ring), s[8], s[9]
        if area < least or not short:
            continue
        ratio = long / short
        round_ = 4 * math.pi * area / around**2
        kind = 1 if ratio > 6 else 4 if ratio > 3 else 2 if ratio > 1.5 and (not roundness or round_ < 0.5) else 3
        out[contours.filled(ring, *gray.shape)] = kind
    return out


def test_pseudo_masks_and_detector_equal_loops(spark):
    images, e = _images(spark), Engine(spark)
    dense = {r.frame_idx: np.frombuffer(r.image, np.uint8).reshape(64, 64) for r in images.collect()}
    for made, mask, roundness in ((e.pseudo_masks(images, 110, 10), lambda g: chains.bright(g, 110), False), (e.detect(images, min_area=1), chains.detected, True)):
        got = {k: np.zeros((64, 64), int) for k in dense}
        for r in made.collect():
            got[r.frame_idx][r.r, r.c] = r.v
        for k, gray in dense.items():
            assert (got[k] == _by_loops(gray, mask(gray), roundness, 1 if roundness else 10)).all()
        assert any(m.any() for m in got.values())
    stats = e.mask_statistics(e.pseudo_masks(images, 110, 10), images).collect()
    assert {r["class"] for r in stats} <= set(shapes.CLASS_NAMES.values()) and all(r.percentage == round(100 * r.pixels / 4096, 2) for r in stats)
    assert e.detect(images, model=lambda df: df.limit(0)).count() == 0


def test_extraction_is_one_pass(spark):
    gray = np.full((64, 96), 40, np.uint8)
    gray[20:27, 10:80] = 255
    rows = spark.createDataFrame([("m", 0, 64, 96, 1.0, gray.tobytes())], frames.SCHEMA)
    e = Engine(spark)
    shapes_ = chains.shapes(rows, chains.extracted, threshold=150)
    assert "Exchange" not in shapes_._jdf.queryExecution().executedPlan().toString()
    pixels = frames.frame_pixels(rows).withColumnRenamed("frame_idx", "k")
    by_pixels = e.extract(pixels, "k", 96, 64, threshold=150, min_area=10)
    assert by_pixels._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    a, b = by_pixels.collect(), e.extract_images(rows, threshold=150, min_area=10).collect()
    assert [r.feature.geometry for r in a] == [r.feature.geometry for r in b]


def test_area_of_the_contour_decides(spark):
    df = spark.createDataFrame([("v", 0, 1, 0, 0, 300, 200, 30_000.0), ("v", 0, 2, 0, 0, 300, 200, 60_000.0), ("v", 0, 3, 0, 0, 20, 40, 499.0)], "video_id string, frame_id long, event_id long, x int, y int, w int, h int, area double")
    from laneatlas.operators import traffic

    assert [r.event_id for r in traffic.plausible_detections(df).collect()] == [1]
    assert [r.event_id for r in traffic.plausible_detections(df.drop("area")).collect()] == [3]
