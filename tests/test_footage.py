"""Footage, imagery and the routes that chain them."""

import numpy as np
import pytest

from laneatlas.engine import BadParameter, Engine
from laneatlas.operators import filters, learning
from laneatlas.sources import files, frames
from laneatlas.sources.adapters import view
from laneatlas.streaming import density, tracker

SF = "/root/testdata/sf0.001"
HIGH, WIDE = 120, 160


@pytest.fixture(scope="module")
def footage(spark):
    """Two videos of a still ground, over which a bright 30 x 40 box moves from frame 20."""
    rows = []
    for video, step in (("a", 12), ("b:1", -12)):
        ground = np.random.default_rng(1).integers(60, 64, (HIGH, WIDE)).astype(np.uint8)
        for k in range(28):
            image = ground.copy()
            x = (5 if step > 0 else 110) + step * (k - 20)
            if k >= 20:
                image[40:70, x : x + 40] = 220
            rows.append((video, k, HIGH, WIDE, 30.0, image.tobytes()))
    return spark.createDataFrame(rows, frames.SCHEMA)


def test_image_pixels_are_linear_and_in_order(spark):
    image = np.random.default_rng(0).integers(0, 256, (300, 200, 3)).astype(np.uint8)
    df = spark.createDataFrame([("x", 300, 200, 3, image.tobytes()), ("gray", 1, 1, 1, b"a")], "origin string, height int, width int, n_channels int, data binary")
    got = {(r.r, r.c): (r.blue, r.green, r.red) for r in files.image_pixels(df).collect()}
    assert len(got) == 60_000 and got[299, 199] == tuple(image[299, 199].tolist()) and got[7, 3] == tuple(image[7, 3].tolist())


def test_frames_are_read_sampled_and_checked(spark, footage, tmp_path):
    path = str(tmp_path / "frames")
    footage.write.parquet(path)
    assert frames.read_frames(spark, path, rate=5, max_frames=11).count() == 6
    footage.drop("fps").write.parquet(path + "2")
    with pytest.raises(frames.UnreadableFrames, match="fps"):
        frames.read_frames(spark, path + "2")
    back = frames.from_pixels(frames.frame_pixels(footage), "video_id", "frame_idx", HIGH, WIDE)
    assert back.exceptAll(footage).count() == 0


def test_background_as_a_stream_gives_what_the_batch_gives(spark, footage, tmp_path):
    path = str(tmp_path / "frames")
    footage.coalesce(1).write.parquet(path)
    batch = filters.foreground(footage)
    assert batch.where("frame_idx < 20").count() == 0 and batch.where("frame_idx = 22").count() >= 2 * 1000
    stream = density.drained(filters.foreground_stream(frames.stream_frames(spark, path)), "append")
    assert stream.exceptAll(batch).count() == 0 and stream.count() == batch.count()


def test_routes_of_footage(spark, footage):
    e = Engine(spark)
    found = e.detections(footage, WIDE, HIGH).collect()
    own = [r for r in found if r.video_id == "b:1" and r.frame_id == 22]
    assert len(own) == 1 and abs(own[0].x - 86) <= 4 and 26 <= own[0].h <= 34
    doc = e.motion(footage, WIDE, HIGH, grid=10, rate=1).first()
    assert doc.statistics.max_intensity == 1.0 and doc.points
    assert e.footage(footage, WIDE, HIGH, rate=1, grid=10).first().statistics.max_intensity == 1.0
    with pytest.raises(BadParameter):
        e.motion(footage, WIDE, HIGH, grid=5)


def test_flow_is_largest_at_the_box(footage):
    at = filters.flow_between(footage.where("video_id = 'a'")).where("frame_idx = 22").orderBy("magnitude", ascending=False).first()
    assert 30 <= at.r <= 80 and at.magnitude > 0


def test_extractor_and_complete_route(spark):
    e = Engine(spark)
    gray = np.full((64, 96), 40)
    gray[20:26, 10:80] = 255
    rows = [(1, r, c, int(gray[r, c])) for r in range(64) for c in range(96)]
    df = spark.createDataFrame(rows, "k int, r int, c int, gray int")
    assert len(e.extract(df, "k", 96, 64, threshold=150, min_area=10).collect()) <= 1
    mask = df.where("gray > 200").select("k", "r", "c")
    out = e.complete("times_square_nyc", mask, "k", 960, 640, view(spark, SF, "detections"))
    assert set(out) == {"tiles", "markings", "traffic"} and out["tiles"].count() == 56
    assert [r.type for r in out["markings"].collect()] == ["lane_line"]
    features, doc = e.demo()
    assert features.count() == 9 and doc.first().statistics.total_points == 200


def test_tracks_do_not_depend_on_batches(spark):
    seen = view(spark, SF, "detections")
    whole = {tuple(r) for r in tracker.track(seen).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert {tuple(r) for r in tracker.track(seen).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_model_that_fails_is_left_out(spark):
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    p = learning.prepared(view(spark, SF, "features"))
    broken = MultilayerPerceptronClassifier(layers=[3, 2], featuresCol="vector", labelCol="target")
    good = LogisticRegression(featuresCol="vector", labelCol="target", maxIter=3)
    with pytest.warns(UserWarning, match="broken"):
        name, scores, _ = learning.best_classifier(p, {"broken": broken, "good": good}, folds=2)
    assert name == "good" and set(scores) == {"good"}
