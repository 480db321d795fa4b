"""GeoJSON documents, kinds of files, given and made masks."""

import json

import numpy as np
import pytest

from laneatlas.engine import Engine
from laneatlas.operators import markings
from laneatlas.sources import files, frames
from laneatlas.sources.adapters import view

SF = "/root/testdata/sf0.001"


def test_geojson_of_every_kind(spark, tmp_path):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 2.0], [0.0, 0.0]]
    shapes = [("Polygon", [square]), ("LineString", [[1.0, 2.0], [3.0, 4.0]]), ("Point", [5.0, 6.0]), ("MultiPolygon", [[square], [square, square]])]
    made = [{"type": "Feature", "id": k, "geometry": {"type": t, "coordinates": c}, "properties": {"marking_type": "x", "confidence": 0.5}} for k, (t, c) in enumerate(shapes)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": made, "metadata": {"n": 4}}, indent=2))
    (tmp_path / "b.geojson").write_text(json.dumps(made[0], indent=2))
    (tmp_path / "c.geojson").write_text('{"type": "Feature", "id": 9, "geometry": null, "properties": null}')
    (tmp_path / "d.geojson").write_text("not json")
    want = {0: [square], 1: [[[1.0, 2.0], [3.0, 4.0]]], 2: [[[5.0, 6.0]]], 3: [square] * 3}
    got = {int(r.id): r for r in files.geojson(spark, str(tmp_path / "a.geojson")).collect()}
    assert {k: r.rings for k, r in got.items()} == want and got[1].geometry == "LineString" and got[0].properties["confidence"] == "0.5"
    assert json.loads(got[3].text) == made[3]
    assert [r.id for r in files.geojson(spark, str(tmp_path / "b.geojson")).collect()] == ["0"]
    (bare,) = files.geojson(spark, str(tmp_path / "c.geojson")).collect()
    assert bare.rings is None and bare.geometry is None and files.geojson(spark, str(tmp_path / "d.geojson")).count() == 0
    with pytest.raises(files.MissingDocument):
        files.geojson(spark, str(tmp_path / "none.geojson"))


def test_written_features_are_read_back(spark, tmp_path):
    mask = spark.createDataFrame([(0, r, c) for r in range(10, 20) for c in range(10, 100)], "k int, r int, c int")
    found = Engine(spark).markings(mask, "k", 960, 640)
    files.write_features(found, str(tmp_path / "f"))
    (row,) = files.geojson(spark, str(tmp_path / "f"), lines=True).collect()
    assert row.geometry == "Polygon" and row.rings == found.first().feature.geometry.coordinates and row.properties["marking_type"] == "lane_line"


def test_kinds_of_routes():
    assert files.accepted("a/B.TIFF", "imagery") and files.accepted("x.webm", "video")
    for name, route in (("x.webm", "footage"), ("x.avi", "pipeline_footage"), ("x.gif", "imagery"), ("png", "imagery")):
        with pytest.raises(files.RefusedFile):
            files.accepted(name, route)


def test_given_masks_come_first(spark):
    images = frames.from_pixels(view(spark, SF, "mosaics").withColumn("video", markings.F.lit("m")), "video", "k", 64, 64)
    own = np.zeros((64, 64), np.uint8)
    own[3, 4:9] = 2
    given = spark.createDataFrame([("m", 1, 64, 64, 1.0, own.tobytes()), ("other", 1, 64, 64, 1.0, own.tobytes())], frames.SCHEMA)
    e = Engine(spark)
    got = e.masks(images, given, 110, 10)
    assert {(r.r, r.c, r.v) for r in got.where("frame_idx = 1").collect()} == {(3, c, 2) for c in range(4, 9)}
    pseudo = e.pseudo_masks(images.where("frame_idx <> 1"), 110, 10)
    assert got.where("frame_idx <> 1").exceptAll(pseudo).count() == 0 and got.where("frame_idx <> 1").count() == pseudo.count() > 0
    assert got.where("video_id = 'other'").count() == 0


def test_crossing_rings_give_a_feature_for_each_part(spark):
    from pyspark.sql import functions as F

    from laneatlas.operators import contours

    ring = [(10, 10), (110, 40), (110, 10), (10, 40)]
    parts = contours.repaired(ring)
    assert len(parts) == 2
    row = (0, 1, 999, [(int(x), int(y)) for x, y in ring], 10, 10, 101, 31, 3000.0, 100.0, 30.0, [[(float(x), float(y)) for x, y in p] for p in parts])
    found = spark.createDataFrame([row], f"k int, {contours._SHAPE}")
    e = Engine(spark)
    made = e._marked(contours.measured(found).withColumn("area", F.lit(1500.0)), "k", F.lit(1000), F.lit(800), 100, None, "v1").orderBy("id").collect()
    assert [r.id for r in made] == [0, 1] and all(r.feature.geometry.type == "Polygon" for r in made)
    assert sum(abs(contours.shoelace([tuple(p) for p in r.ring])) for r in made) == sum(contours.shoelace(p) for p in parts)
