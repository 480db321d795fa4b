"""Sources, sinks, streams and the front."""

import json

import pytest
from pyspark.sql import functions as F

from laneatlas.engine import BadParameter, Engine
from laneatlas.functions import geo, pixels, shapes
from laneatlas.operators import learning, spatial, tiles, traffic
from laneatlas.sources import files, locations
from laneatlas.sources import tiles as tile_source
from laneatlas.sources.adapters import table, view
from laneatlas.streaming import density

SF = "/root/testdata/sf0.001"


def test_shipped_extent(spark):
    r = tiles.stitched_extent(locations.with_bounds(locations.location(spark, "times_square_nyc"))).first()
    assert (r.zoom, r.min_x, r.max_x, r.min_y, r.max_y, r.width, r.height) == (19, 154389, 154396, 197032, 197038, 2048, 1792)
    assert r.actual.min_lat == pytest.approx(40.7560997756636, abs=1e-9) and r.actual.max_lon == pytest.approx(-73.98399353027344, abs=1e-9)
    with pytest.raises(locations.UnknownLocation):
        locations.location(spark, "london")


def test_tile_corner_is_in_its_tile(spark):
    z = F.lit(12)
    t = spark.range(200).select((F.col("id") * 17 % 4096).alias("x"), (F.col("id") * 13 % 4096).alias("y"))
    same = (geo.tile_x(geo.tile_lon(F.col("x"), z) + 1e-9, z) == F.col("x")) & (geo.tile_y(geo.tile_lat(F.col("y"), z) - 1e-9, z) == F.col("y"))
    assert t.where(~same).count() == 0


def test_tile_source(spark, tmp_path):
    (tmp_path / "5" / "7").mkdir(parents=True)
    (tmp_path / "5" / "7" / "3").write_bytes(b"tile")
    tile_source.register(spark)
    df = spark.read.format("tiles").options(template=f"file://{tmp_path}/{{z}}/{{y}}/{{x}}", zoom=5, min_x=3, max_x=4, min_y=7, max_y=7, pause=0).load()
    assert {r.x: r.data and bytes(r.data) for r in df.collect()} == {3: b"tile", 4: None}


def test_engine_documents(spark, tmp_path):
    e = Engine(spark)
    doc = e.heatmap(view(spark, SF, "heat_points"), 640, 480)
    files.write_document(doc, str(tmp_path / "h"))
    back = files.heatmap_document(spark, str(tmp_path / "h")).first()
    assert back.statistics.max_intensity == 1.0 and len(back.points) == back.statistics.total_points
    with pytest.raises(files.MissingDocument):
        files.heatmap_document(spark, str(tmp_path / "none")).first()
    with pytest.raises(BadParameter):
        e.heatmap(view(spark, SF, "heat_points"), 640, 480, grid=5)
    assert e.tiles(bounds=(0.0, 0.001, 0.0, 0.001), zoom=18).count() > 0
    with pytest.raises(BadParameter):
        e.tiles(bounds=(0.0, None, 0.0, 1.0))
    assert e.traffic(view(spark, SF, "detections"), 640, 480).first().statistics.max_intensity == pytest.approx(1.0)


def test_engine_markings(spark, tmp_path):
    mask = spark.range(91).crossJoin(spark.range(11).withColumnRenamed("id", "r")).select(F.lit("a").alias("image"), (F.col("r") + 10).cast("int").alias("r"), (F.col("id") + 10).cast("int").alias("c"))
    f = Engine(spark).markings(mask, "image", 640, 480)
    r = f.first().feature
    assert r.properties.marking_type == "lane_line" and r.properties.area_pixels == 900.0 and r.geometry.type == "Polygon"
    assert r.geometry.coordinates[0][0] == r.geometry.coordinates[0][-1]
    files.write_features(f, str(tmp_path / "f"))
    assert json.loads(spark.read.text(str(tmp_path / "f")).first().value)["type"] == "Feature"
    assert files.collection(f).first().metadata.total_markings == 1
    for rule in ("v1", "trainer", "parallel"):
        assert Engine(spark).markings(mask, "image", 640, 480, rule=rule).first().feature.properties.marking_type in ("lane_line", "crosswalk")


def test_overlap_join_finds_each_pair_once(spark):
    d = view(spark, SF, "detections").select("event_id", F.struct("x", "y", "w", "h").alias("box"), F.lit(1).alias("k"))
    got = spatial.overlap_join(d.select("k", F.col("event_id").alias("i"), F.col("box").alias("a")), d.select("k", F.col("event_id").alias("j"), F.col("box").alias("b")), ["k"], 50).select("i", "j").collect()
    rows = [(r.event_id, r.box) for r in d.collect()]
    want = {(i, j) for i, a in rows for j, b in rows if a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sampling_is_pushed_into_the_scan(spark):
    plan = traffic.sample_frames(table(spark, SF, "events"), 5, 300, "event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,300)]" in plan


def test_colours_and_rules(spark):
    c = lambda *v: [F.lit(x) for x in v]
    r = spark.range(1).select(pixels.hsv(*c(255, 0, 0)).alias("red"), pixels.hsv(*c(0, 0, 255)).alias("blue"), pixels.gray(*c(255, 255, 255)).alias("w"), pixels.gamma(F.lit(255), 0.8).alias("g"), shapes.classify_v2(*c(900.0, 91, 11, 900.0)).alias("k"), shapes.log_hu(F.lit(0.0)).alias("hu")).first()
    assert tuple(r.red) == (0, 255, 255) and tuple(r.blue) == (120, 255, 255) and r.w == 255 and r.g == 255 and r.k.type == "lane_line" and r.hu == 0


def test_streams(spark, tmp_path):
    points = view(spark, SF, "heat_points")
    points.write.parquet(str(tmp_path / "p"))
    s = density.stream_density(spark.readStream.schema(points.schema).parquet(str(tmp_path / "p")), 640, 480)
    s.writeStream.format("memory").queryName("dense").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    want = traffic.density(points, "px", "py", 640, 480)
    assert spark.table("dense").exceptAll(want).count() == 0 and want.exceptAll(spark.table("dense")).count() == 0
    events = table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).parquet(SF + "/event*.parquet")
    for name, df in (("hours", density.windowed(stream, "1 hour")), ("spans", density.sessions(stream, "30 minutes"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("hours").agg(F.sum("n")).first()[0] <= events.count()


def test_learning(spark):
    p = learning.prepared(view(spark, SF, "features").where("label < 2"))
    models = {"small": learning.RandomForestClassifier(numTrees=3, featuresCol="vector", labelCol="target", seed=1)}
    name, scores, model = learning.best_classifier(p, models, folds=2)
    assert name == "small" and 0 <= scores["small"] <= 1 and len(learning.importances(model)) == 9
    assert type(learning.classifiers(9, 2)["boosted"]).__name__ == "GBTClassifier" and type(learning.classifiers(9, 3)["boosted"]).__name__ == "OneVsRest"


def test_model_round_trip(spark, tmp_path):
    model, ready = Engine(spark).train(view(spark, SF, "features"), trees=3)
    files.save_model(model, str(tmp_path / "m"))
    again = files.load_model(str(tmp_path / "m")).transform(ready).select("vec_id", "prediction")
    assert again.exceptAll(model.transform(ready).select("vec_id", "prediction")).count() == 0


def test_progress(spark):
    from laneatlas.sources.adapters import stream
    from laneatlas.streaming.progress import Progress

    told = []
    listener = Progress(lambda rows, share: told.append((rows, share)), expected=1000)
    spark.streams.addListener(listener)
    try:
        density.drained(density.stream_density(stream(spark, SF, "heat_points"), 640, 480))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert told and told[-1][1] <= 1.0


def test_queries_train_the_whole_forest(spark, monkeypatch):
    from laneatlas.plans import learning as plans

    class Stop(Exception):
        pass

    asked = []

    def fit(self, samples):
        asked.append((self.getStages()[0].getNumTrees(), self.getStages()[0].getMaxDepth()))
        raise Stop

    monkeypatch.setattr(learning.Pipeline, "fit", fit)
    for query in (plans.train_rf_predict, plans.feature_importance):
        with pytest.raises(Stop):
            query(spark, SF)
    assert asked == [(200, 15)] * 2


def test_a_large_forest_votes_in_parts(spark, monkeypatch):
    """No more nodes than allowed are trained at once; all trees vote."""
    ready = learning.prepared(view(spark, SF.replace("0.001", "0.01"), "features"))
    made, fit = [], learning.Pipeline.fit

    def seen(self, samples):
        made.append(fit(self, samples))
        return made[-1]

    monkeypatch.setattr(learning.Pipeline, "fit", seen)
    monkeypatch.setattr(learning, "_NODES", 300, raising=False)
    rows = learning.forest_predicted(ready, trees=12, depth=6).collect()
    forests = [m.stages[-1] for m in made]
    assert sum(f.getNumTrees for f in forests) == 12 and len({f.getOrDefault("seed") for f in forests}) == len(forests) > 3
    assert all(f.totalNumNodes <= 300 * 1.3 for f in forests)
    votes = {}
    for f in forests:
        for r in f.transform(ready).select("vec_id", "rawPrediction").collect():
            votes[r.vec_id] = votes.get(r.vec_id, 0) + r.rawPrediction.toArray()
    assert len(rows) == 500 and all(abs(v.sum() - 12) < 1e-9 for v in votes.values())
    assert sum(votes[r.vec_id][int(r.prediction)] < votes[r.vec_id].max() - 1e-9 for r in rows) == 0


def test_importances_of_a_large_forest(spark, monkeypatch):
    ready = learning.prepared(view(spark, SF, "features"))
    whole = learning.train_forest(ready, trees=6, depth=4).stages[-1]
    sums = sum(t.featureImportances.toArray() for t in whole.trees)
    assert (sums / sums.sum()).tolist() == pytest.approx(whole.featureImportances.toArray().tolist())
    monkeypatch.setattr(learning, "_NODES", 40, raising=False)
    made, fit = [], learning.Pipeline.fit

    def seen(self, samples):
        made.append(fit(self, samples))
        return made[-1]

    monkeypatch.setattr(learning.Pipeline, "fit", seen)
    got = dict(learning.forest_importances(ready, trees=6, depth=4))
    assert len(made) > 1 and sum(m.stages[-1].getNumTrees for m in made) == 6 and sum(got.values()) == pytest.approx(1)
    sums = sum(t.featureImportances.toArray() for m in made for t in m.stages[-1].trees)
    assert [got[n] for n in learning.NAMES] == pytest.approx((sums / sums.sum()).tolist())
