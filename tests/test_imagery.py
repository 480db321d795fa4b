"""Tiles to imagery and frames as a stream: commits, aborts, rates, restarts."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from laneatlas.engine import BadParameter, Engine
from laneatlas.operators import tiles as T
from laneatlas.sources import frame_stream, frames, imagery, locations, tiles

SHIPPED = {
    "bounds": {"min_lat": 40.7560997756636, "max_lat": 40.75974059207392, "min_lon": -73.98948669433594, "max_lon": -73.98399353027344}, "zoom": 19, "size": {"width": 2048, "height": 1792},
    "source": "ESRI World Imagery", "tiles": {"min_x": 154389, "max_x": 154396, "min_y": 197032, "max_y": 197038},
}


@pytest.fixture(scope="module")
def server():
    """Serves tiles of one colour by their place, but none where x + y is a multiple of seven; keeps the times of requests."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(time.monotonic())
            _, x, y = (int(v) for v in self.path.strip("/").split("/"))
            if (x + y) % 7 == 0:
                self.send_error(404)
                return
            body = imagery.png(np.full((256, 256, 3), (x % 256, y % 256, 9), np.uint8))
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/{{z}}/{{x}}/{{y}}", asked
    made.shutdown()


def test_sidecar_is_the_shipped_one(spark):
    (extent,) = T.stitched_extent(locations.with_bounds(locations.location(spark, "times_square_nyc"))).collect()
    made = imagery.sidecar(extent.asDict(recursive=True), tiles.SERVERS["esri_satellite"][1])
    assert {k: round(v, 9) for k, v in made.pop("bounds").items()} == {k: round(v, 9) for k, v in SHIPPED["bounds"].items()}
    assert made == {k: v for k, v in SHIPPED.items() if k != "bounds"}


def test_from_a_place_to_a_picture(spark, server, tmp_path):
    url, asked = server
    path = str(tmp_path / "nyc")
    asked.clear()
    made = Engine(spark).imagery(path, "times_square_nyc", template=url, attribution="test", rate=80.0, slots=3)
    assert made["size"] == SHIPPED["size"] and made["source"] == "test"
    assert len(asked) == 56 and max(asked) - min(asked) >= 53 / 80 * 0.9  # one rate over all three tasks
    gone = sum((x + y) % 7 == 0 for x in range(154389, 154397) for y in range(197032, 197039))
    stored = json.loads((tmp_path / "nyc" / "sidecar.json").read_text())
    assert stored["missing"] == gone and stored["fetched"] == 56 - gone and stored["tiles"] == SHIPPED["tiles"]
    assert sorted(p.name for p in (tmp_path / "nyc").iterdir()) == ["19", "sidecar.json"]
    rows = imagery.pictures(spark, path, strip=4).orderBy("strip").collect()
    assert [(r.width, r.height, r.y) for r in rows] == [(2048, 1024, 197032), (2048, 768, 197036)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.png").write_bytes(bytes(rows[1].png))
    image = spark.read.format("image").load(str(tmp_path / "p")).select("image.*").first()
    got = np.frombuffer(image.data, np.uint8).reshape(768, 2048, 3)[:, :, ::-1]
    for x in range(154389, 154397):
        for y in range(197036, 197039):
            want = (0, 0, 0) if (x + y) % 7 == 0 else (x % 256, y % 256, 9)
            assert tuple(got[(y - 197036) * 256 + 7, (x - 154389) * 256 + 200]) == want


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    tiles.register(spark)
    spark.dataSource.register(imagery.ImagerySink)
    good = spark.range(8, numPartitions=2).select(F.lit(3).alias("zoom"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"), F.lit(b"x").alias("data"))
    path = tmp_path / "out"
    with pytest.raises(Exception, match="broken"):
        good.withColumn("data", F.when(F.col("x") == 7, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("data"))).write.format("imagery").mode("append").save(str(path))
    assert not path.exists() or list(path.iterdir()) == []
    good.write.format("imagery").mode("append").save(str(path))
    assert len(list((path / "3").iterdir())) == 8 and json.loads((path / "sidecar.json").read_text())["fetched"] == 8
    good.where("x < 2").write.format("imagery").mode("overwrite").save(str(path))
    assert len(list((path / "3").iterdir())) == 2
    with pytest.raises(BadParameter):
        Engine(spark).imagery(str(path), bounds=(1.0, None, 2.0, 3.0))


def _write(spark, path, name, video, first, n):
    rows = [(video, k, 2, 2, 1.0, bytes([k % 256] * 4)) for k in range(first, first + n)]
    spark.createDataFrame(rows, frames.SCHEMA).toPandas().to_parquet(path / name)


def _drain(spark, path, out, **how):
    q = frame_stream.stream_footage(spark, str(path), **how).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_a_restarted_stream_reads_each_frame_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    _write(spark, src, "a.parquet", "v", 0, 150)
    _drain(spark, src, out)
    _write(spark, src, "b.parquet", "v", 150, 90)
    _drain(spark, src, out)
    q = frame_stream.stream_footage(spark, str(src), per_batch=7).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).start()
    _write(spark, src, "c.parquet", "v", 240, 60)
    at = time.time()
    while time.time() - at < 60 and spark.read.schema(frames.SCHEMA).parquet(str(out / "rows")).count() < 250:
        time.sleep(0.5)
    q.stop()  # somewhere in c
    _write(spark, src, "d.parquet", "w", 0, 5)
    for _ in range(2):  # a batch that was under way is done again on its own first
        _drain(spark, src, out)
    got = sorted((r.video_id, r.frame_idx) for r in spark.read.parquet(str(out / "rows")).collect())
    assert got == [("v", k) for k in range(300)] + [("w", k) for k in range(5)]


def test_batches_rate_and_limit(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    _write(spark, src, "a.parquet", "v", 0, 40)
    _write(spark, src, "b.parquet", "v", 40, 40)
    _drain(spark, src, out, rate=3, max_frames=50)
    assert sorted(r.frame_idx for r in spark.read.parquet(str(out / "rows")).collect()) == list(range(0, 50, 3))
    reader = frame_stream.FrameStreamReader({"path": str(src), "per_batch": "25"})
    at, seen = reader.initialOffset(), []
    for _ in range(10):
        end = reader.latestOffset()
        if end == at:
            break
        seen += [(p.name, p.first, p.end) for p in reader.partitions(at, end)]
        reader.commit(end)
        at = end
    assert seen == [("a.parquet", 0, 25), ("a.parquet", 25, 40), ("b.parquet", 0, 10), ("b.parquet", 10, 35), ("b.parquet", 35, 40)]
    (tmp_path / "none").mkdir()
    assert frame_stream.FrameStreamReader({"path": str(tmp_path / "none")}).latestOffset() == {"file": "", "rows": 0}
