"""Contours, stencils and the tracker against hand-made cases, invariants and plain NumPy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laneatlas.operators import contours as K
from laneatlas.operators import heatmap as H
from laneatlas.operators import raster as R
from laneatlas.sources.adapters import view
from laneatlas.streaming import tracker as T

BAR = [(10, 10), (100, 10), (100, 20), (10, 20)]


def test_bar_measures():
    assert K.shoelace(BAR) == 900
    assert K.perimeter(BAR) == 200
    w, h, _ = K.rotated_box(BAR)
    assert max(w, h) / min(w, h) == pytest.approx(9)


def test_filled_block_outline():
    image = np.zeros((8, 9), bool)
    image[2:6, 1:8] = True
    assert sorted(K.outline(image)) == [(1, 2), (1, 5), (7, 2), (7, 5)]
    assert K.shoelace(K.outline(image)) == (7 - 1) * (4 - 1)


def test_rotated_box_of_a_diamond():
    w, h, t = K.rotated_box([(0, 2), (2, 0), (4, 2), (2, 4)])
    assert (w, h) == pytest.approx((math.sqrt(8), math.sqrt(8)))


def test_validity_and_simplification():
    assert K.valid(BAR) and not K.valid([(0, 0), (4, 4), (4, 0), (0, 4)]) and not K.valid([(0, 0), (1, 1)])
    assert K.simplified([(0, 0), (50, 1), (100, 0), (100, 50), (0, 50)]) == [(0, 0), (100, 0), (100, 50), (0, 50)]


def _crosses(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


corners = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=9, unique=True)


@settings(max_examples=200, deadline=None)
@given(corners)
def test_crossings_by_a_sweep_are_all_of_them(ring):
    n = len(ring)
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if _crosses(ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n])]
    assert K.crossings(ring) == want


def test_repair_of_crossing_rings():
    ears = K.split([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert sorted(map(sorted, ears)) == [[(0, 0), (0, 2), (1, 1)], [(1, 1), (2, 0), (2, 2)]] and [K.shoelace(e) for e in ears] == [1, 1]
    star = [(0, 3), (6, 3), (1, 7), (3, 0), (5, 7)]
    (whole,) = K.split(star)  # its middle is wound around twice: one ring of ten corners
    assert len(whole) == 10 and K.valid(whole)
    assert K.repaired(BAR) == [BAR] and K.repaired([(0, 0), (1, 1)]) == [[(0, 0), (1, 1)]]


@settings(max_examples=150, deadline=None)
@given(corners)
def test_split_covers_what_the_ring_winds_around(ring):
    """Points off the grid are wound around by the ring exactly if the parts' signed windings add up to more than 0."""
    if len(set(ring)) < 3:
        return
    parts = K.split(ring)
    rng = np.random.default_rng(len(ring))
    for x, y in rng.uniform(-1, 13, (60, 2)):
        wind = lambda r: sum((1 if b[1] > a[1] else -1) for a, b in zip(r, r[1:] + r[:1], strict=True) if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])  # noqa: B023, E731
        assert (wind(ring) != 0) == (sum(wind(r) for r in parts) > 0)


def _flooded(mask):
    """Labels by flooding from pixel to pixel."""
    label, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask), strict=True):
        if not label[r, c]:
            n += 1
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not label[y, x]:
                    label[y, x] = n
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return label


def test_components_by_runs_equal_flooding():
    rng = np.random.default_rng(3)
    for _ in range(200):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.uniform(0.1, 0.9)
        assert (K.components(mask) == _flooded(mask)).all()


def test_shapes_in_holes_are_not_outermost():
    image = np.zeros((12, 12), bool)
    image[1:10, 1:10] = True
    image[3:8, 3:8] = False
    image[5, 5] = True
    image[11, 11] = True
    assert [s[0] for s in K.shapes_of(image)] == [1, 2, 3] and [s[0] for s in K.shapes_of(image, external=True)] == [1, 3]


def test_a_large_component_takes_no_pixel_loop():
    import time

    image = np.zeros((1792, 2048), bool)
    image[100:1700, 100:1900] = True
    image[200:1600:4, 200:1800:4] = False
    at = time.perf_counter()
    (found,) = K.shapes_of(image)
    assert found[1] == image.sum() and time.perf_counter() - at < 20


masks = st.lists(st.lists(st.booleans(), min_size=6, max_size=6), min_size=6, max_size=6)


@settings(max_examples=60, deadline=None)
@given(masks)
def test_outline_encloses_its_component(rows):
    image = np.array(rows)
    label = K.components(image)
    for part in range(1, label.max() + 1):
        ring = K.outline(label == part)
        assert all(label[y, x] == part for x, y in ring)
        if len(ring) > 2:
            inside = K.filled(ring, 6, 6)
            assert inside[label == part].all()


def test_mirrored_border_and_kernel():
    assert [H.mirrored(i, 4) for i in (-2, -1, 0, 3, 4, 5)] == [2, 1, 0, 3, 2, 1]
    assert sum(H.gaussian(11)) == pytest.approx(1) and len(R.ellipse(5)) == 17
    total = {}
    for _, t, w in H.kernel_rows(20, 11):
        total[t] = total.get(t, 0) + w
    assert all(v == pytest.approx(1) for v in total.values())


def test_stencils_bracket_the_mask(spark):
    mask = view(spark, "/root/testdata/sf0.001", "pixels").where("gray > 140").select("vec_id", "r", "c")
    rows = lambda df: {tuple(r) for r in df.select("vec_id", "r", "c").collect()}
    e = R.ellipse(3)
    low, mid, high = rows(R.opened(mask, "vec_id", e, 8, 8)), rows(mask), rows(R.closed(mask, "vec_id", e, 8, 8))
    assert low <= mid <= high and low and high


def _boxes(*b):
    return np.array(b)


def test_tracker_step():
    t = T.Tracker(patience=2)
    assert t.step(_boxes((0, 0, 10, 10), (100, 0, 10, 10))) == [(0, 0), (1, 1)]
    assert t.step(_boxes((101, 0, 10, 10), (1, 0, 10, 10))) == [(0, 1), (1, 0)]
    assert t.tracks[0]["v"] == [0.3, 0.0] and t.tracks[0]["n"] == 2
    assert t.step(np.zeros((0, 4))) == [(0, None), (1, None)]
    t.step(np.zeros((0, 4)))
    assert t.step(np.zeros((0, 4))) == []
    assert t.step(_boxes((0, 0, 10, 10))) == [(2, 0)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 12), st.integers(1, 12)), max_size=5), max_size=6))
def test_greedy_equals_repeated_argmax(frames):
    t = T.Tracker()
    for boxes in frames:
        before = {k: v["box"] for k, v in t.tracks.items()}
        live = dict(t.step(np.array(boxes).reshape(-1, 4)))
        m = np.array([[_iou(a, b) for b in boxes] for a in before.values()]).reshape(len(before), len(boxes))
        want = {}
        while m.size and m.max() >= 0.3:
            i, j = np.unravel_index(m.argmax(), m.shape)
            want[list(before)[i]] = int(j)
            m[i, :] = m[:, j] = 0
        assert {k: q for k, q in live.items() if k in before and q is not None} == want
        assert sorted(q for q in live.values() if q is not None) == list(range(len(boxes)))


def _iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def _run(spark, boxes, frames=None, **how):
    d = spark.createDataFrame([("v", f, i, x, 0, 10, 10) for i, (f, x) in enumerate(boxes)], "video_id string, frame_id long, event_id long, x int, y int, w int, h int")
    clock = None if frames is None else spark.createDataFrame([("v", f) for f in frames], "video_id string, frame_id long")
    return T.track(d, clock, **how), d, clock


def test_a_gap_of_empty_frames_ends_a_track(spark):
    boxes = [(1, 0), (2, 0), (100, 0)]
    tracks, _, _ = _run(spark, boxes)
    got = {r.track_id: (r.n, r.frames) for r in tracks.groupBy("track_id").agg(F.max("n_positions").alias("n"), F.count("*").alias("frames")).collect()}
    assert got == {0: (2, 32), 1: (1, 1)}  # frames 1 to 32, then a new one
    seen = {(r.frame_id, r.track_id) for r in tracks.where("seen").collect()}
    assert seen == {(1, 0), (2, 0), (100, 1)}


def test_tracks_age_by_the_clock(spark):
    boxes = [(1, 0), (32, 0), (64, 0)]
    lives = lambda t: sorted((r.track_id, r.frame_id) for r in t.where("seen").collect())
    assert lives(_run(spark, boxes)[0]) == [(0, 1), (0, 32), (1, 64)]  # 31 frames on it is matched before it is dropped; 32 are too many
    assert lives(_run(spark, boxes, [1, 32, 64])[0]) == [(0, 1), (0, 32), (0, 64)]
    assert lives(_run(spark, boxes, range(1, 65, 31))[0]) == lives(_run(spark, boxes, [*range(1, 65, 31), 64])[0])
    late, _, clock = _run(spark, boxes, range(1, 120))
    assert late.agg({"frame_id": "max"}).first()[0] == 94
    assert _run(spark, [(2, 0), (64, 0)], rate=2)[0].where("seen").select("track_id").distinct().count() == 1
    six = [(k, 0) for k in range(1, 8)]
    long, _, clock = _run(spark, six, range(1, 60))
    assert T.paths(long).count() == 1 and T.paths(long, frames=clock).count() == 0 and T.paths(long, "all").count() == 1


def test_unseen_tracks_count_in_the_density_of_empty_frames(spark):
    cells = T.density(_run(spark, [(1, 0), (2, 0), (9, 0)])[0], 100, 100, 10).collect()
    assert [(r.gy, r.gx, r.n) for r in cells] == [(0, 0, 8)]


def test_a_stream_with_a_clock_survives_a_restart(spark, tmp_path):
    boxes = [(1, 0), (2, 0), (3, 1), (40, 0), (41, 0), (90, 0)]
    want, d, clock = _run(spark, boxes, range(1, 95))
    rows = T.with_frames(d, clock)
    for name, some in (("a", "frame_id <= 20"), ("b", "frame_id > 20 and frame_id <= 41"), ("c", "frame_id > 41")):
        rows.where(some).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        made = T.track_stream(stream.drop("_none"), stream.where("false").select("video_id", "frame_id"))
        q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_tracks_as_batch(spark, tmp_path):
    d = view(spark, "/root/testdata/sf0.001", "detections")
    d.where("frame_id <= 15").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    d.where("frame_id > 15").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    want = sorted(map(tuple, T.track(d).select("video_id", "frame_id", "track_id", "n_positions").collect()))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = T.track_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select video_id, frame_id, track_id, n_positions from tracked").collect()))
    assert got == want
    assert T.paths(T.track(d), "all").count() >= T.paths(T.track(d)).count()


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class _Map:
    def __init__(self):
        self.m = {}

    def iterator(self):
        return iter(list(self.m.items()))

    def updateValue(self, k, v):  # noqa: N802
        self.m[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.m[k]


class _Handle:
    def getMapState(self, *_):  # noqa: N802
        return _Map()

    def getValueState(self, *_):  # noqa: N802
        return _Value()


def test_a_long_micro_batch_is_sorted_by_runs_and_given_in_parts(spark, monkeypatch):
    """A video's new frames may be many: neither its boxes nor its rows are held at once."""
    monkeypatch.setattr(T, "_RUN", 700, raising=False)
    monkeypatch.setattr(T, "_ROWS", 1000, raising=False)
    d = view(spark, "/root/testdata/sf0.01", "detections").where("video_id = 'view'")
    want = sorted(map(tuple, T.track(d).collect()), key=str)
    rows = d.toPandas().sample(frac=1, random_state=1)
    state = T.TrackerState()
    state.init(_Handle())
    got = []
    for some in (rows["frame_id"] <= 300, rows["frame_id"] > 300):
        new = rows[some]
        parts = (new.iloc[a : a + 100] for a in range(0, len(new), 100))
        made = list(state.handleInputRows(("view",), parts, None))
        assert max(map(len, made)) <= 1000
        got += [tuple(r) for p in made for r in p.astype(object).where(p.notna(), None).itertuples(index=False)]
    assert len(got) > 20_000
    assert sorted(got, key=str) == want


def test_frames_go_on_until_the_end_by_one_row_a_video(spark):
    boxes = [(1, 0), (2, 0), (40, 0)]
    end = lambda f: spark.createDataFrame([("v", f)], "video_id string, frame_id long")
    d = _run(spark, boxes)[1]
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    for f in (2, 40, 45, 70, 71, 100):
        assert rows(T.track(d, until=end(f))) == rows(_run(spark, boxes, range(1, max(f, 40) + 1))[0])
    assert rows(T.track(d, until=end(10**12))) == rows(_run(spark, boxes, range(1, 100))[0])


def test_a_stream_may_take_longer_than_the_limit_of_a_standstill(spark, tmp_path):
    import time

    from laneatlas.streaming.density import drained

    def slow(batches):
        time.sleep(8)
        yield from batches

    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert drained(stream.mapInPandas(slow, "id long"), "append", seconds=4).count() == 5
