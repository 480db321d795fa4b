"""Vehicle tracking by greedy overlap: one step a processed frame, with boxes or without, the same step in batch and as a stream.

Tracks age by processed frames. Which those are is told by a clock, a table or stream of frames beside the boxes; without one every `rate`-th frame
from the first to the last with boxes counts. Tracking is sequential in a video; videos are tracked side by side.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from laneatlas.functions import geo
from laneatlas.session import ship

#: Columns of a track's state in a frame.
SCHEMA = "video_id string, frame_id long, track_id int, event_id long, x int, y int, w int, h int, cx int, cy int, vx double, vy double, n_positions int, seen boolean"


class Tracker:
    """State: tracks by id (box, centre, velocity, positions, last_seen), next_id, number of processed frames.

    `since` of a track: the place in a `Spans` from which its rows are still to be given. `told`: (last_seen, track) by rising last_seen, outdated ones as
    well. `sides`: left, right, top and bottom of live tracks' boxes by slot, once there are many."""

    def __init__(self, least: float = 0.3, patience: int = 30, alpha: float = 0.3) -> None:
        self.least, self.patience, self.alpha = least, patience, alpha
        self.tracks: dict[int, dict] = {}
        self.next_id = self.frame = 0
        self.told: deque[tuple[int, int]] = deque()
        self.sides: np.ndarray | None = None
        self.slots: list[int | None] = []
        self.free: list[int] = []

    def load(self, tracks: dict[int, dict], next_id: int, frame: int) -> None:
        """Go on from such tracks."""
        self.tracks, self.next_id, self.frame = tracks, next_id, frame
        self.told.extend(sorted((t["seen"], k) for k, t in tracks.items()))

    def _place(self, k: int, t: dict) -> None:
        """Write a track's sides to its slot."""
        if "slot" not in t:
            if not self.free:
                n = len(self.slots)
                self.sides = np.concatenate([self.sides, np.tile(_NOWHERE, max(n, 16))], axis=1)
                self.free = list(range(self.sides.shape[1] - 1, n - 1, -1))
                self.slots += [None] * (self.sides.shape[1] - n)
            t["slot"] = self.free.pop()
            self.slots[t["slot"]] = k
        x, y, w, h = t["box"]
        self.sides[:, t["slot"]] = x, x + w, y, y + h

    def _ended(self, k: int) -> dict:
        t = self.tracks.pop(k)
        if "slot" in t:
            self.sides[:, t["slot"]] = _NOWHERE[:, 0]
            self.free.append(t["slot"])
        return t

    def _overlaps(self, boxes: list[list[int]]) -> list[tuple[float, int, int]]:
        """Pairs that overlap enough, largest first: negative overlap, track, box."""
        if len(self.tracks) * len(boxes) <= _FEW or self.least <= 0:
            pairs = ((k, q) for k in self.tracks for q in range(len(boxes)))
        else:
            if self.sides is None:
                self.sides = np.zeros((4, 0), np.int64)
                for k, t in self.tracks.items():
                    self._place(k, t)
            x, y, w, h = np.array(boxes, np.int64).T[:, :, None]
            left, right, top, bottom = self.sides
            q, slot = np.nonzero((np.minimum(right, x + w) > np.maximum(left, x)) & (np.minimum(bottom, y + h) > np.maximum(top, y)))
            pairs = ((self.slots[i], j) for i, j in zip(slot.tolist(), q.tolist(), strict=True))
        return sorted((-o, k, q) for k, q in pairs if (o := _overlap(self.tracks[k]["box"], boxes[q])) >= self.least)

    def step(self, boxes: np.ndarray) -> list[tuple[int, int | None]]:
        """One frame's boxes (n x 4: x, y, w, h). Live tracks afterwards, each with the number of its box or None.

        Pairs are taken by falling overlap, then rising track, then rising box, each side once: the same as taking the first
        largest of the matrix again and again. Unmatched boxes become tracks in their order; tracks unseen for more than
        `patience` frames end.
        """
        match = self._advance([[int(v) for v in b] for b in np.asarray(boxes).reshape(-1, 4).tolist()])
        return [(k, match.get(k)) for k in self.tracks]

    def _advance(self, boxes: list[list[int]], out: Spans | None = None, here: int = 0, ids: list[int] | None = None) -> dict[int, int]:
        """step(), whose rows go to place `here` of `out`; the number of its box for each track that the frame holds."""
        self.frame += 1
        match: dict[int, int] = {}
        taken: set[int] = set()
        if boxes and self.tracks:
            for _, k, q in self._overlaps(boxes):
                if k not in match and q not in taken:
                    match[k] = q
                    taken.add(q)
        keep = 1 - self.alpha
        for k, q in match.items():
            t, (x, y, w, h) = self.tracks[k], boxes[q]
            if out is not None:
                out.unseen(k, t, here)
            c = [x + w // 2, y + h // 2]
            t["v"] = [self.alpha * (c[i] - t["c"][i]) + keep * t["v"][i] for i in (0, 1)]
            t["box"], t["c"], t["n"], t["seen"] = [x, y, w, h], c, t["n"] + 1, self.frame
        for q in range(len(boxes)):
            if q not in taken:
                x, y, w, h = boxes[q]
                self.tracks[self.next_id] = {"box": [x, y, w, h], "c": [x + w // 2, y + h // 2], "v": [0.0, 0.0], "n": 1, "seen": self.frame}
                match[self.next_id] = q
                self.next_id += 1
        for k, q in match.items():
            t = self.tracks[k]
            self.told.append((self.frame, k))
            if self.sides is not None:
                self._place(k, t)
            if out is not None:
                out.seen(k, t, here, ids[q])
        for k, t in self._ending(self.frame - self.patience):
            if out is not None:
                out.unseen(k, t, here)
        return match

    def _ending(self, first: int) -> Iterator[tuple[int, dict]]:
        """Take away the tracks that were last seen before this frame."""
        while self.told and self.told[0][0] < first:
            seen, k = self.told.popleft()
            if k in self.tracks and self.tracks[k]["seen"] == seen:
                yield k, self._ended(k)

    def rows(self, frame: int, boxes: list[list[int]], ids: list[int], out: Spans) -> None:
        if boxes or self.tracks:
            out.frames.append(frame)
            self._advance(boxes, out, len(out.frames) - 1, ids)
        else:
            self.frame += 1

    def idle(self, first: int, end: int, rate: int, out: Spans) -> None:
        """Frames without boxes from `first` to before `end`, `rate` apart; once no track lives, the rest is only counted."""
        n = len(range(first, end, rate))
        if n and self.tracks:
            here, left = len(out.frames), self.patience - self.frame
            out.frames += range(first, end, rate)[: self.told[-1][0] + left]
            for k, t in self._ending(n - left):
                out.unseen(k, t, here + t["seen"] + left)
        self.frame += n

    def settle(self, out: Spans) -> None:
        """Give the rows of live tracks that are still to be given."""
        for k, t in self.tracks.items():
            out.unseen(k, t, len(out.frames))


#: So many pairs of tracks and boxes are compared one by one.
_FEW = 8
#: Sides that meet no box.
_NOWHERE = np.array([[2**62], [-(2**62)], [2**62], [-(2**62)]])


def _overlap(a: list[int], b: list[int]) -> float:
    wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(wide, 0) * max(high, 0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
#: Rows of a batch that a task gives.
_ROWS = 20_000


class Spans:
    """Rows of tracks, held as spans of frames in which a track does not change, so that frames without its box cost a row of NumPy each, not a Python object."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.frames: list[int] = []
        self.spans: list[tuple] = []
        self.videos: list = []
        self.begun: list[int] = []
        self.n = 0

    def video(self, name) -> None:
        """What follows belongs to this video."""
        if self.begun and self.begun[-1] == len(self.spans):
            self.videos.pop()
            self.begun.pop()
        self.videos.append(name)
        self.begun.append(len(self.spans))

    def seen(self, k: int, t: dict, here: int, event: int) -> None:
        self.spans.append((here, 1, k, event, *t["box"], *t["c"], *t["v"], t["n"], True))
        t["since"] = here + 1
        self.n += 1

    def unseen(self, k: int, t: dict, end: int) -> None:
        n = end - t["since"]
        if n > 0:
            self.spans.append((t["since"], n, k, 0, *t["box"], *t["c"], *t["v"], t["n"], False))
            t["since"] = end
            self.n += n

    def given(self, tracker: Tracker, last: bool = False) -> Iterator[list]:
        """The columns of what is held, in parts of `_ROWS`, and none of it is held any more; live tracks of `tracker`, to whose video it goes on, included.

        last: whatever there is, not only once there is enough for a part."""
        if self.n < _ROWS and not last:
            return
        tracker.settle(self)
        video = self.videos[-1] if self.videos else None
        if self.spans:
            yield from self._parts()
        self.clear()
        self.video(video)
        for t in tracker.tracks.values():
            t["since"] = 0

    def _parts(self) -> Iterator[list]:
        at, counts, *columns = (np.array(c) for c in zip(*self.spans, strict=True))
        video = np.repeat(np.arange(len(self.videos)), np.diff([*self.begun, len(self.spans)]))
        frames, ends, names = np.array(self.frames, np.int64), np.cumsum(counts), pa.array(self.videos, pa.string())
        for a in range(0, self.n, _ROWS):
            row = np.arange(a, min(a + _ROWS, self.n))
            span = np.searchsorted(ends, row, side="right")
            yield [names.take(pa.array(video[span])), frames[at[span] + row - ends[span] + counts[span]], *[c[span] for c in columns]]


def _batch(columns: list) -> pa.RecordBatch:
    """Arrow's form of columns in the order video, frame, track, event ...; only a frame that holds a track has an event."""
    columns = [c if isinstance(c, pa.Array) else pa.array(c.astype(f.type.to_pandas_dtype()), f.type, mask=~columns[-1] if f.name == "event_id" else None) for c, f in zip(columns, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def with_frames(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes (video_id, frame_id, event_id, x, y, w, h) and a row without a box (null event_id) for each row of `frames` (video_id, frame_id), so that
    frames without boxes are met too. A union: nothing is shuffled; both may be streams."""
    boxes = detections.select("video_id", "frame_id", "event_id", "x", "y", "w", "h")
    none = [F.lit(None).cast(dict(boxes.dtypes)[c]).alias(c) for c in boxes.columns[2:]]
    return boxes.unionByName(frames.select("video_id", F.col("frame_id").cast(dict(boxes.dtypes)["frame_id"]).alias("frame_id"), *none))


def _in_turn(blocks: Iterable[tuple]) -> Iterator[tuple]:
    """(video, frame, boxes, ids) of each frame of blocks (videos, frames, own, ids, boxes) of rows in order, own telling which have a box; the last frame
    of a block may go on in the next one."""
    held: tuple | None = None
    for videos, frame, own, ids, boxes in blocks:
        if not len(frame):
            continue
        coded = videos.dictionary_encode()
        names, code = [*coded.dictionary.to_pylist(), None], np.asarray(coded.indices.fill_null(len(coded.dictionary)))
        cut = (np.flatnonzero((frame[1:] != frame[:-1]) | (code[1:] != code[:-1])) + 1).tolist()
        owned = np.concatenate([[0], np.cumsum(own)]).tolist()
        ids, boxes = ids[own].tolist(), boxes[own].tolist()
        for a, b in zip([0, *cut], [*cut, len(frame)], strict=True):
            i, j = owned[a], owned[b]
            part = (names[code[a]], int(frame[a]), boxes[i:j], ids[i:j])
            if held is not None and held[:2] == part[:2]:
                part = (*held[:2], held[2] + part[2], held[3] + part[3])
            elif held is not None:
                yield held
            held = part
    if held is not None:
        yield held


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        boxes = np.stack([np.asarray(batch.column(k).fill_null(0)) for k in range(3, 7)], axis=1)
        yield batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2).is_valid()), np.asarray(batch.column(2).fill_null(0)), boxes


def track(detections: DataFrame, frames: DataFrame | None = None, rate: int = 1, until: DataFrame | None = None, **how) -> DataFrame:
    """Every live track after each processed frame, by video; seen tells whether the frame held it.

    frames (video_id, frame_id): the processed frames. Without them, every rate-th frame from a video's first to its last one with boxes; rows with a
    null event_id stand for frames without boxes. until (video_id, frame_id), without frames: a video's processed frames go on to that one, where its boxes
    end before it; a row a video in place of a row a frame. A track ends once more than `patience` processed frames have not held it.
    A task steps over batches of a video's frames in order; it holds live tracks and one batch."""
    ship(detections.sparkSession)
    filled = frames is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, t, last, out = None, None, 0, Spans()
        for video, frame, boxes, ids in _in_turn(_blocks(batches)):
            if video != now or t is None:
                if t is not None:
                    t.settle(out)
                now, t = video, Tracker(**how)
                out.video(now)
            elif filled:
                t.idle(last + rate, frame, rate, out)
            t.rows(frame, boxes, ids, out)
            last = frame
            yield from map(_batch, out.given(t))
        if t is not None:
            yield from map(_batch, out.given(t, last=True))

    rows = detections.select("video_id", "frame_id", "event_id", "x", "y", "w", "h") if filled and until is None else with_frames(detections, until if filled else frames)
    rows = rows.withColumn("frame_id", F.col("frame_id").cast("long")).withColumn("event_id", F.col("event_id").cast("long"))
    return rows.repartition(F.col("video_id")).sortWithinPartitions("video_id", "frame_id", F.col("event_id").asc_nulls_last()).mapInArrow(run, SCHEMA)


def _frame(columns: list) -> pd.DataFrame:
    out = _batch(columns).to_pandas()
    out["event_id"] = pd.arrays.IntegerArray(columns[3], ~columns[-1])
    return out


#: Rows that a task sorts at once.
_RUN = 500_000


def _ordered(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts, axis=1)
    return rows[:, np.lexsort((rows[2], rows[1], rows[0]))]


def _spilled(rows: np.ndarray) -> np.ndarray:
    with tempfile.TemporaryFile() as f:
        rows.tofile(f)
        return np.memmap(f, rows.dtype, "r", shape=rows.shape)


def _merged(runs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Runs in order as blocks in order of some `_RUN` rows, whole frames each."""
    at, step = [0] * len(runs), max(1, _RUN // len(runs))
    while open_ := [k for k, r in enumerate(runs) if at[k] < r.shape[1]]:
        top = min(int(runs[k][0, min(at[k] + step, runs[k].shape[1]) - 1]) for k in open_)
        parts = []
        for k in open_:
            end = at[k] + int(np.searchsorted(runs[k][0, at[k] :], top, side="right"))
            parts.append(np.array(runs[k][:, at[k] : end]))
            at[k] = end
        yield _ordered(parts)


def _sorted(video, parts: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """A video's new rows by frame and event, those without a box last, as blocks. More than `_RUN` are sorted by runs, in temporary files of the task that
    end with it, and merged."""
    runs, held, n = [], [], 0
    for p in parts:
        numbers = [p[c].fillna(0).to_numpy(np.int64) for c in ("event_id", "x", "y", "w", "h")]
        held.append(np.stack([p["frame_id"].to_numpy(np.int64), p["event_id"].isna().to_numpy(np.int64), *numbers]))
        n += len(p)
        if n >= _RUN:
            runs.append(_spilled(_ordered(held)))
            held, n = [], 0
    if held:
        runs.append(_ordered(held))
    for rows in runs if len(runs) == 1 else _merged(runs):
        yield pa.repeat(pa.scalar(video, pa.string()), rows.shape[1]), rows[0], rows[1] == 0, rows[2], rows[3:].T


class TrackerState(StatefulProcessor):
    """The step over one video's new frames. Its tracks are entries of a map state, of which a batch writes those it has changed and removes those that have
    ended; a value state holds the next id, the number of processed frames and the last frame."""

    def __init__(self, rate: int = 1, filled: bool = True, how: dict | None = None) -> None:
        self.rate, self.filled, self.how = rate, filled, how or {}

    def init(self, handle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id int", "x int, y int, w int, h int, cx int, cy int, vx double, vy double, n int, seen long")
        self.clock = handle.getValueState("clock", "next_id int, frame long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t, last = Tracker(**self.how), None
        if self.clock.exists():
            next_id, frame, last = self.clock.get()
            held = {k: {"box": [x, y, w, h], "c": [cx, cy], "v": [vx, vy], "n": n, "seen": seen, "since": 0} for (k,), (x, y, w, h, cx, cy, vx, vy, n, seen) in self.tracks.iterator()}
            t.load(dict(sorted(held.items())), next_id, frame)
        before, since, out = set(t.tracks), t.frame, Spans()
        out.video(key[0])
        for _, frame, boxes, ids in _in_turn(_sorted(key[0], rows)):
            if self.filled and last is not None:
                t.idle(last + self.rate, frame, self.rate, out)
            t.rows(frame, boxes, ids, out)
            last = frame
            yield from map(_frame, out.given(t))
        for k, v in t.tracks.items():
            if v["seen"] > since:
                self.tracks.updateValue((k,), (*v["box"], *v["c"], *v["v"], v["n"], v["seen"]))
        for k in before - set(t.tracks):
            self.tracks.removeKey((k,))
        self.clock.update((t.next_id, t.frame, last))
        yield from map(_frame, out.given(t, last=True))

    def close(self) -> None:
        pass


#: The state store that map states need.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def track_stream(detections: DataFrame, frames: DataFrame | None = None, rate: int = 1, **how) -> DataFrame:
    """As track(), over a stream whose frames arrive whole and in order; state survives restarts in the query's checkpoint.

    Names RocksDB as the session's state store, which map states need."""
    spark = detections.sparkSession
    ship(spark)
    spark.conf.set(_STORE, _ROCKS)
    rows = detections.select("video_id", "frame_id", "event_id", "x", "y", "w", "h") if frames is None else with_frames(detections, frames)
    return rows.groupBy("video_id").transformWithStateInPandas(TrackerState(rate, frames is None, how), SCHEMA, "Append", "None")


def density(tracks: DataFrame, width: int, height: int, grid: int, observed: bool = False, digits: int | None = 6) -> DataFrame:
    """Cells with the number of live tracks of two or more positions summed over frames (also while unseen, unless observed), and
    the sum of their velocities, to so many digits (None: all)."""
    total = lambda c: F.sum(c) if digits is None else F.round(F.sum(c), digits)
    t = tracks.where("n_positions >= 2")
    t = t.where("seen") if observed else t
    return t.groupBy(geo.cell(F.col("cy"), height, grid).alias("gy"), geo.cell(F.col("cx"), width, grid).alias("gx")).agg(F.count("*").alias("n"), total("vx").alias("vx"), total("vy").alias("vy"))


def paths(tracks: DataFrame, which: str = "alive_at_end", frames: DataFrame | None = None) -> DataFrame:
    """Tracks with more than five positions: those alive after the last frame (of `frames`, where a clock was given to the tracker), or all."""
    last = (tracks if frames is None else frames).groupBy("video_id").agg(F.max("frame_id").alias("end"))
    t = tracks.groupBy("video_id", "track_id").agg(F.max("n_positions").alias("n_positions"), F.max("frame_id").alias("until"))
    t = t.where("n_positions > 5").join(last, "video_id")  # a row a video
    return (t.where("until = end") if which == "alive_at_end" else t).select("video_id", "track_id", "n_positions")
