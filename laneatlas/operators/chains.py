"""Whole chains of image steps in one pass over image rows (sources/frames.py): an image goes from gray bytes to the shapes on it inside one task, without
a shuffle between steps. The steps do to dense images what operators/raster.py does to sparse pixel rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from laneatlas.operators import contours, filters, raster
from laneatlas.session import ship

Element = list[tuple[int, int]]


def _moved(mask: np.ndarray, dr: int, dc: int, outside: bool) -> np.ndarray:
    """What lies dr rows down and dc columns right of each place."""
    h, w = mask.shape
    out = np.full(mask.shape, outside)
    r0, r1, c0, c1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
    if r0 < r1 and c0 < c1:
        out[r0:r1, c0:c1] = mask[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def dilated(mask: np.ndarray, element: Element) -> np.ndarray:
    """Places whose element covers a set pixel; a rectangle as a column and a row of it."""
    for part in raster._sides(element) or [element]:
        out = np.zeros_like(mask)
        for r, c in part:
            out |= _moved(mask, r, c, False)
        mask = out
    return mask


def eroded(mask: np.ndarray, element: Element) -> np.ndarray:
    """Places whose element covers only set pixels; cells beyond the border do not count."""
    return ~dilated(~mask, element)


def opened(mask: np.ndarray, element: Element) -> np.ndarray:
    return dilated(eroded(mask, element), raster._flip(element))


def closed(mask: np.ndarray, element: Element) -> np.ndarray:
    return eroded(dilated(mask, element), raster._flip(element))


def line_mask(gray: np.ndarray, threshold: int) -> np.ndarray:
    """raster.line_mask() of a dense image."""
    tiny, mask = raster.rectangle(2, 2), gray > threshold + 20
    for step, element in ((eroded, tiny), (eroded, tiny), (dilated, raster._flip(tiny)), (dilated, raster._flip(tiny))):
        mask = step(mask, element)
    lines = opened(mask, raster.rectangle(7, 1)) | opened(mask, raster.rectangle(1, 7))
    return closed(lines, raster.rectangle(3, 3))


def extracted(gray: np.ndarray, threshold: int = 200) -> np.ndarray:
    """Equalised, smoothed over 5, bilateral over 9, then line_mask()."""
    level = filters.equalized(gray)
    soft = np.floor(filters.smoothed(level, 5) + 0.5)
    return line_mask(filters.bilateral(soft), threshold)


def cleaned(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """Opened, then closed by a square."""
    box = raster.rectangle(size, size)
    return closed(opened(mask, box), box)


def bright(gray: np.ndarray, threshold: int = 200) -> np.ndarray:
    """The mask behind pseudo masks: bright pixels, cleaned."""
    return cleaned(gray > threshold)


def detected(gray: np.ndarray, threshold: int = 200, size: int = 11, c: float = -30) -> np.ndarray:
    """The mask of the classical detector: after equalising, what stands out of its neighbourhood or is bright, cleaned."""
    level = filters.equalized(gray)
    return cleaned((filters.adaptive_threshold(level, size, c) > 0) | (level > threshold))


def moving(mask: np.ndarray) -> np.ndarray:
    """A foreground mask opened by an ellipse of 5 and closed by one of 7."""
    return closed(opened(mask, raster.ellipse(5)), raster.ellipse(7))


#: Columns of a shape of an image.
FOUND = f"video_id string, frame_idx long, height int, width int, {contours._SHAPE}"
_NAMES = ["video_id", "frame_idx", "height", "width", "part", "n_pixels", "ring", "x", "y", "w", "h", "hull_area", "long", "short", "parts"]


def _images(batch: pa.RecordBatch) -> Iterator[tuple]:
    for video, k, high, wide, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield video, k, np.frombuffer(data, np.uint8).reshape(high, wide)


def shapes(images: DataFrame, chain: Callable[..., np.ndarray], external: bool = True, **how) -> DataFrame:
    """The outermost shapes on the masks that a chain makes of images (frames.SCHEMA): video_id, frame_idx, height, width and the columns of
    contours.contours(). One pass without a shuffle; a task holds one image and the shapes of a batch. A null image has none."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for video, k, gray in _images(batch):
                yield [(video, k, *gray.shape, *s) for s in contours.shapes_of(chain(gray, **how), external)]

    rows = images.where("image is not null").select("video_id", "frame_idx", "height", "width", "image")
    return contours.measured(rows.mapInArrow(lambda b: _batches(run(b)), FOUND))


def _batches(parts: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    for rows in parts:
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_POINT = lambda t: pa.list_(pa.struct([("x", t), ("y", t)]))
_TYPES = [pa.string(), pa.int64(), *[pa.int32()] * 4, _POINT(pa.int32()), *[pa.int32()] * 4, *[pa.float64()] * 3, pa.list_(_POINT(pa.float64()))]


def masks(images: DataFrame, chain: Callable[..., np.ndarray], **how) -> DataFrame:
    """video_id, frame_idx, r, c of the set pixels of the chain's masks, in the same single pass."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, k, gray in _images(batch):
                r, c = np.nonzero(chain(gray, **how))
                yield pa.RecordBatch.from_arrays([pa.array([video] * len(r), pa.string()), pa.array(np.full(len(r), k, np.int64)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))], names=["video_id", "frame_idx", "r", "c"])

    return images.where("image is not null").select("video_id", "frame_idx", "height", "width", "image").mapInArrow(run, filters.MOVING)


def _foreground(batches: Iterator[pa.RecordBatch], history: int, near: float) -> Iterator[tuple]:
    """(video, frame, mask of what moves) of frames in order; the background model of a video is the task's state."""
    now, model = None, None
    for batch in batches:
        for video, k, gray in _images(batch):
            if video != now or model is None:
                now, model = video, filters.Background(gray.shape, history, near)
            yield video, k, moving(model.apply(gray) > 200)


def _ordered(frames: DataFrame) -> DataFrame:
    return filters.in_frame_order(frames.where("image is not null").select("video_id", "frame_idx", "height", "width", "image"), "video_id", "frame_idx")


def moving_shapes(frames: DataFrame, history: int = 500, near: float = 50) -> DataFrame:
    """The outermost shapes of what moves in footage: background model, moving(), shapes, frame by frame, with one shuffle, by video."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches([(video, k, *mask.shape, *s) for s in contours.shapes_of(mask, True)] for video, k, mask in _foreground(batches, history, near))

    return contours.measured(_ordered(frames).mapInArrow(run, FOUND))


def moving_pixels(frames: DataFrame, history: int = 500, near: float = 16) -> DataFrame:
    """video_id, frame_idx, r, c of what moves in footage, opened and closed, in the same pass as the background model."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video, k, mask in _foreground(batches, history, near):
            r, c = np.nonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array([video] * len(r), pa.string()), pa.array(np.full(len(r), k, np.int64)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))], names=["video_id", "frame_idx", "r", "c"])

    return _ordered(frames).mapInArrow(run, filters.MOVING)
