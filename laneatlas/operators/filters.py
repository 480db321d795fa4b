"""Filters of whole gray images that have no relational form: NumPy kernels, one image a group."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.operators.heatmap import constant_table, gaussian, mirrored
from laneatlas.session import ship


def _pad(image: np.ndarray, by: int) -> np.ndarray:
    h, w = image.shape
    return image[np.ix_([mirrored(i, h) for i in range(-by, h + by)], [mirrored(i, w) for i in range(-by, w + by)])]


def smoothed(image: np.ndarray, size: int) -> np.ndarray:
    k, half = np.array(gaussian(size)), size // 2
    p = _pad(image.astype(float), half)
    h, w = image.shape
    rows = sum(k[i] * p[i : i + h] for i in range(size))
    return sum(k[i] * rows[:, i : i + w] for i in range(size))


def adaptive_threshold(image: np.ndarray, size: int = 11, c: float = -30) -> np.ndarray:
    """255 where a pixel exceeds its Gaussian neighbourhood mean less c."""
    return np.where(image > np.round(smoothed(image, size)) - c, 255, 0)


def bilateral(image: np.ndarray, size: int = 9, sigma_value: float = 75, sigma_space: float = 75) -> np.ndarray:
    """Mean of a round neighbourhood, weighted by nearness in place and in value (whole numbers from 0 to 255: their weights are a table)."""
    half, img = size // 2, np.rint(image).astype(np.int16)
    p, (h, w) = _pad(img, half), image.shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    alike = np.exp(-(np.arange(256.0) ** 2) / (2 * sigma_value**2))
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            if dy * dy + dx * dx > half * half:
                continue
            v = p[half + dy : half + dy + h, half + dx : half + dx + w]
            g = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2)) * alike[np.abs(v - img)]
            total += g * v
            weight += g
    return np.rint(total / weight)


def equalized(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms of a tiles x tiles grid, their maps blended between tile centres."""
    h, w = image.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.arange(h) * ty // h, np.arange(w) * tx // w
    maps = np.zeros((ty, tx, 256))
    for a in range(ty):
        for b in range(tx):
            part = image[np.ix_(ys == a, xs == b)].astype(int)
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            over = np.maximum(n - limit, 0).sum()
            maps[a, b] = np.cumsum(np.minimum(n, limit) + over / 256) * 255 / part.size
    fy, fx = np.clip((np.arange(h) + 0.5) * ty / h - 0.5, 0, ty - 1), np.clip((np.arange(w) + 0.5) * tx / w - 0.5, 0, tx - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    v = image.astype(int)
    at = lambda y, x: maps[y[:, None], x[None, :], v]
    out = (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x1)) + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))
    return np.clip(np.rint(out), 0, 255)


def bilinear(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Resized with pixel centres aligned."""
    h, w = image.shape
    fy, fx = np.clip((np.arange(high) + 0.5) * h / high - 0.5, 0, h - 1), np.clip((np.arange(wide) + 0.5) * w / wide - 0.5, 0, w - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    wy, wx, img = (fy - y0)[:, None], (fx - x0)[None, :], image.astype(float)
    return (1 - wy) * ((1 - wx) * img[np.ix_(y0, x0)] + wx * img[np.ix_(y0, x1)]) + wy * ((1 - wx) * img[np.ix_(y1, x0)] + wx * img[np.ix_(y1, x1)])


class Background:
    """A mixture of up to `modes` Gaussians for each pixel, updated frame by frame at the rate 1/min(frames, history).

    A pixel is foreground (255) if none of the modes that make up the first `share` of the weight is within `near` squared deviations;
    shadow (127) if it is a darker copy of such a mode, down to half its brightness.
    """

    def __init__(self, shape: tuple[int, int], history: int = 500, near: float = 16, modes: int = 5, share: float = 0.9) -> None:
        self.history, self.near, self.modes, self.share, self.n = history, near, modes, share, 0
        self.w = np.zeros((modes, *shape))
        self.m = np.zeros((modes, *shape))
        self.v = np.full((modes, *shape), 15.0)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, w=self.w, m=self.m, v=self.v, how=np.array([self.history, self.near, self.modes, self.share, self.n]))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Background:
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            history, near, modes, share, n = f["how"].tolist()
            made = cls(f["w"].shape[1:], int(history), near, int(modes), share)
            made.n, made.w, made.m, made.v = int(n), f["w"], f["m"], f["v"]
        return made

    def apply(self, image: np.ndarray) -> np.ndarray:
        x = image.astype(float)
        self.n += 1
        rate = 1 / min(self.n, self.history)
        close = (self.w > 0) & ((x - self.m) ** 2 < 9 * self.v)
        first = np.where(close.any(axis=0), close.argmax(axis=0), -1)
        before = np.cumsum(self.w, axis=0) - self.w
        base = (self.w > 0) & (before < self.share)
        back = (base & ((x - self.m) ** 2 < self.near * self.v)).any(axis=0)
        ratio = np.divide(x, self.m, out=np.zeros_like(self.m), where=self.m > 0)
        shadow = (base & (ratio >= 0.5) & (ratio < 1)).any(axis=0) & ~back
        own = np.arange(self.modes)[:, None, None] == first
        self.w = (1 - rate) * self.w + rate * own
        d = x - self.m
        step = np.where(own, rate / np.maximum(self.w, 1e-9), 0)
        self.m += step * d
        self.v = np.clip(self.v + step * (d * d - self.v), 4, 75)
        new = first < 0
        self.w[-1] = np.where(new, rate, self.w[-1])
        self.m[-1] = np.where(new, x, self.m[-1])
        self.v[-1] = np.where(new, 15.0, self.v[-1])
        self.w /= np.maximum(self.w.sum(axis=0), 1e-9)
        order = np.argsort(-self.w, axis=0, kind="stable")
        self.w, self.m, self.v = (np.take_along_axis(a, order, axis=0) for a in (self.w, self.m, self.v))
        return np.where(back, 0, np.where(shadow, 127, 255)) if self.n > 1 else np.zeros(image.shape, int)


def _across(image: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Correlation with a column of weights, then with a row of them; the border pixels go on outside."""
    half, (h, w) = len(down) // 2, image.shape
    p = np.pad(image, half, mode="edge")
    rows = sum(k * p[i : i + h] for i, k in enumerate(down))
    return sum(k * rows[:, i : i + w] for i, k in enumerate(right))


def expansion(image: np.ndarray, reach: int = 5, sigma: float = 1.2) -> np.ndarray:
    """Of each pixel's neighbourhood the quadratic c + bx x + by y + axx x^2 + ayy y^2 + axy x y of least squares under Gaussian weights: bx, by, axx, ayy, axy.

    The weights are separable, so are the six sums that the fit takes, and its matrix is the same everywhere."""
    x = np.arange(-reach, reach + 1.0)
    g = np.exp(-x * x / (2 * sigma * sigma))
    g /= g.sum()
    two, four = (g * x**2).sum(), (g * x**4).sum()
    s = {(i, j): _across(image, g * x**j, g * x**i) for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))}
    spread = four - two * two
    return np.stack([s[1, 0] / two, s[0, 1] / two, (s[2, 0] - two * s[0, 0]) / spread, (s[0, 2] - two * s[0, 0]) / spread, s[1, 1] / (two * two)])


def _sampled(layers: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Layers at places between pixels, bilinearly; places outside take the border's values."""
    h, w = layers.shape[1:]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    a, b = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    c, d, v, u = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1), y - a, x - b
    return (1 - v) * ((1 - u) * layers[:, a, b] + u * layers[:, a, d]) + v * ((1 - u) * layers[:, c, b] + u * layers[:, c, d])


def flow(a: np.ndarray, b: np.ndarray, window: int = 15, levels: int = 3, iterations: int = 3, reach: int = 5, sigma: float = 1.2, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy) of each pixel from image a to b by polynomial expansion, from coarse to fine.

    A neighbourhood that moves by d keeps its quadratic form A and changes its slope by -2 A d. At each of `levels` halvings of the images (none has
    a side under `least`) the slopes of both at places that the flow so far connects give A d, and d is the least-squares solution over a
    window x window mean, `iterations` times over. Places that the flow takes outside the image do not count.
    """
    a, b = a.astype(float), b.astype(float)
    pyramid = [(a, b)]
    half = np.exp(-np.arange(-2, 3.0) ** 2 / 0.5)
    half /= half.sum()
    while len(pyramid) < levels and min(pyramid[-1][0].shape) >= 2 * least:
        h, w = pyramid[-1][0].shape
        pyramid.append(tuple(bilinear(_across(v, half, half), (h + 1) // 2, (w + 1) // 2) for v in pyramid[-1]))
    d = np.zeros((2, *pyramid[-1][0].shape))
    box = np.full(window, 1 / window)
    for one, other in reversed(pyramid):
        h, w = one.shape
        if d.shape[1:] != (h, w):
            grown = (w / d.shape[2], h / d.shape[1])
            d = np.stack([bilinear(v, h, w) * k for v, k in zip(d, grown, strict=True)])
        r1, r2 = expansion(one, reach, sigma), expansion(other, reach, sigma)
        y, x = np.mgrid[0:h, 0:w].astype(float)
        for _ in range(iterations):
            at = (y + d[1], x + d[0])
            inside = ((at[0] >= 0) & (at[0] <= h - 1) & (at[1] >= 0) & (at[1] <= w - 1)).astype(float)
            moved = _sampled(r2, *at)
            xx, yy, xy = (r1[2] + moved[2]) / 2, (r1[3] + moved[3]) / 2, (r1[4] + moved[4]) / 4
            bx = (r1[0] - moved[0]) / 2 + xx * d[0] + xy * d[1]
            by = (r1[1] - moved[1]) / 2 + xy * d[0] + yy * d[1]
            mean = lambda v: _across(v * inside, box, box)  # noqa: B023, E731
            g, k, q, u, v = mean(xx * xx + xy * xy), mean(xy * (xx + yy)), mean(xy * xy + yy * yy), mean(xx * bx + xy * by), mean(xy * bx + yy * by)
            det = g * q - k * k + 1e-3
            d = np.stack([(q * u - k * v) / det, (g * v - k * u) / det])
    return d[0], d[1]


_KERNELS = {"adaptive_threshold": adaptive_threshold, "bilateral": bilateral, "equalized": equalized}


def _dense(pdf: pd.DataFrame, high: int, wide: int, value: str) -> np.ndarray:
    image = np.zeros((high, wide))
    image[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = pdf[value].to_numpy()
    return image


def filtered(pixels: DataFrame, key: str, kernel: str, high: int, wide: int, value: str = "gray", **how) -> DataFrame:
    """key, r, c, v of images under one of the kernels adaptive_threshold, bilateral, equalized."""
    ship(pixels.sparkSession)
    apply = _KERNELS[kernel]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = apply(_dense(pdf, high, wide, value), **how)
        r, c = np.indices(out.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "r": r.ravel(), "c": c.ravel(), "v": out.ravel().astype(int)})

    return pixels.groupBy(key).applyInPandas(run, f"{key} {dict(pixels.dtypes)[key]}, r int, c int, v int")


def in_frame_order(rows: DataFrame, video: str, frame: str, *ties: str) -> DataFrame:
    """Each video's rows in one partition, by frame: a kernel then steps over Arrow batches with its state in hand, never a whole video."""
    return rows.repartition(F.col(video)).sortWithinPartitions(video, frame, *ties)


def foreground(frames: DataFrame, history: int = 500, near: float = 16) -> DataFrame:
    """video_id, frame_idx, r, c of moving pixels (shadows left out) of frames (see sources/frames.py), by a background model that runs through
    each video in frame order. Sequential within a video; videos run side by side; a task holds one model and one batch of frames."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, None
        for batch in batches:
            for video, k, high, wide, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if video != now:
                    now, model = video, Background((high, wide), history, near)
                r, c = np.nonzero(model.apply(np.frombuffer(data, np.uint8).reshape(high, wide)) > 200)
                yield pa.RecordBatch.from_arrays([pa.array([video] * len(r), pa.string()), pa.array(np.full(len(r), k, np.int64)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))], names=["video_id", "frame_idx", "r", "c"])

    rows = in_frame_order(frames.select("video_id", "frame_idx", "height", "width", "image"), "video_id", "frame_idx")
    return rows.mapInArrow(run, MOVING)


MOVING = "video_id string, frame_idx long, r int, c int"


def foreground_stream(frames: DataFrame, history: int = 500, near: float = 16) -> DataFrame:
    """As foreground(), over a stream whose frames arrive in order; each video's model is state in the query's checkpoint."""
    ship(frames.sparkSession)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.frame_idx)
        model = Background.load(state.get[0]) if state.exists else None
        out = []
        for f in rows:
            model = model or Background((f.height, f.width), history, near)
            r, c = np.nonzero(model.apply(np.frombuffer(f.image, np.uint8).reshape(f.height, f.width)) > 200)
            out.append(pd.DataFrame({"video_id": key[0], "frame_idx": f.frame_idx, "r": r, "c": c}))
        state.update((model.dump(),))
        yield pd.concat(out)

    rows = frames.select("video_id", "frame_idx", "height", "width", "image")
    return rows.groupBy("video_id").applyInPandasWithState(run, MOVING, "model binary", "append", "NoTimeout")


def flow_between(frames: DataFrame, window: int = 15, scale: float = 10) -> DataFrame:
    """video_id, frame_idx, r, c, dx, dy, magnitude (times scale, held within 255) from each frame to the next of its video, by flow()."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            for video, k, high, wide, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(high, wide)
                if video == now:
                    dx, dy = (v.ravel() for v in flow(last, image, window))
                    r, c = (v.ravel() for v in np.indices((high, wide), np.int32))
                    size = np.minimum(255, np.hypot(dx, dy) * scale)
                    yield pa.RecordBatch.from_arrays([pa.array([video] * r.size), pa.array(np.full(r.size, k, np.int64)), *map(pa.array, (r, c, dx, dy, size))], names=["video_id", "frame_idx", "r", "c", "dx", "dy", "magnitude"])
                now, last = video, image

    rows = in_frame_order(frames.select("video_id", "frame_idx", "height", "width", "image"), "video_id", "frame_idx")
    return rows.mapInArrow(run, "video_id string, frame_idx long, r int, c int, dx double, dy double, magnitude double")


def resized(pixels: DataFrame, key: str, high: int, wide: int, new_high: int, new_wide: int, value: str = "gray") -> DataFrame:
    """key, r, c, v: images resized bilinearly, pixel centres aligned; two joins with tables of two weights a line (broadcast)."""
    spark = pixels.sparkSession

    def weights(n: int, m: int) -> DataFrame:
        rows = []
        for t in range(m):
            at = min(n - 1.0, max(0.0, (t + 0.5) * n / m - 0.5))
            low = int(at)
            rows += [(low, t, 1 - (at - low))] + ([(low + 1, t, at - low)] if at > low else [])
        return F.broadcast(constant_table(spark, rows, _s=pa.int32(), _t=pa.int32(), _k=pa.float64()))

    out = pixels.join(weights(wide, new_wide), F.col("c") == F.col("_s")).groupBy(key, "r", F.col("_t").alias("c")).agg(F.sum(F.col(value) * F.col("_k")).alias("v"))
    return out.join(weights(high, new_high), F.col("r") == F.col("_s")).groupBy(key, F.col("_t").alias("r"), "c").agg(F.sum(F.col("v") * F.col("_k")).alias("v"))
