"""Stencils over pixel rows (image key, r, c, v), sparse where that is smaller; every operation keeps images apart.

Repartition by the image key once and chained operations need no further shuffle, as they all group by it first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneatlas.functions import pixels as pixel
from laneatlas.operators.heatmap import constant_table, kernel_table


def rectangle(high: int, wide: int) -> list[tuple[int, int]]:
    """Offsets (dr, dc) of a rectangular element; of even sides the anchor is the later of the two middle cells."""
    return [(r - high // 2, c - wide // 2) for r in range(high) for c in range(wide)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of a filled ellipse in a size x size box."""
    half = size // 2
    out = []
    for r in range(size):
        dr = r - half
        reach = round(half * (1 - dr * dr / (half * half)) ** 0.5) if half else 0
        out += [(dr, dc) for dc in range(-reach, reach + 1)]
    return out


def _inside(high: int, wide: int) -> Column:
    return F.col("r").between(0, high - 1) & F.col("c").between(0, wide - 1)


def _spread(mask: DataFrame, key: str, element: list[tuple[int, int]], high: int, wide: int) -> DataFrame:
    """Each set pixel at every place whose element covers it."""
    o = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in element])).alias("o")
    return mask.select(key, F.col("r").alias("sr"), F.col("c").alias("sc"), o).select(key, (F.col("sr") - F.col("o.r")).alias("r"), (F.col("sc") - F.col("o.c")).alias("c")).where(_inside(high, wide))


def _sides(element) -> list | None:
    """A rectangular element as a column and a row of it, which have the same effect one after the other."""
    rows, cols = sorted({r for r, _ in element}), sorted({c for _, c in element})
    if len(rows) > 1 and len(cols) > 1 and len(element) == len(rows) * len(cols):
        return [[(r, 0) for r in rows], [(0, c) for c in cols]]


def dilate(mask: DataFrame, key: str, element, high: int, wide: int) -> DataFrame:
    """Places whose element covers a set pixel; mask: key, r, c of set pixels. A rectangle costs the sum of its sides, not their product."""
    for side in _sides(element) or []:
        mask = dilate(mask, key, side, high, wide)
    if _sides(element):
        return mask
    return _spread(mask, key, element, high, wide).distinct()


def erode(mask: DataFrame, key: str, element, high: int, wide: int) -> DataFrame:
    """Places whose element covers only set pixels; cells beyond the border do not count."""
    for side in _sides(element) or []:
        mask = erode(mask, key, side, high, wide)
    if _sides(element):
        return mask
    need = sum([_in(F.col("r") + r, high) * _in(F.col("c") + c, wide) for r, c in element], F.lit(0))
    return _spread(mask, key, element, high, wide).groupBy(key, "r", "c").agg(F.count("*").alias("n")).where(F.col("n") == need).select(key, "r", "c")


def _in(v: Column, n: int) -> Column:
    return v.between(0, n - 1).cast("int")


def opened(mask: DataFrame, key: str, element, high: int, wide: int) -> DataFrame:
    return dilate(erode(mask, key, element, high, wide), key, _flip(element), high, wide)


def closed(mask: DataFrame, key: str, element, high: int, wide: int) -> DataFrame:
    return erode(dilate(mask, key, element, high, wide), key, _flip(element), high, wide)


def _flip(element):
    return [(-r, -c) for r, c in element]


def lines_kept(mask: DataFrame, key: str, high: int, wide: int) -> DataFrame:
    """Opening by a 7-pixel column and by a 7-pixel row; what either keeps."""
    return opened(mask, key, rectangle(7, 1), high, wide).union(opened(mask, key, rectangle(1, 7), high, wide)).distinct()


def line_mask(gray: DataFrame, key: str, threshold: int, high: int, wide: int, value: str = "gray") -> DataFrame:
    """Set pixels of line-like bright markings: brighter than threshold + 20, opened twice over by 2 x 2 (two erosions, then two dilations),
    then only what a 7-pixel row or column keeps; no edges are looked for, so the combined mask is this one closed by 3 x 3."""
    mask = gray.where(F.col(value) > threshold + 20).select(key, "r", "c")
    return closed(lines_kept(denoised(mask, key, high, wide), key, high, wide), key, rectangle(3, 3), high, wide)


def denoised(mask: DataFrame, key: str, high: int, wide: int, times: int = 2) -> DataFrame:
    """Opening by 2 x 2 with `times` erosions before as many dilations."""
    tiny = rectangle(2, 2)
    for _ in range(times):
        mask = erode(mask, key, tiny, high, wide)
    for _ in range(times):
        mask = dilate(mask, key, _flip(tiny), high, wide)
    return mask


def near(points: DataFrame, mask: DataFrame, key: str, size: int, high: int, wide: int) -> DataFrame:
    """points whose pixel lies in the mask dilated by a size x size square."""
    return points.join(dilate(mask, key, rectangle(size, size), high, wide), [key, "r", "c"], "left_semi")


def blurred(pixels: DataFrame, key: str, size: int, high: int, wide: int, value: str = "v") -> DataFrame:
    """Separable Gaussian of dense images: two joins with kernel tables of a row for each cell and tap (broadcast)."""
    spark = pixels.sparkSession
    across, down = kernel_table(spark, wide, size), kernel_table(spark, high, size)
    out = pixels.join(across, F.col("c") == F.col("_s")).groupBy(key, "r", F.col("_t").alias("c")).agg(F.sum(F.col(value) * F.col("_k")).alias(value))
    return out.join(down, F.col("r") == F.col("_s")).groupBy(key, F.col("_t").alias("r"), "c").agg(F.sum(F.col(value) * F.col("_k")).alias(value))


def area_resampled(pixels: DataFrame, key: str, high: int, wide: int, grid: int, value: str = "v") -> DataFrame:
    """Mean of each block of a grid x grid tiling, weighted by overlap where the grid does not divide the image: key, gy, gx, v."""
    spark = pixels.sparkSession

    def shares(n: int) -> DataFrame:
        rows = []
        for p in range(n):
            for g in range(int(p * grid / n), min(grid, int(-(-(p + 1) * grid // n)))):
                w = min((g + 1) * n / grid, p + 1) - max(g * n / grid, p)
                if w > 1e-12:
                    rows.append((p, g, w * grid / n))
        return F.broadcast(constant_table(spark, rows, p=pa.int32(), g=pa.int32(), w=pa.float64()))

    out = pixels.join(shares(high).select(F.col("p").alias("r"), F.col("g").alias("gy"), F.col("w").alias("wy")), "r")
    out = out.join(shares(wide).select(F.col("p").alias("c"), F.col("g").alias("gx"), F.col("w").alias("wx")), "c")
    return out.groupBy(key, "gy", "gx").agg(F.sum(F.col(value) * F.col("wy") * F.col("wx")).alias("v"))


#: Thresholds of the smaller and of the larger augmentation.
FEW_THRESHOLDS, MANY_THRESHOLDS = (150, 180, 200), (170, 180, 190, 200, 210, 220, 230)


def variants(pixels: DataFrame, size: int, names: tuple[str, ...] = ("same", "mirrored", "flipped", "quarter", "half")) -> DataFrame:
    """Turns of square images (column variant): same, mirrored, flipped (upside down), quarter (to the left), clockwise, half."""
    r, c, top = F.col("r"), F.col("c"), F.lit(size - 1)
    turns = {"same": (r, c), "mirrored": (r, top - c), "flipped": (top - r, c), "quarter": (top - c, r), "clockwise": (c, top - r), "half": (top - r, top - c)}
    turns = {n: turns[n] for n in names}
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), y.alias("r"), x.alias("c")) for n, (y, x) in turns.items()])).alias("t")
    rest = [x for x in pixels.columns if x not in ("r", "c")]
    return pixels.select(*rest, v).select(*rest, "t.variant", "t.r", "t.c")


def augmented(images: DataFrame, size: int, value: str = "gray") -> DataFrame:
    """Eight variants (six turns, two gammas) of square gray images at seven thresholds: set pixels with variant and t."""
    turned = variants(images, size, ("same", "flipped", "mirrored", "clockwise", "quarter", "half"))
    lit = [images.withColumn("variant", F.lit(f"gamma_{g}")).withColumn(value, pixel.gamma(F.col(value), g)) for g in (0.8, 1.2)]
    all_ = turned.unionByName(lit[0]).unionByName(lit[1])
    return all_.withColumn("t", F.explode(F.array(*[F.lit(t) for t in MANY_THRESHOLDS]))).where(F.col(value) > F.col("t"))


def accumulated(frames: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Sum over frames of cells gy, gx, v divided by the number of frames (n, one row, broadcast); absent cells count as 0."""
    return frames.groupBy("gy", "gx").agg(F.sum("v").alias("v")).crossJoin(F.broadcast(n_frames)).select("gy", "gx", (F.col("v") / F.col("n")).alias("v"))


def stitched(tiles: DataFrame) -> DataFrame:
    """tiles (id, px, py, r, c, v) to pixels of the stitched image; missing tiles are simply absent (black)."""
    return tiles.select("id", (F.col("py") + F.col("r")).alias("r"), (F.col("px") + F.col("c")).alias("c"), "v")
