"""From grids to heatmaps: normalising, smoothing, placing and summing up."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneatlas.functions import geo


def gaussian(size: int, sigma: float | None = None) -> list[float]:
    """A normalised kernel; sigma from the size, 0.3((k-1)/2 - 1) + 0.8, unless given (an assumption, as is the border below)."""
    s = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = [math.exp(-((i - size // 2) ** 2) / (2 * s * s)) for i in range(size)]
    return [x / sum(k) for x in k]


def mirrored(i: int, n: int) -> int:
    """Index beyond the border reflected about the border's own cell."""
    while i < 0 or i >= n:
        i = -i if i < 0 else 2 * (n - 1) - i
        if n == 1:
            return 0
    return i


def kernel_rows(grid: int, size: int) -> list[tuple[int, int, float]]:
    """(source, target, weight) of a one-dimensional smoothing of `grid` cells."""
    acc: dict[tuple[int, int], float] = {}
    for t in range(grid):
        for k, w in enumerate(gaussian(size)):
            s = mirrored(t + k - size // 2, grid)
            acc[s, t] = acc.get((s, t), 0.0) + w
    return [(s, t, w) for (s, t), w in sorted(acc.items())]


def constant_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A small table of fixed values, handed to the JVM as one Arrow batch."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(columns.items(), cols, strict=True)}))


def kernel_table(spark: SparkSession, grid: int, size: int) -> DataFrame:
    return F.broadcast(constant_table(spark, kernel_rows(grid, size), _s=pa.int32(), _t=pa.int32(), _k=pa.float64()))


def by_maximum(cells: DataFrame, value: str = "v") -> DataFrame:
    """Values over their maximum; all zero stay zero. Cells are grid x grid rows at most, so one task holds them and the
    counts behind them are made once."""
    top = F.max(value).over(Window.partitionBy())
    return cells.withColumn("_top", top).withColumn(value, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.lit(0.0))).drop("_top")


def smooth(cells: DataFrame, grid: int, size: int = 11, value: str = "v") -> DataFrame:
    """Separable Gaussian smoothing of sparse cells gy, gx, v: two joins with a kernel table of grid x size rows (broadcast)."""
    spark: SparkSession = cells.sparkSession
    k = kernel_table(spark, grid, size)
    out = cells.join(k, F.col("gx") == F.col("_s")).groupBy("gy", F.col("_t").alias("gx")).agg(F.sum(F.col(value) * F.col("_k")).alias(value))
    return out.join(k, F.col("gy") == F.col("_s")).groupBy(F.col("_t").alias("gy"), "gx").agg(F.sum(F.col(value) * F.col("_k")).alias(value))


def heatmap(counts: DataFrame, grid: int, blur: int = 11) -> DataFrame:
    """Counts n of cells as intensities v: over the maximum, smoothed, over the maximum again."""
    v = by_maximum(counts.select("gy", "gx", F.col("n").cast("double").alias("v")))
    return by_maximum(smooth(v, grid, blur)) if blur else v


def points(cells: DataFrame, grid: int, bounds: Column, least: float = 0.01) -> DataFrame:
    """lat, lon (cell centres, 6 digits) and intensity (4 digits) of cells of at least `least`."""
    g = geo.cell_to_geo(F.col("gy"), F.col("gx"), grid, bounds)
    return cells.where(F.col("v") >= least).select(F.round(g["lat"], 6).alias("lat"), F.round(g["lon"], 6).alias("lon"), F.round("v", 4).alias("intensity"))


def statistics(cells: DataFrame, least: float = 0.01) -> DataFrame:
    """Maximum, minimum and mean of positive cells (0 if none), and how many reach `least`."""
    on = F.when(F.col("v") > 0, F.col("v"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cells.agg(zero(F.max("v")).alias("max_intensity"), zero(F.min(on)).alias("min_intensity"), zero(F.avg(on)).alias("mean_intensity"), F.count_if(F.col("v") >= least).alias("total_points"))


def document(cells: DataFrame, grid: int, bounds: Column, least: float = 0.01) -> DataFrame:
    """One row: bounds, grid_size, points, statistics. The points are at most grid x grid."""
    listed = points(cells, grid, bounds, least).agg(F.collect_list(F.struct("lat", "lon", "intensity")).alias("points"))
    return listed.crossJoin(F.broadcast(statistics(cells, least).select(F.struct("*").alias("statistics")))).select(bounds.alias("bounds"), F.lit(grid).alias("grid_size"), "points", "statistics")


#: Centres (x, y) of the invented clusters, and the statistics stated with them.
DEMO_CENTRES = ((0.3, 0.5), (0.5, 0.5), (0.7, 0.5), (0.5, 0.3), (0.5, 0.7))
DEMO_STATISTICS = {"max_intensity": 1.0, "min_intensity": 0.3, "mean_intensity": 0.65}


def demo_document(spark: SparkSession, bounds: tuple[float, float, float, float], grid: int = 50) -> DataFrame:
    """One heatmap document of invented points; its statistics are stated, not measured."""
    one = spark.range(1).select(geo.bounds_literal(*bounds).alias("bounds"))
    return demo_documents(one, grid)


def demo_documents(areas: DataFrame, grid: int = 50, n: int = 200, seed: int = 42) -> DataFrame:
    """areas (with a struct bounds) with grid_size, points and statistics of a document of n invented points each; the points differ from row to row."""
    unit = lambda i: F.abs(F.hash(F.lit(seed), *[c for c in areas.columns if c != "bounds"], "bounds", i)) % 2_000_003
    share = lambda i, k: unit(i * 8 + k) / 2_000_003.0
    hold = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    # two uniform numbers give a normal one
    jitter = lambda i, k: 0.1 * F.sqrt(-2 * F.log(1 - share(i, k))) * F.cos(2 * F.pi() * share(i, k + 1))
    centres = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in DEMO_CENTRES])

    def point(i: Column) -> Column:
        c = F.get(centres, F.floor(share(i, 5) * 5).cast("int"))
        x, y = hold(c["x"] + jitter(i, 0)), hold(c["y"] + jitter(i, 2))
        b = F.col("bounds")
        lat, lon = b["min_lat"] + y * (b["max_lat"] - b["min_lat"]), b["min_lon"] + x * (b["max_lon"] - b["min_lon"])
        return F.struct(lat.alias("lat"), lon.alias("lon"), F.round(0.3 + 0.7 * share(i, 4), 4).alias("intensity"))

    listed = areas.withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))
    stated = F.struct(*[F.lit(v).alias(k) for k, v in DEMO_STATISTICS.items()], F.size("points").cast("long").alias("total_points"), F.lit(0).alias("frames_processed"))
    return listed.withColumn("grid_size", F.lit(grid)).withColumn("statistics", stated)
