"""Polygons painted into masks, as relations: crossings of rows, spans between them, pixels of spans, the last painted class of a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pieces(shapes: DataFrame, keys: list[str], ring: str) -> DataFrame:
    """A row for each side of each ring and each pixel row y that it meets, with x where it meets it (x and xx for a level side)."""
    r = F.col(ring)
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    at = lambda p, k: p[k].cast("double")
    sides = F.zip_with(r, after, lambda a, b: F.struct(at(a, "x").alias("x0"), at(a, "y").alias("y0"), at(b, "x").alias("x1"), at(b, "y").alias("y1")))
    each = shapes.where(F.size(r) > 0).select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low).cast("int"), F.floor(high).cast("int")
    rows = each.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    level = F.col("y0") == F.col("y1")
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / F.when(level, 1.0).otherwise(F.col("y1") - F.col("y0"))
    crosses = ~level & (F.col("y") >= low) & (F.col("y") < high)
    return rows.select(*keys, "y", F.when(level, F.least("x0", "x1")).otherwise(x).alias("x"), F.when(level, F.greatest("x0", "x1")).otherwise(x).alias("xx"), crosses.alias("crosses"))


def spans(shapes: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, y, a, b: runs of the pixels inside or on rings (even-odd rule; a level side and the points of a side that lie on pixels count as well).

    Runs of one ring may overlap. One shuffle, by ring and row; no group is larger than the sides that a row meets."""
    pieces = _pieces(shapes, keys, ring)
    order = Window.partitionBy(*keys, "y").orderBy("x")
    between = pieces.where("crosses").withColumn("_n", F.row_number().over(order)).withColumn("_to", F.lead("x").over(order)).where("_n % 2 = 1")
    run = lambda df, a, b: df.select(*keys, "y", F.ceil(a - 1e-9).cast("int").alias("a"), F.floor(b + 1e-9).cast("int").alias("b")).where("a <= b")
    return run(between, F.col("x"), F.col("_to")).unionByName(run(pieces, F.col("x"), F.col("xx")))


def painted(shapes: DataFrame, key: list[str], value: Column, order: str = "part", ring: str = "ring", high: str = "height", wide: str = "width") -> DataFrame:
    """key, r, c, v: pixels of an image under its rings; where several cover one, the value of the last in `order`. high, wide: columns of the image's
    size. A group is a pixel's few rings."""
    marked = shapes.withColumn("_v", value).where("_v is not null")
    s = spans(marked, [*key, order, high, wide, "_v"], ring)
    inside = s.where(F.col("y").between(F.lit(0), F.col(high) - 1)).withColumn("a", F.greatest("a", F.lit(0))).withColumn("b", F.least("b", F.col(wide) - 1)).where("a <= b")
    pixels = inside.select(*key, order, "_v", F.col("y").alias("r"), F.explode(F.sequence("a", "b")).alias("c"))
    return pixels.groupBy(*key, "r", "c").agg(F.max_by("_v", order).alias("v"))
