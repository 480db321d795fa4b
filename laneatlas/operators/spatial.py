"""Range and overlap joins as hash joins over grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.functions import boxes


def points_in_boxes(points: DataFrame, areas: DataFrame, cell: float = 10.0) -> DataFrame:
    """points (lat, lon, ...) with each area (bounds, ...) that holds them, sides included.

    A point is in one cell of `cell` degrees; an area is in all it touches. The join is on the cell; the sides are
    checked after it. Pick the cell near the size of the areas.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    p = points.withColumn("_cy", at("lat")).withColumn("_cx", at("lon"))
    a = areas.withColumn("_cy", F.explode(F.sequence(at("bounds.min_lat"), at("bounds.max_lat"))))
    a = a.withColumn("_cx", F.explode(F.sequence(at("bounds.min_lon"), at("bounds.max_lon"))))
    inside = F.col("lat").between(F.col("bounds.min_lat"), F.col("bounds.max_lat")) & F.col("lon").between(F.col("bounds.min_lon"), F.col("bounds.max_lon"))
    return p.join(a, ["_cy", "_cx"]).where(inside).drop("_cy", "_cx")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int = 64) -> DataFrame:
    """Pairs of boxes (columns a and b, structs with x, y, w, h) with equal keys that overlap, with their iou.

    A box is in each grid cell it touches and boxes meet on (keys, cell); a pair is kept only in the cell that holds the
    upper left corner of the intersection, so it comes once and no deduplication is needed.
    """

    def spread(df: DataFrame, name: str) -> DataFrame:
        lo = lambda c: F.floor(F.col(f"{name}.{c}") / cell).cast("int")
        hi = lambda c, s: F.floor((F.col(f"{name}.{c}") + F.greatest(F.col(f"{name}.{s}") - 1, F.lit(0))) / cell).cast("int")
        return df.withColumn("_cx", F.explode(F.sequence(lo("x"), hi("x", "w")))).withColumn("_cy", F.explode(F.sequence(lo("y"), hi("y", "h"))))

    pairs = spread(left, "a").join(spread(right, "b"), [*keys, "_cx", "_cy"])
    first = (F.floor(F.greatest("a.x", "b.x") / cell) == F.col("_cx")) & (F.floor(F.greatest("a.y", "b.y") / cell) == F.col("_cy"))
    return pairs.where(first).withColumn("iou", boxes.iou(F.col("a"), F.col("b"))).where("iou > 0").drop("_cx", "_cy")


def greedy_matches(pairs: DataFrame, keys: list[str], a: str, b: str, score: str) -> DataFrame:
    """Of the candidate pairs with equal keys (a frame), one to one matches: pairs are taken by falling score, then rising a, then rising b, each
    side once. A frame's pairs are one array, as each choice depends on those before; frames are matched side by side, in the JVM."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("m"), F.col(a).alias("a"), F.col(b).alias("b")))).alias("_p")
    frames = pairs.groupBy(*keys).agg(listed)
    free = lambda taken, p: ~F.exists(taken, lambda t: (t["a"] == p["a"]) | (t["b"] == p["b"]))
    taken = F.aggregate("_p", F.slice("_p", 1, 0), lambda t, p: F.when(free(t, p), F.array_append(t, p)).otherwise(t))
    return frames.select(*keys, F.explode(taken).alias("t")).select(*keys, F.col("t.a").alias(a), F.col("t.b").alias(b), (-F.col("t.m")).alias(score))
