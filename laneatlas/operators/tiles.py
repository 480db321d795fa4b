"""Areas of map tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.functions import geo
from laneatlas.sources.locations import MAX_ZOOM

TILE = 256


def tile_range(areas: DataFrame, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """areas (id, bounds, zoom) with zoom clamped and min_x, max_x, min_y, max_y of the tiles of their corners, ordered."""
    z = F.least("zoom", F.lit(max_zoom))
    out = areas.withColumn("zoom", z)
    xs = [geo.tile_x(F.col(f"bounds.{s}_lon"), F.col("zoom")) for s in ("min", "max")]
    ys = [geo.tile_y(F.col(f"bounds.{s}_lat"), F.col("zoom")) for s in ("max", "min")]
    return out.select("*", F.least(*xs).alias("min_x"), F.greatest(*xs).alias("max_x"), F.least(*ys).alias("min_y"), F.greatest(*ys).alias("max_y"))


def area_tiles(areas: DataFrame) -> DataFrame:
    """One row a tile, row by row: id, zoom, seq (from 0), x, y and the pixel offset px, py in the stitched image."""
    r = tile_range(areas)
    rows = r.select("id", "zoom", "min_x", "max_x", "min_y", F.explode(F.sequence("min_y", "max_y")).alias("y"))
    cells = rows.select("*", F.explode(F.sequence("min_x", "max_x")).alias("x"))
    seq = (F.col("y") - F.col("min_y")) * (F.col("max_x") - F.col("min_x") + 1) + F.col("x") - F.col("min_x")
    return cells.select("id", "zoom", seq.alias("seq"), "x", "y", ((F.col("x") - F.col("min_x")) * TILE).alias("px"), ((F.col("y") - F.col("min_y")) * TILE).alias("py"))


def stitched_extent(areas: DataFrame) -> DataFrame:
    """Per area: tile range, size of the stitched image and the bounds it really has."""
    r = tile_range(areas)
    z = F.col("zoom")
    return r.select(
        "id", "zoom", "min_x", "max_x", "min_y", "max_y",
        ((F.col("max_x") - F.col("min_x") + 1) * TILE).alias("width"), ((F.col("max_y") - F.col("min_y") + 1) * TILE).alias("height"),
        F.struct(
            geo.tile_lat(F.col("max_y") + 1, z).alias("min_lat"), geo.tile_lat(F.col("min_y"), z).alias("max_lat"),
            geo.tile_lon(F.col("min_x"), z).alias("min_lon"), geo.tile_lon(F.col("max_x") + 1, z).alias("max_lon"),
        ).alias("actual"),
    )
