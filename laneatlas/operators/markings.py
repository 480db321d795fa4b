"""GeoJSON of markings, counts and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneatlas.functions import geo, pixels


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at its end, unless it is there already."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def geo_ring(ring: Column, width: int, height: int, bounds: Column) -> Column:
    """array<struct<x, y>> of pixels to a closed array of [lon, lat]."""
    def place(p):
        g = geo.pixel_to_geo(p["x"], p["y"], width, height, bounds)
        return F.array(g["lon"], g["lat"])

    return closed(F.transform(ring, place))


def numbered(markings: DataFrame, collection: str, order: list[str]) -> DataFrame:
    """Feature ids from 0 without gaps in each collection."""
    return markings.withColumn("id", (F.row_number().over(Window.partitionBy(collection).orderBy(*order)) - 1).cast("int"))


def features(markings: DataFrame, width: int, height: int, bounds: Column) -> DataFrame:
    """markings (id, ring, type, confidence, area, x, y, w, h) with a GeoJSON feature struct; rings of under three points are lines."""
    ring = geo_ring(F.col("ring"), width, height, bounds)
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    line = F.struct(F.lit("LineString").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(
        F.col("type").alias("marking_type"), F.round("confidence", 3).alias("confidence"), F.round("area", 1).alias("area_pixels"),
        (F.col("x") + F.floor(F.col("w") / 2)).cast("int").alias("center_x"), (F.col("y") + F.floor(F.col("h") / 2)).cast("int").alias("center_y"),
    )
    return markings.withColumn("feature", F.struct(F.lit("Feature").alias("type"), "id", F.when(F.size("ring") >= 3, polygon).otherwise(line).alias("geometry"), properties.alias("properties")))


def count_by_type(markings: DataFrame, kind: str = "type") -> DataFrame:
    return markings.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def class_pixels(mask: DataFrame, cls: str = "cls") -> DataFrame:
    """Pixels and percent (2 digits, of all pixels) of each class but 0."""
    n = mask.groupBy(cls).agg(F.count("*").alias("pixels"))
    total = F.broadcast(n.agg(F.sum("pixels").alias("_all")))
    return n.crossJoin(total).where(F.col(cls) != 0).select(cls, "pixels", F.round(100 * F.col("pixels") / F.col("_all"), 2).alias("percentage"))


def largest(parts: DataFrame, key: str, size: str, k: int, *ties: str) -> DataFrame:
    """The k largest rows of each image."""
    w = Window.partitionBy(key).orderBy(F.desc(size), *ties)
    return parts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")


def brightness(images: DataFrame, key: str, v: str = "gray", bright: int = 180) -> DataFrame:
    """Per image: mean of bright pixels (null if none), extremes, and the share of bright pixels in percent."""
    on = F.when(F.col(v) > bright, F.col(v))
    return images.groupBy(key).agg(F.avg(on).alias("mean_bright"), F.min(v).alias("low"), F.max(v).alias("high"), (100 * F.count(on) / F.count("*")).alias("bright_percent"))


def marking_masks(rgb: DataFrame, white_from: int = 180) -> DataFrame:
    """rgb (red, green, blue) with hsv, gray, is_white (by brightness and by hue, both), is_yellow and is_road."""
    h = pixels.hsv(F.col("red"), F.col("green"), F.col("blue"))
    out = rgb.withColumn("hsv", h).withColumn("gray", pixels.gray(F.col("red"), F.col("green"), F.col("blue")))
    p = F.col("hsv")
    return out.withColumn("is_white", pixels.white(p, white_from) & (F.col("gray") > white_from)).withColumn("is_yellow", pixels.yellow(p)).withColumn("is_road", pixels.road(p, F.col("gray")))


#: Colours of marking types on the map, and of any other.
COLOURS = {"lane_line": "#FFFF00", "crosswalk": "#FF00FF", "stop_line": "#FF0000", "arrow": "#00FF00", "unknown": "#FFA500"}
OTHER_COLOUR = "#FFA500"


def styled(markings: DataFrame, kind: str = "type") -> DataFrame:
    """markings with a colour by type and a title (capitals, the first underscore a space; "Unknown" without a type)."""
    look_up = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    title = F.coalesce(F.upper(F.regexp_replace(F.col(kind), "^([^_]*)_", "$1 ")), F.lit("Unknown"))
    return markings.withColumn("colour", F.coalesce(F.try_element_at(look_up, F.col(kind)), F.lit(OTHER_COLOUR))).withColumn("title", title)


def in_view(points: DataFrame, width: int, height: int, margin: int = 50, x: str = "px", y: str = "py") -> DataFrame:
    """Points on the screen or within `margin` pixels of it."""
    return points.where(F.col(x).between(-margin, width + margin) & F.col(y).between(-margin, height + margin))


def stripes(found: DataFrame, key: str, first: int = 5) -> DataFrame:
    """Of contours (key, part, w, h): per image their number and the sizes [w, h] of the first ones in reading order."""
    n = found.groupBy(key).agg(F.count("*").alias("stripes"))
    top = found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("part"))).where(F.col("_n") <= first)
    sizes = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "w", "h"))).alias("_s"))  # `first` rows
    return n.join(sizes, key).select(key, "stripes", F.transform("_s", lambda x: F.array(x["w"], x["h"])).alias("sizes"))


def label(kind: Column, confidence: Column) -> Column:
    """What stands beside a marking on an annotated image: four letters of its type and its confidence in percent."""
    return F.format_string("%s %s%%", F.substring(kind, 1, 4), F.bround(confidence * 100, 0).cast("int"))


def annotated_name(path: Column) -> Column:
    """The name of the annotated image of a document."""
    return F.replace(path, F.lit(".geojson"), F.lit("_detection.png"))


def demo(spark, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Invented features: three upright lane lines, five bars of a crosswalk and a stop line, as id, type, confidence and ring of [lon, lat]."""
    low, high, west, east = bounds
    at = lambda fx, fy: F.array(F.lit(west) + fx * (east - west), F.lit(low) + fy * (high - low))
    box = lambda x, y, x2, y2: F.array(at(x, y), at(x2, y), at(x2, y2), at(x, y2), at(x, y))
    n, lit = F.col("id").cast("double"), F.lit
    lanes = spark.range(3).select("id", lit("lane_line").alias("type"), lit(0.85).alias("confidence"), F.array(at(0.3 + n * 0.2, lit(0.1)), at(0.3 + n * 0.2, lit(0.9))).alias("ring"))
    y = 0.48 + n * 0.01
    bars = spark.range(5).select((F.col("id") + 3).alias("id"), lit("crosswalk").alias("type"), lit(0.92).alias("confidence"), box(lit(0.25), y, lit(0.75), y + 0.008).alias("ring"))
    stop = spark.range(1).select((F.col("id") + 8).alias("id"), lit("stop_line").alias("type"), lit(0.88).alias("confidence"), box(lit(0.25), lit(0.45), lit(0.45), lit(0.46)).alias("ring"))
    return lanes.unionByName(bars).unionByName(stop)


def demo_at(areas: DataFrame) -> DataFrame:
    """The invented features placed in each area: the columns of areas (with a struct bounds), feature_id, type, confidence and ring. Nine rows are broadcast."""
    unit = demo(areas.sparkSession, (0.0, 1.0, 0.0, 1.0)).withColumnRenamed("id", "feature_id")
    b = F.col("bounds")
    place = lambda p: F.array(b["min_lon"] + p[0] * (b["max_lon"] - b["min_lon"]), b["min_lat"] + p[1] * (b["max_lat"] - b["min_lat"]))
    return areas.crossJoin(F.broadcast(unit)).withColumn("ring", F.transform("ring", place))
