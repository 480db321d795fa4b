"""Views that carry detections, pixels, regions and points onto the star-schema tables.

Each is a list of expressions that Spark and DuckDB read alike; `view()` makes the DataFrame, `SQL` the text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EXPRESSIONS = {
    # 20 events a frame; a camera for each event type; boxes drift a few pixels on a 640 x 480 canvas
    "detections": ("events", [
        "event_id", "event_type as video_id", "cast(floor(event_id/20.0) as bigint)+1 as frame_id",
        "cast((user_id*37)%560 + cast(floor(event_id/20.0) as bigint)%7 as int) as x",
        "cast((user_id*53)%400 + cast(floor(event_id/20.0) as bigint)%5 as int) as y",
        "cast(40+user_id%20 as int) as w", "cast(30+user_id%25 as int) as h"]),
    # a video for each user, a box for each event, always near the one before
    "sightings": ("events", [
        "event_id", "concat('u', user_id) as video_id", "event_id as frame_id", "cast((user_id*37)%560 + event_id%7 as int) as x",
        "cast((user_id*53)%400 + event_id%5 as int) as y", "cast(40+user_id%20 as int) as w", "cast(30+user_id%25 as int) as h"]),
    # a track for each user
    "tracks": ("events", [
        "user_id as track_id", "event_id as frame_idx", "cast((user_id*37 + event_id*11)%560 as int) as px", "cast((user_id*53 + event_id*7)%400 as int) as py"]),
    # one pixel an event
    "heat_points": ("events", ["event_id", "cast((user_id*37)%640 as int) as px", "cast((event_id*53)%480 as int) as py"]),
    # measures of a contour on a 1920 x 1080 image
    "regions": ("lineitem", [
        "l_orderkey", "l_linenumber", "cast(l_quantity*4 as int) as w", "cast(1+l_partkey%40 as int) as h",
        "round(l_quantity*4*(1+l_partkey%40)*(1-l_discount*6),1) as area",
        "cast(2*(l_quantity*4+1+l_partkey%40) as double) as perimeter", "l_quantity*4*(1+l_partkey%40) as hull_area"]),
    "geo_points": ("customer", [
        "c_custkey as id", "-60+cast((c_custkey*7919)%120000 as double)/1000 as lat",
        "-180+cast((c_custkey*104729)%360000 as double)/1000 as lon"]),
    # a ring of four corners for each customer; some cross themselves
    "quads": ("customer", [
        "c_custkey as id", "cast(c_custkey%7 as int) as x0", "cast(c_custkey%5 as int) as y0", "cast(c_custkey%7 + 5 + c_custkey%11 as int) as x1", "cast(c_custkey%3 as int) as y1",
        "cast(7 + c_custkey%13 as int) as x2", "cast(6 + c_custkey%9 as int) as y2", "cast(c_custkey%4 as int) as x3", "cast(4 + c_custkey%10 as int) as y3"]),
}

#: The same views for the oracle.
SQL = {name: f"(select {', '.join(e)} from {table})" for name, (table, e) in _EXPRESSIONS.items()}
SQL["pixels"] = (
    "(select vec_id, cast(floor(i/8.0) as int) as r, cast(i%8 as int) as c, least(255, greatest(0, cast(floor(128+400*v) as int))) as gray "
    "from (select vec_id, generate_subscripts(embedding,1)-1 as i, cast(unnest(embedding) as double) as v from embeddings))"
)
#: An area for each customer, of a few tiles, at zoom 13 to 20.
SQL["areas"] = f"(select id, lat as min_lat, lat+0.002::double*(1+id%3) as max_lat, lon as min_lon, lon+0.002::double*(1+id%3) as max_lon, (13+id%8)::int as zoom from {SQL['geo_points']})"
#: Images of 64 x 64: sixty-four patches in rows of eight.
SQL["mosaics"] = f"(select vec_id // 64 as k, (vec_id % 64 // 8 * 8 + r)::int as r, (vec_id % 8 * 8 + c)::int as c, gray from {SQL['pixels']})"
SQL["features"] = "(select vec_id, label, list_transform(embedding[1:9], lambda v: cast(v as double)) as f from embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """detections, sightings, tracks, heat_points, regions, geo_points, areas, quads, pixels (8 x 8 gray patches), mosaics (64 x 64 images of patches) or
    features (nine numbers and a label)."""
    if name == "areas":
        wide = F.lit(0.002) * (1 + F.col("id") % 3)
        return view(spark, sf_dir, "geo_points").select("id", F.col("lat").alias("min_lat"), (F.col("lat") + wide).alias("max_lat"), F.col("lon").alias("min_lon"), (F.col("lon") + wide).alias("max_lon"), (13 + F.col("id") % 8).cast("int").alias("zoom"))
    if name == "mosaics":
        at = F.pmod(F.col("vec_id"), F.lit(64))
        return view(spark, sf_dir, "pixels").select(F.floor(F.col("vec_id") / 64).alias("k"), (F.floor(at / 8) * 8 + F.col("r")).cast("int").alias("r"), (at % 8 * 8 + F.col("c")).cast("int").alias("c"), "gray")
    if name == "pixels":
        cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
        gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * F.col("v").cast("double")).cast("int")))
        return cells.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).cast("int").alias("c"), gray.alias("gray"))
    if name == "features":
        return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 9).alias("f"))
    source, expressions = _EXPRESSIONS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the files of its table as a stream (views made of expressions only)."""
    source, expressions = _EXPRESSIONS[name]
    rows = spark.readStream.schema(table(spark, sf_dir, source).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{source}.parq*t")
    return rows.selectExpr(*expressions)
