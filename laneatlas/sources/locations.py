"""The registry of named places and of tile servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, name, min_lat, max_lat, min_lon, max_lon, zoom.
LOCATIONS = [
    ("times_square_nyc", "Times Square, New York", 40.7565, 40.7595, -73.9890, -73.9840, 19),
    ("shibuya_tokyo", "Shibuya Crossing, Tokyo", 35.6580, 35.6610, 139.6990, 139.7030, 19),
    ("champs_elysees_paris", "Champs-Élysées, Paris", 48.8690, 48.8720, 2.3050, 2.3100, 19),
    ("highway_intersection", "Highway Intersection Sample", 40.7480, 40.7520, -73.9920, -73.9870, 18),
    ("downtown_la", "Downtown Los Angeles", 34.0480, 34.0520, -118.2550, -118.2490, 19),
]
COLUMNS = ["id", "name", "min_lat", "max_lat", "min_lon", "max_lon", "zoom"]
MAX_ZOOM = 19
#: Bounds of the first place, which the queries use.
NYC = LOCATIONS[0][2:6]
#: min_lat, max_lat, min_lon, max_lon where an application gives no bounds.
DEFAULT_BOUNDS = (40.7128, 40.7138, -74.0060, -74.0050)

SQL = "(select * from (values " + ", ".join(f"('{i}', '{n}', {a}::double, {b}::double, {c}::double, {d}::double, {z})" for i, n, a, b, c, d, z in LOCATIONS) + ") t(id, name, min_lat, max_lat, min_lon, max_lon, zoom))"


class UnknownLocation(KeyError):
    """A place that the registry does not have."""


def locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCATIONS, "id string, name string, min_lat double, max_lat double, min_lon double, max_lon double, zoom int")


def location(spark: SparkSession, name: str) -> DataFrame:
    if name not in {x[0] for x in LOCATIONS}:
        raise UnknownLocation(name)
    return locations(spark).where(F.col("id") == name)


def looked_up(requests: DataFrame, place: str = "place") -> DataFrame:
    """requests with name, bounds and zoom of the place they ask for, and known: false, and null elsewhere, for one that the registry lacks. The
    registry is broadcast (five rows)."""
    found = locations(requests.sparkSession).withColumnRenamed("id", place).withColumn("known", F.lit(True))
    return requests.join(F.broadcast(found), place, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def with_bounds(df: DataFrame) -> DataFrame:
    """The four sides as one struct `bounds`."""
    return df.withColumn("bounds", F.struct("min_lat", "max_lat", "min_lon", "max_lon"))
