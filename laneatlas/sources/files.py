"""Images, footage, documents and models on disk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneatlas.session import ship

#: Rows of an image that become one batch of pixels.
STRIP = 64
BOUNDS = "struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>"
HEATMAP = f"bounds {BOUNDS}, grid_size int, points array<struct<lat:double,lon:double,intensity:double>>, statistics struct<max_intensity:double,min_intensity:double,mean_intensity:double,total_points:bigint>"
#: Kinds of files that each route takes.
KINDS = {
    "imagery": ("png", "jpg", "jpeg", "tif", "tiff", "geotiff"),
    "video": ("mp4", "avi", "mov", "mkv", "webm"),
    "footage": ("mov", "mp4", "avi"),
    "pipeline_footage": ("mov", "mp4"),
    "training": ("png", "jpg"),
    "segmentation": ("png", "jpg", "tif"),
}
ALLOWED = KINDS["imagery"]


class MissingDocument(FileNotFoundError):
    """A document that was never written."""


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def images(spark: SparkSession, path: str) -> DataFrame:
    """One row an image: origin, height, width, n_channels, data (blue, green, red bytes)."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def image_pixels(read: DataFrame) -> DataFrame:
    """Rows origin, r, c, red, green, blue of three-channel images, linear in their size; an image is one row, so it must fit a task."""
    ship(read.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, high, wide, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(high, wide, 3)
                for top in range(0, high, STRIP):
                    part = image[top : top + STRIP].astype(np.int32)
                    r, c = np.indices(part.shape[:2], np.int32)
                    cells = [(r + top).ravel(), c.ravel(), *(np.ascontiguousarray(part[..., k]).ravel() for k in (2, 1, 0))]
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * r.size), *map(pa.array, cells)], names=["origin", "r", "c", "red", "green", "blue"])

    rows = read.where("n_channels = 3").select("origin", "height", "width", "data")
    return rows.mapInArrow(run, "origin string, r int, c int, red int, green int, blue int")


def scan(spark: SparkSession, path: str, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Files of the allowed kinds below a folder, by path; contents are not read unless selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(extension(F.col("path")).isin(*allowed)).select("path", "length", "modificationTime").orderBy("path")


class RefusedFile(ValueError):
    """A file of a kind that a route does not take."""


def accepted(name: str, route: str) -> str:
    """The name, if its kind is one of the route's; upper case counts as lower."""
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    if kind not in KINDS[route]:
        raise RefusedFile(f"{name}: {route} takes {', '.join(KINDS[route])}")
    return name


def first_file(spark: SparkSession, path: str, allowed: tuple[str, ...] = KINDS["footage"]) -> str | None:
    row = scan(spark, path, allowed).orderBy("path").limit(1).first()
    return row and row["path"]


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Training images with the label of their folder: lines are lane lines, crosswalk crosswalks."""
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return scan(spark, path, KINDS["training"]).withColumn("label", F.when(folder == "lines", "lane_line").when(folder == "crosswalk", "crosswalk")).where("label is not null")


def with_masks(pictures: DataFrame, masks: DataFrame) -> DataFrame:
    """Pictures with the path of the mask of the same file stem, or null."""
    stem = F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1)
    return pictures.withColumn("stem", stem).join(masks.select(stem.alias("stem"), F.col("path").alias("mask")), "stem", "left")


def heatmap_document(spark: SparkSession, path: str) -> DataFrame:
    """A heatmap document; MissingDocument if there is none."""
    try:
        return spark.read.schema(HEATMAP).option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingDocument(path) from e
        raise


def geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON documents (a collection or a feature each), or, with `lines`, of a feature a line, as write_features() leaves them: id, geometry (its type),
    rings (array of rings of [lon, lat]; a line is one, a point one of one place, several polygons give the rings of all), properties (map of strings) and
    text, the feature as it stands. MissingDocument if there is no such path; what is no feature is left out. A document is one value."""
    try:
        read = spark.read.text(path, wholetext=not lines)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingDocument(path) from e
        raise
    if not lines:
        one = F.from_json("value", "type string, features array<string>")
        read = read.select(F.explode(F.when(one["type"] == "FeatureCollection", one["features"]).otherwise(F.array("value"))).alias("value"))
    feature = "type string, id string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
    f = read.select(F.col("value").alias("text"), F.from_json("value", feature).alias("f")).where("f.type = 'Feature'")
    raw, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    rings = (
        F.when(kind == "Polygon", F.from_json(raw, "array<array<array<double>>>")).when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>")))
        .when(kind == "Point", F.array(F.array(F.from_json(raw, "array<double>")))).when(kind == "MultiPolygon", F.flatten(F.from_json(raw, "array<array<array<array<double>>>>")))
    )
    return f.select(F.col("f.id").alias("id"), kind.alias("geometry"), rings.alias("rings"), F.col("f.properties").alias("properties"), "text")


def sidecar_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Bounds of imagery from its sidecar, nested or flat."""
    flat = "min_lat double, max_lat double, min_lon double, max_lon double"
    read = spark.read.schema(f"bounds {BOUNDS}, zoom int, {flat}").option("multiLine", True).json(path)
    return read.select("zoom", *[F.coalesce(F.col(f"bounds.{c}"), F.col(c)).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


def write_document(one_row: DataFrame, path: str) -> None:
    """One JSON document of a one-row DataFrame."""
    one_row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """A row a feature (JSON lines), which grows with the number of partitions; collection() makes the single document."""
    features.select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)


def collection(features: DataFrame) -> DataFrame:
    """One FeatureCollection of all features, which must fit one row."""
    listed = features.agg(F.sort_array(F.collect_list("feature")).alias("features"), F.count("*").alias("n"))
    return listed.select(F.lit("FeatureCollection").alias("type"), "features", F.struct(F.col("n").alias("total_markings")).alias("metadata"))


def write_imagery(tiles: DataFrame, sidecar: DataFrame, path: str) -> None:
    """Tiles with their place as a table, and the sidecar of bounds, zoom and size as JSON beside it."""
    tiles.write.mode("overwrite").partitionBy("zoom").parquet(f"{path}/tiles")
    sidecar.coalesce(1).write.mode("overwrite").json(f"{path}/sidecar")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Spark's own format only; pickles are never read."""
    return PipelineModel.load(path)
