"""The engine's front: what an application calls."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneatlas.functions import geo, shapes
from laneatlas.operators import chains, contours, filters, fill, heatmap, learning, markings, raster, tiles, traffic
from laneatlas.sources import frames as footage
from laneatlas.sources import imagery, locations
from laneatlas.streaming import tracker


class BadParameter(ValueError):
    """A parameter outside its range."""


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise BadParameter(f"{name} must be {low} to {high}, not {value}")


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def health(self) -> dict:
        return {"status": "healthy", "service": "laneatlas"}

    def locations(self) -> DataFrame:
        return locations.locations(self.spark)

    def tiles(self, place: str | None = None, bounds: tuple[float, float, float, float] | None = None, zoom: int = 18) -> DataFrame:
        """The tiles of a named place, or of bounds (min_lat, max_lat, min_lon, max_lon); zero is a valid side."""
        if place is not None:
            areas = locations.location(self.spark, place)
        elif bounds is not None and all(b is not None for b in bounds):
            areas = self.spark.createDataFrame([("custom", "custom", *map(float, bounds), zoom)], locations.locations(self.spark).schema)
        else:
            raise BadParameter("a place or all four bounds")
        return tiles.area_tiles(locations.with_bounds(areas))

    def imagery(self, path: str, place: str | None = None, bounds: tuple[float, float, float, float] | None = None, zoom: int = 18, **how) -> dict:
        """Fetch the tiles of a place or of bounds to path and write the sidecar, which is returned; sources/imagery.py puts the picture together."""
        if place is not None:
            areas = locations.location(self.spark, place)
        elif bounds is not None and all(b is not None for b in bounds):
            areas = self.spark.createDataFrame([("custom", "custom", *map(float, bounds), zoom)], locations.locations(self.spark).schema)
        else:
            raise BadParameter("a place or all four bounds")
        (extent,) = tiles.stitched_extent(locations.with_bounds(areas)).collect()
        return imagery.download(self.spark, extent.asDict(recursive=True), path, **how)

    def heatmap(self, points: DataFrame, width: int, height: int, grid: int = 50, bounds: tuple | None = None, road_ratio: float | None = None) -> DataFrame:
        """One heatmap document of pixel positions px, py."""
        _within("grid", grid, 10, 200)
        b = geo.bounds_literal(*(bounds or locations.DEFAULT_BOUNDS))
        b = geo.road_bounds(b, ratio=road_ratio) if road_ratio else b
        return heatmap.document(heatmap.heatmap(traffic.density(points, "px", "py", width, height, grid), grid), grid, b)

    def traffic(self, detections: DataFrame, width: int, height: int, grid: int = 50, rate: int = 2, max_frames: int | None = None, bounds: tuple | None = None, frames: DataFrame | None = None) -> DataFrame:
        """One heatmap document of tracked detections; frames are sampled and boxes filtered (by `area`, the contour's, where there is such a column)
        before the tracker sees them. frames (video_id, frame_id): those of the footage, boxes or not; without them tracks age by the sampled
        frames between a video's first and last box."""
        _within("grid", grid, 10, 200)
        _within("rate", rate, 1, 30)
        sampled = lambda rows: traffic.sample_frames(rows, rate, max_frames, "frame_id")
        seen = traffic.plausible_detections(sampled(detections))
        tracks = tracker.track(seen, None if frames is None else sampled(frames), rate)
        cells = tracker.density(tracks, width, height, grid)
        return heatmap.document(heatmap.heatmap(cells, grid), grid, geo.road_bounds(geo.bounds_literal(*(bounds or locations.DEFAULT_BOUNDS)), ratio=0.4))

    def motion(self, frames: DataFrame, width: int, height: int, grid: int = 50, rate: int = 5, max_frames: int | None = None, bounds: tuple | None = None) -> DataFrame:
        """One heatmap document of moving pixels in footage (frames as in sources/frames.py): background model, ellipse 5 x 5 opening and 7 x 7
        closing, area means of the grid, their mean over frames, smoothing over 21 cells."""
        _within("grid", grid, 10, 200)
        _within("rate", rate, 1, 30)
        seen = traffic.sample_frames(frames, rate, max_frames, "frame_idx")
        clean = chains.moving_pixels(seen).select(F.concat_ws(":", "video_id", "frame_idx").alias("k"), "r", "c")
        cells = raster.area_resampled(clean.withColumn("v", F.lit(1.0)), "k", height, width, grid)
        mean = raster.accumulated(cells, seen.agg(F.count("*").alias("n")))
        intensity = heatmap.by_maximum(heatmap.smooth(mean, grid, 21))
        return heatmap.document(intensity, grid, geo.bounds_literal(*(bounds or locations.DEFAULT_BOUNDS)), least=0.001)

    def footage(self, frames: DataFrame, width: int, height: int, rate: int = 2, max_frames: int | None = None, **how) -> DataFrame:
        """One heatmap document of vehicles in footage: background model (variance 50), opening and closing, boxes of components, tracker."""
        _within("rate", rate, 1, 30)
        seen = traffic.sample_frames(frames, rate, max_frames, "frame_idx")
        clock = seen.select("video_id", F.col("frame_idx").alias("frame_id"))
        return self.traffic(self.detections(seen, width, height), width, height, rate=1, frames=clock, **how)

    def detections(self, frames: DataFrame, width: int, height: int) -> DataFrame:
        """Boxes of moving things: video_id, frame_id, event_id (in reading order), x, y, w, h and area, that of the contour, of 500 to 50,000.
        One pass over each video's frames, from background model to boxes."""
        found = chains.moving_shapes(frames).where(F.col("area").between(500, 50_000))
        return found.select("video_id", F.col("frame_idx").alias("frame_id"), F.col("part").cast("long").alias("event_id"), "x", "y", "w", "h", "area")

    def extract(self, gray: DataFrame, key: str, width: int, height: int, threshold: int = 200, min_area: float = 100, rule: str = "v1", bounds: tuple | None = None) -> DataFrame:
        """Features of markings in gray images (key, r, c, gray): equalising, smoothing, bilateral filter, strict threshold, line-like
        openings, closing, shapes, all within one task an image; then filters and classes, with simplified and repaired rings."""
        _within("threshold", threshold, 0, 255)
        found = contours.contours(gray, key, height, width, external=True, chain=functools.partial(chains.extracted, threshold=threshold))
        return self._marked(found, key, F.lit(width), F.lit(height), min_area, bounds, rule)

    def extract_images(self, images: DataFrame, threshold: int = 200, min_area: float = 100, rule: str = "v1", bounds: tuple | None = None) -> DataFrame:
        """As extract(), of image rows (sources/frames.py); nothing is shuffled before the features are numbered, by video."""
        _within("threshold", threshold, 0, 255)
        found = chains.shapes(images, chains.extracted, threshold=threshold).withColumn("part", F.col("frame_idx") * 1_000_000 + F.col("part"))
        return self._marked(found, "video_id", F.col("width"), F.col("height"), min_area, bounds, rule)

    def pseudo_masks(self, images: DataFrame, threshold: int = 200, min_area: float = 50) -> DataFrame:
        """video_id, frame_idx, r, c, v: class ids (1 lane line, 2 crosswalk, 3 arrow, 4 stop line) painted over the bright shapes of images; what is not there is 0."""
        c = F.col
        found = chains.shapes(images, chains.bright, threshold=threshold).where(c("area") >= min_area)
        return fill.painted(found, ["video_id", "frame_idx"], shapes.classify_mask(c("long"), c("short")))

    def detect(self, images: DataFrame, model=None, min_area: float = 50) -> DataFrame:
        """video_id, frame_idx, r, c, v: class ids of markings. model: a function from images to such rows; without one the classical detector finds
        them (equalising, adaptive and plain threshold, cleaning, shapes by proportions and roundness)."""
        if model is not None:
            return model(images)
        c = F.col
        found = chains.shapes(images, chains.detected).where(c("area") >= min_area)
        return fill.painted(found, ["video_id", "frame_idx"], shapes.classify_cv(c("area"), c("perimeter"), c("long"), c("short")))

    def masks(self, images: DataFrame, given: DataFrame, threshold: int = 200, min_area: float = 50) -> DataFrame:
        """Class masks (as pseudo_masks() has them) of images: the given one (frames.SCHEMA, bytes are class ids) where there is one, else a pseudo mask."""
        key = ["video_id", "frame_idx"]
        known = images.select(key).join(given, key, "left_semi").distinct()
        own = footage.frame_pixels(given.join(known, key, "left_semi")).where("gray > 0").withColumnRenamed("gray", "v")
        return own.unionByName(self.pseudo_masks(images.join(known, key, "left_anti"), threshold, min_area))

    def mask_statistics(self, mask: DataFrame, images: DataFrame) -> DataFrame:
        """Per image and class that it shows: video_id, frame_idx, class, pixels and percentage (2 digits) of all its pixels."""
        size = images.select("video_id", "frame_idx", (F.col("height") * F.col("width")).alias("_all"))
        n = mask.groupBy("video_id", "frame_idx", "v").agg(F.count("*").alias("pixels"))
        return n.join(size, ["video_id", "frame_idx"]).select("video_id", "frame_idx", shapes.class_name(F.col("v")).alias("class"), "pixels", F.round(100 * F.col("pixels") / F.col("_all"), 2).alias("percentage"))

    def demo(self, bounds: tuple | None = None) -> tuple[DataFrame, DataFrame]:
        """Invented features and one invented heatmap document."""
        at = bounds or locations.DEFAULT_BOUNDS
        return markings.demo(self.spark, at), heatmap.demo_document(self.spark, at)

    def complete(self, place: str, mask: DataFrame, key: str, width: int, height: int, detections: DataFrame | None = None) -> dict[str, DataFrame]:
        """The whole route of a place: its tiles, the markings on its imagery and, with detections, the heatmap of its traffic; nothing runs yet."""
        row = locations.location(self.spark, place).first()
        sides = (row["min_lat"], row["max_lat"], row["min_lon"], row["max_lon"])
        out = {"tiles": self.tiles(place), "markings": self.markings(mask, key, width, height, bounds=sides)}
        if detections is not None:
            out["traffic"] = self.traffic(detections, 640, 480, bounds=sides)
        return out

    def markings(self, mask: DataFrame, key: str, width: int, height: int, min_area: float = 80, bounds: tuple | None = None, rule: str = "v2") -> DataFrame:
        """Features of the markings of binary images (key, r, c of set pixels); rule: v2, v1, trainer or parallel."""
        return self._marked(contours.contours(mask, key, height, width, external=True), key, F.lit(width), F.lit(height), min_area, bounds, rule)

    def _marked(self, found: DataFrame, key: str, width, height, min_area: float, bounds: tuple | None, rule: str) -> DataFrame:
        """Contours to features, filtered and classed by a rule. But for v2, rings are simplified and repaired; of a ring that crosses itself each part is a feature."""
        _within("min_area", min_area, 0, float("inf"))
        c = F.col
        area, around = c("area"), c("perimeter")
        order = ["part"]
        if rule == "v2":
            kept = found.where(shapes.keep_marking(area, c("w"), c("h"), c("hull_area"), width * height, min_area))
            kind = shapes.classify_v2(area, c("w"), c("h"), c("hull_area"))
            kept = kept.withColumn("type", kind["type"]).withColumn("confidence", kind["confidence"])
        else:
            kept = found.where(shapes.keep_marking_rotated(area, c("long"), c("short"), width * height, min_area))
            rules = {"v1": lambda: shapes.classify_v1(area, around, c("long"), c("short")), "trainer": lambda: shapes.classify_trainer(area, around, c("long"), c("short")), "parallel": lambda: shapes.classify_parallel(c("long"), c("short"))}
            kept = kept.withColumn("type", rules[rule]()).withColumn("confidence", shapes.confidence(area, around))
            kept = kept.drop("ring").select("*", F.posexplode("parts").alias("piece", "ring"))
            order.append("piece")
        return markings.features(markings.numbered(kept, key, order), width, height, geo.bounds_literal(*(bounds or locations.DEFAULT_BOUNDS)))

    def train(self, samples: DataFrame, trees: int = 200):
        """A balanced forest on samples (f: nine numbers, label)."""
        ready = learning.prepared(samples)
        return learning.train_forest(ready, trees=trees), ready
