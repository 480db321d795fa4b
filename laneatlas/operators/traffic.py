"""Detections, tracks and the grids made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneatlas.functions import boxes, geo
from laneatlas.operators import spatial

#: Weight of the newest displacement in a velocity.
ALPHA = 0.3


def sample_frames(frames: DataFrame, rate: int, max_frames: int | None = None, frame: str = "frame_idx") -> DataFrame:
    """Frames before the raw index max_frames whose index is a multiple of rate; put this before any kernel."""
    out = frames if max_frames is None else frames.where(F.col(frame) < max_frames)
    return out.where(F.col(frame) % rate == 0)


def consecutive_overlaps(detections: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of detections of neighbouring frames of a video with iou >= least: video_id, frame_id (of b), a_id, b_id, iou."""
    box = F.struct("x", "y", "w", "h")
    a = detections.select("video_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("event_id").alias("a_id"), box.alias("a"))
    b = detections.select("video_id", "frame_id", F.col("event_id").alias("b_id"), box.alias("b"))
    return spatial.overlap_join(a, b, ["video_id", "frame_id"]).where(F.col("iou") >= least).select("video_id", "frame_id", "a_id", "b_id", "iou")


def displacements(points: DataFrame) -> DataFrame:
    """points (track_id, frame_idx, px, py) with dx, dy from the position before (null at the first) and gap in frames."""
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    return points.withColumn("dx", F.col("px") - F.lag("px").over(w)).withColumn("dy", F.col("py") - F.lag("py").over(w)).withColumn("gap", F.col("frame_idx") - F.lag("frame_idx").over(w))


def velocities(points: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """track_id, vx, vy: displacements folded from (0, 0) with weight alpha for the newest, in frame order.

    The fold in closed form: a displacement that j others follow weighs alpha (1 - alpha)^j. A window over each track, then sums, so that no
    track is held as one value.
    """
    last_first = Window.partitionBy("track_id").orderBy(F.desc("frame_idx"))
    steps = displacements(points).where("dx is not null").withColumn("_j", F.row_number().over(last_first) - 1)
    weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_j"))
    return steps.groupBy("track_id").agg(F.sum(weight * F.col("dx")).alias("vx"), F.sum(weight * F.col("dy")).alias("vy"))


def path_lengths(points: DataFrame) -> DataFrame:
    step = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return displacements(points).groupBy("track_id").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), F.count("*").alias("n_points"))


def predicted(points: DataFrame) -> DataFrame:
    """Next position of each track: the last plus the velocity, truncated towards zero."""
    last = points.groupBy("track_id").agg(F.max_by(F.struct("px", "py"), "frame_idx").alias("p"))
    cut = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    return last.join(velocities(points), "track_id", "left").select("track_id", cut(F.col("p.px") + F.coalesce("vx", F.lit(0.0))).alias("px"), cut(F.col("p.py") + F.coalesce("vy", F.lit(0.0))).alias("py"))


def still_live(lost: DataFrame, tracks: DataFrame) -> DataFrame:
    """Of the ids lost between steps (step, track_id) those that the tracker still has: seen again at a later step."""
    again = tracks.groupBy("track_id").agg(F.max("step").alias("_last"))
    return lost.join(again, "track_id").where(F.col("_last") > F.col("step")).drop("_last")


def density(points: DataFrame, x: str, y: str, width: int, height: int, grid: int = 50) -> DataFrame:
    """Occupied cells gy, gx and their count n; partial counts are summed before the shuffle."""
    return points.select(geo.cell(F.col(y), height, grid).alias("gy"), geo.cell(F.col(x), width, grid).alias("gx")).groupBy("gy", "gx").agg(F.count("*").alias("n"))


def flow(points: DataFrame, width: int, height: int, grid: int = 50) -> DataFrame:
    """Unit vectors of the summed displacements of each cell; zero sums stay zero."""
    d = displacements(points).where("dx is not null").select(geo.cell(F.col("py"), height, grid).alias("gy"), geo.cell(F.col("px"), width, grid).alias("gx"), "dx", "dy")
    s = d.groupBy("gy", "gx").agg(F.sum("dx").cast("double").alias("sx"), F.sum("dy").cast("double").alias("sy"))
    m = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    m = F.when(m == 0, 1.0).otherwise(m)
    return s.select("gy", "gx", (F.col("sx") / m).alias("vx"), (F.col("sy") / m).alias("vy"))


def plausible_detections(detections: DataFrame) -> DataFrame:
    """Rows of a vehicle's size and form; a column `area` is that of the contour and takes the place of the box's."""
    return detections.where(boxes.plausible(F.col("w"), F.col("h"), area=F.col("area") if "area" in detections.columns else None))


def eligible(points: DataFrame, density: int = 2, path: int = 6) -> DataFrame:
    """Tracks with their number of positions and whether that lets them into the density map and the paths."""
    n = points.groupBy("track_id").agg(F.count("*").alias("n"))
    return n.select("track_id", "n", (F.col("n") >= density).alias("in_density"), (F.col("n") >= path).alias("is_path"))
