"""Frames of footage as rows: video_id, frame_idx, height, width, fps, image (gray bytes, row by row).

Footage is decoded outside (no decoder is at hand here) and arrives as a table or a folder of Parquet files in this form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneatlas.session import ship

SCHEMA = "video_id string, frame_idx long, height int, width int, fps double, image binary"


class UnreadableFrames(ValueError):
    """A table that is not one of frames."""


def read_frames(spark: SparkSession, path: str, rate: int = 1, max_frames: int | None = None) -> DataFrame:
    """Frames below a path whose index is a multiple of rate and less than max_frames; both conditions reach the scan."""
    rows = spark.read.parquet(path)
    missing = {c.split()[0] for c in SCHEMA.split(", ")} - set(rows.columns)
    if missing:
        raise UnreadableFrames(f"{path} lacks {', '.join(sorted(missing))}")
    rows = rows if max_frames is None else rows.where(F.col("frame_idx") < max_frames)
    return rows.where(F.col("frame_idx") % rate == 0)


def stream_frames(spark: SparkSession, path: str, rate: int = 1) -> DataFrame:
    """The same as a stream of the files that arrive."""
    return spark.readStream.schema(SCHEMA).parquet(path).where(F.col("frame_idx") % rate == 0)


def from_pixels(pixels: DataFrame, video: str, frame: str, high: int, wide: int, value: str = "gray", fps: float = 30.0) -> DataFrame:
    """Frames of rows video, frame, r, c, value; pixels that are missing are black."""
    ship(pixels.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((high, wide), np.uint8)
        image[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "frame_idx": [pdf["frame_idx"].iloc[0]], "height": [high], "width": [wide], "fps": [fps], "image": [image.tobytes()]})

    rows = pixels.select(F.col(video).cast("string").alias("video_id"), F.col(frame).cast("long").alias("frame_idx"), "r", "c", F.col(value).alias("v"))
    return rows.groupBy("video_id", "frame_idx").applyInPandas(run, SCHEMA)


def frame_pixels(frames: DataFrame) -> DataFrame:
    """Rows video_id, frame_idx, r, c, gray."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, k, high, wide, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r, c = np.indices((high, wide), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([video] * r.size), pa.array(np.full(r.size, k, np.int64)), pa.array(r.ravel()), pa.array(c.ravel()), pa.array(np.frombuffer(data, np.uint8).astype(np.int32))], names=["video_id", "frame_idx", "r", "c", "gray"])

    return frames.select("video_id", "frame_idx", "height", "width", "image").mapInArrow(run, "video_id string, frame_idx long, r int, c int, gray int")
