"""Column functions of axis-parallel boxes (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; touching boxes and empty unions give 0."""
    wide = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = wide * high
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def centre(box: Column) -> Column:
    return F.struct((box["x"] + F.floor(box["w"] / 2)).cast("int").alias("cx"), (box["y"] + F.floor(box["h"] / 2)).cast("int").alias("cy"))


def upright(w: Column, h: Column) -> Column:
    """Width over height from 0.2 to 5; a box without height does not pass."""
    return F.when(h > 0, w / h).otherwise(F.lit(0.0)).between(0.2, 5.0)


def plausible(w: Column, h: Column, least: float = 500, most: float = 50_000, area: Column | None = None) -> Column:
    """Detections of a vehicle's size and form: area (of the contour; where there is none, of the box) within bounds, and upright()."""
    return (w * h if area is None else area).between(least, most) & upright(w, h)
