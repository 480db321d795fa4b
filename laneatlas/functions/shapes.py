"""Column functions of contour measures: filters, confidence and the six rule classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aspect(w: Column, h: Column) -> Column:
    """Longer over shorter side, the shorter taken as 1 at least."""
    return F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))


def rotated_aspect(w: Column, h: Column) -> Column:
    """Longer over shorter side; null for a degenerate box."""
    return F.when((w > 0) & (h > 0), F.greatest(w, h) / F.least(w, h))


def circularity(area: Column, perimeter: Column, floor: bool = False) -> Column:
    """4 pi A / P^2; floor: the divisor is 1 at least; else 0 where the perimeter is 0."""
    if floor:
        return 4 * F.pi() * area / F.greatest(perimeter * perimeter, F.lit(1.0))
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(F.lit(0.0))


def solidity(area: Column, hull: Column, floor: bool = True) -> Column:
    if floor:
        return area / F.greatest(hull, F.lit(1.0))
    return F.when(hull > 0, area / hull).otherwise(F.lit(0.0))


def extent(area: Column, w: Column, h: Column) -> Column:
    return F.when(w * h > 0, area / (w * h)).otherwise(F.lit(0.0))


def keep_marking(area: Column, w: Column, h: Column, hull: Column, image_area: float, min_area: float = 50) -> Column:
    """Elongated, not thick, not huge, solid. Cheap conditions come first, so that the hull is looked at last."""
    return (area >= min_area) & (aspect(w, h) >= 2) & (F.least(w, h) <= 150) & (area <= image_area * 0.01) & (solidity(area, hull) >= 0.5)


def keep_marking_rotated(area: Column, w: Column, h: Column, image_area: float, min_area: float = 100) -> Column:
    """The simpler filter: size bounds and a rotated aspect of 3 or more."""
    return (area >= min_area) & (area <= image_area * 0.01) & F.coalesce(rotated_aspect(w, h) >= 3, F.lit(False))


def confidence(area: Column, perimeter: Column) -> Column:
    return F.least(F.lit(1.0), 0.6 * F.least(F.lit(1.0), area / 5000) + 0.4 * F.least(F.lit(1.0), perimeter / 500))


def classify_v2(area: Column, w: Column, h: Column, hull: Column) -> Column:
    """struct(type, confidence): a crosswalk needs solidity too; a shape of its proportions without it is a plain lane line."""
    ar, thin, firm = aspect(w, h), F.least(w, h), solidity(area, hull)
    lane = lambda c: F.struct(F.lit("lane_line").alias("type"), F.lit(c).alias("confidence"))
    bar = ar.between(3, 8) & (thin > 10)
    return (
        F.when((ar > 8) & (thin < 20), lane(0.9))
        .when(bar & (firm > 0.7), F.struct(F.lit("crosswalk").alias("type"), F.lit(0.85).alias("confidence")))
        .when(bar, lane(0.63))
        .when((w > h * 4) & (firm > 0.8), F.struct(F.lit("stop_line").alias("type"), F.lit(0.8).alias("confidence")))
        .otherwise(lane(0.63))
    )


def classify_v1(area: Column, perimeter: Column, w: Column, h: Column) -> Column:
    ar, round_ = rotated_aspect(w, h), circularity(area, perimeter)
    return F.when((ar > 2) & (ar <= 8) & (perimeter > 0) & (round_ < 0.4), "crosswalk").otherwise("lane_line")


def classify_trainer(area: Column, perimeter: Column, w: Column, h: Column) -> Column:
    ar, round_ = rotated_aspect(w, h), circularity(area, perimeter)
    return F.when((ar > 2) & (ar < 8) & (perimeter > 0) & (round_ < 0.3), "crosswalk").otherwise("lane_line")


def classify_parallel(w: Column, h: Column) -> Column:
    return F.when(rotated_aspect(w, h) <= 8, "crosswalk").otherwise("lane_line")


def classify_mask(w: Column, h: Column) -> Column:
    """Class id of a pseudo mask: 1 lane line, 4 stop line, 2 crosswalk, 3 arrow; null for a degenerate box."""
    ar = rotated_aspect(w, h)
    return F.when(ar > 6, 1).when(ar > 3, 4).when(ar > 1.5, 2).when(ar.isNotNull(), 3)


def classify_cv(area: Column, perimeter: Column, w: Column, h: Column) -> Column:
    """As classify_mask, but a crosswalk is not round."""
    ar = rotated_aspect(w, h)
    return F.when(ar > 6, 1).when(ar > 3, 4).when((ar > 1.5) & (circularity(area, perimeter) < 0.5), 2).when(ar.isNotNull(), 3)


#: Class ids of segmentation masks.
CLASS_NAMES = {0: "background", 1: "lane_line", 2: "crosswalk", 3: "arrow", 4: "stop_line"}


#: Red, green and blue of each class on overlays.
CLASS_COLOURS = {0: (0, 0, 0), 1: (255, 255, 0), 2: (255, 255, 255), 3: (0, 255, 0), 4: (255, 0, 0)}


def class_colour(class_id: Column) -> Column:
    rgb = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("red", "green", "blue"), v, strict=True)])
    return F.create_map(*[x for k, v in CLASS_COLOURS.items() for x in (F.lit(k), rgb(v))])[class_id]


def class_name(class_id: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])[class_id]


def finite(features: Column) -> Column:
    return F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def log_hu(h: Column) -> Column:
    """-sign(h) log10(|h| + 1e-10), 0 for 0, held within 20."""
    return F.when(h == 0, F.lit(0.0)).otherwise(F.least(F.lit(20.0), F.greatest(F.lit(-20.0), -F.signum(h) * F.log10(F.abs(h) + 1e-10))))
