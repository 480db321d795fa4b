"""Column functions of single pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(v: Column) -> Column:
    """Held within 0..255, as unsigned bytes saturate."""
    return F.least(F.lit(255), F.greatest(F.lit(0), v))


def gray(r: Column, g: Column, b: Column) -> Column:
    return byte(F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int"))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h 0..179, s, v 0..255) of 8-bit channels."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, 60 * (g - b) / d).when(top == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    hue = F.floor(F.when(hue < 0, hue + 360).otherwise(hue) / 2 + 0.5).cast("int")
    s = F.when(top == 0, F.lit(0)).otherwise(F.floor(255 * d / top + 0.5).cast("int"))
    return F.struct(F.when(hue >= 180, 0).otherwise(hue).alias("h"), s.alias("s"), top.alias("v"))


def white(p: Column, t: int) -> Column:
    return p["h"].between(0, 180) & p["s"].between(0, 50) & p["v"].between(t, 255)


def yellow(p: Column) -> Column:
    return p["h"].between(15, 35) & p["s"].between(100, 255) & p["v"].between(100, 255)


def road(p: Column, g: Column) -> Column:
    return g.between(40, 130) & p["s"].between(0, 60)


def gamma(v: Column, value: float) -> Column:
    return byte(F.floor(F.pow(v / 255, F.lit(1.0 / value)) * 255).cast("int"))


def contrast(v: Column, alpha: float, beta: float) -> Column:
    """|alpha v + beta|, rounded and saturated."""
    return byte(F.round(F.abs(alpha * v + beta)).cast("int"))


def blend(a: Column, b: Column, alpha: float) -> Column:
    return byte(F.round(a * (1 - alpha) + b * alpha).cast("int"))
