"""Column functions of Web-Mercator tiles, bounds and grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_lon(x: Column, zoom: Column) -> Column:
    """Longitude of a tile's western edge."""
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_lat(y: Column, zoom: Column) -> Column:
    """Latitude of a tile's northern edge."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    return F.struct(tile_lat(y + 1, zoom).alias("min_lat"), tile_lat(y, zoom).alias("max_lat"), tile_lon(x, zoom).alias("min_lon"), tile_lon(x + 1, zoom).alias("max_lon"))


def centre(bounds: Column) -> Column:
    return F.struct(((bounds["min_lat"] + bounds["max_lat"]) / 2).alias("lat"), ((bounds["min_lon"] + bounds["max_lon"]) / 2).alias("lon"))


def pixel_to_geo(x: Column, y: Column, width, height, bounds: Column) -> Column:
    """struct(lon, lat), y downwards; null bounds pass the pixel through."""
    lon = bounds["min_lon"] + x / width * (bounds["max_lon"] - bounds["min_lon"])
    lat = bounds["max_lat"] - y / height * (bounds["max_lat"] - bounds["min_lat"])
    return F.struct(F.when(bounds.isNull(), x.cast("double")).otherwise(lon).alias("lon"), F.when(bounds.isNull(), y.cast("double")).otherwise(lat).alias("lat"))


def cell(p: Column, size, grid: int) -> Column:
    """Grid cell of a pixel coordinate, held inside the grid."""
    return F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(p / size * grid).cast("int")))


def cell_to_geo(gy: Column, gx: Column, grid: int, bounds: Column | None = None) -> Column:
    """struct(lon, lat) of a cell: its centre within bounds; without bounds its corner, normalised to 0..1."""
    if bounds is None:
        return F.struct((gx / grid).alias("lon"), (1.0 - gy / grid).alias("lat"))
    lon = bounds["min_lon"] + (gx + 0.5) / grid * (bounds["max_lon"] - bounds["min_lon"])
    lat = bounds["max_lat"] - (gy + 0.5) / grid * (bounds["max_lat"] - bounds["min_lat"])
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def road_bounds(bounds: Column, offset_x: float = 0.5, offset_y: float = 0.5, ratio: float = 0.3) -> Column:
    """A box of `ratio` of the bounds' size about the point at (offset_x, offset_y) of them."""
    lats, lons = bounds["max_lat"] - bounds["min_lat"], bounds["max_lon"] - bounds["min_lon"]
    lat, lon = bounds["min_lat"] + lats * offset_y, bounds["min_lon"] + lons * offset_x
    half_lat, half_lon = lats * ratio / 2, lons * ratio / 2
    return F.struct((lat - half_lat).alias("min_lat"), (lat + half_lat).alias("max_lat"), (lon - half_lon).alias("min_lon"), (lon + half_lon).alias("max_lon"))


def cell_ring(gy: Column, gx: Column, grid: int, bounds: Column) -> Column:
    """Closed ring of [lon, lat] corners of a cell, from its south-west."""
    wide, high = (bounds["max_lon"] - bounds["min_lon"]) / grid, (bounds["max_lat"] - bounds["min_lat"]) / grid
    west, north = bounds["min_lon"] + gx * wide, bounds["max_lat"] - gy * high
    east, south = west + wide, north - high
    return F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))


def bounds_or(bounds: Column, default: Column) -> Column:
    """Default bounds where any side is null; zero is a valid side."""
    whole = bounds["min_lat"].isNotNull() & bounds["max_lat"].isNotNull() & bounds["min_lon"].isNotNull() & bounds["max_lon"].isNotNull()
    return F.when(whole, bounds).otherwise(default)


def bounds_literal(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    return F.struct(F.lit(min_lat).alias("min_lat"), F.lit(max_lat).alias("max_lat"), F.lit(min_lon).alias("min_lon"), F.lit(max_lon).alias("max_lon"))
