"""Queries of tiles, bounds and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from laneatlas.functions import geo
from laneatlas.operators import spatial, tiles
from laneatlas.sources import locations as L
from laneatlas.sources import tiles as T
from laneatlas.sources.adapters import SQL, view

Z = 12
_TX = "cast(floor(({lon}+180)/360*pow(2,{z})) as bigint)"
_TY = "cast(floor((1-asinh(tan(radians({lat})))/pi())/2*pow(2,{z})) as bigint)"
_LON = "({x}/pow(2.0,{z})*360-180)"
_LAT = "degrees(atan(sinh(pi()*(1-2*({y})/pow(2.0,{z})))))"


def _areas(spark, d):
    return L.with_bounds(view(spark, d, "areas"))


def tile_assign(spark, d):
    p = view(spark, d, "geo_points")
    return p.select("id", geo.tile_x(F.col("lon"), F.lit(Z)).alias("x"), geo.tile_y(F.col("lat"), F.lit(Z)).alias("y"))


def tile_bounds(spark, d):
    z = F.lit(8)
    t = view(spark, d, "geo_points").select(geo.tile_x(F.col("lon"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y")).distinct()
    b = geo.tile_bounds(F.col("x"), F.col("y"), z)
    return t.select("x", "y", *[F.round(b[c], 9).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


def area_tile_scan(spark, d):
    return tiles.area_tiles(_areas(spark, d))


def stitched_extent(spark, d):
    s = tiles.stitched_extent(_areas(spark, d))
    return s.select("id", "zoom", "min_x", "max_x", "min_y", "max_y", "width", "height", *[F.round(f"actual.{c}", 9).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


def location_list(spark, d):
    """The registry, with the number of customers that each place is nearest to."""
    near = nearest_centre(spark, d).groupBy(F.col("place").alias("id")).agg(F.count("*").alias("customers"))
    return L.locations(spark).join(near, "id", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


def points_in_locations(spark, d):
    wide = L.locations(spark).select(F.col("id").alias("place"), F.struct((F.col("min_lat") - 15).alias("min_lat"), (F.col("max_lat") + 15).alias("max_lat"), (F.col("min_lon") - 15).alias("min_lon"), (F.col("max_lon") + 15).alias("max_lon")).alias("bounds"))
    return spatial.points_in_boxes(view(spark, d, "geo_points"), wide).select("id", "place")


def location_lookup(spark, d):
    """Every sixth customer asks for a place that the registry lacks."""
    names = F.array(*[F.lit(x) for x in ("times_square_nyc", "shibuya_tokyo", "champs_elysees_paris", "highway_intersection", "downtown_la", "london")])
    asked = view(spark, d, "geo_points").select("id", F.get(names, (F.col("id") % 6).cast("int")).alias("place"))
    return L.looked_up(asked).select("id", "place", "known", "max_lat", "zoom")


def nearest_centre(spark, d):
    centres = F.array(*[F.struct(F.lit(i).alias("place"), F.lit((a + b) / 2).alias("lat"), F.lit((c + e) / 2).alias("lon")) for i, _, a, b, c, e, _ in L.LOCATIONS])
    far = F.transform(centres, lambda c: F.struct(F.round((c["lat"] - F.col("lat")) * (c["lat"] - F.col("lat")) + (c["lon"] - F.col("lon")) * (c["lon"] - F.col("lon")), 3).alias("d2"), c["place"].alias("place")))
    best = F.array_min(far)
    return view(spark, d, "geo_points").select("id", best["place"].alias("place"), best["d2"].alias("d2"))


def pixel_to_geo(spark, d):
    g = geo.pixel_to_geo(F.col("px"), F.col("py"), 640, 480, geo.bounds_literal(*L.NYC))
    return view(spark, d, "heat_points").select("event_id", F.round(g["lon"], 9).alias("lon"), F.round(g["lat"], 9).alias("lat"))


def road_bounds(spark, d):
    r = geo.road_bounds(F.col("bounds"), 0.5, 0.5, 0.4)
    return _areas(spark, d).select("id", *[F.round(r[c], 9).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


def tile_urls(spark, d):
    """Addresses of all tiles of the areas, at a server of each area's own."""
    t = tiles.area_tiles(_areas(spark, d)).withColumn("server", F.get(F.array(*[F.lit(k) for k in T.SERVERS]), (F.col("id") % len(T.SERVERS)).cast("int")))
    return T.with_urls(t).select("id", "seq", "url")


_RANGE = f"""select id, least(zoom, 19) as zoom,
  least({_TX.format(lon='min_lon', z='zoom')}, {_TX.format(lon='max_lon', z='zoom')}) as min_x, greatest({_TX.format(lon='min_lon', z='zoom')}, {_TX.format(lon='max_lon', z='zoom')}) as max_x,
  least({_TY.format(lat='min_lat', z='zoom')}, {_TY.format(lat='max_lat', z='zoom')}) as min_y, greatest({_TY.format(lat='min_lat', z='zoom')}, {_TY.format(lat='max_lat', z='zoom')}) as max_y
  from (select * replace (least(zoom, 19) as zoom) from {SQL['areas']})"""
_TILES = f"""with r as ({_RANGE}), ys as (select *, unnest(range(min_y, max_y+1)) as y from r), xs as (select *, unnest(range(min_x, max_x+1)) as x from ys)
select id, zoom, ((y-min_y)*(max_x-min_x+1)+x-min_x)::bigint as seq, x::bigint as x, y::bigint as y, ((x-min_x)*256)::bigint as px, ((y-min_y)*256)::bigint as py from xs"""
_CENTRES = " union all ".join(f"select '{i}' as place, {(a + b) / 2!r}::double as clat, {(c + e) / 2!r}::double as clon" for i, _, a, b, c, e, _ in L.LOCATIONS)
_A, _B, _C, _D = L.NYC

QUERIES = {
    "tile_assign": (tile_assign, f"select id, {_TX.format(lon='lon', z=Z)} as x, {_TY.format(lat='lat', z=Z)} as y from {SQL['geo_points']}"),
    "tile_bounds": (tile_bounds, f"""with t as (select distinct {_TX.format(lon='lon', z=8)} as x, {_TY.format(lat='lat', z=8)} as y from {SQL['geo_points']})
select x, y, round({_LAT.format(y='y+1', z=8)}, 9) as min_lat, round({_LAT.format(y='y', z=8)}, 9) as max_lat, round({_LON.format(x='x', z=8)}, 9) as min_lon, round({_LON.format(x='(x+1)', z=8)}, 9) as max_lon from t"""),
    "area_tile_scan": (area_tile_scan, _TILES),
    "stitched_extent": (stitched_extent, f"""with r as ({_RANGE}) select id, zoom, min_x, max_x, min_y, max_y, (max_x-min_x+1)*256 as width, (max_y-min_y+1)*256 as height,
round({_LAT.format(y='max_y+1', z='zoom')}, 9) as min_lat, round({_LAT.format(y='min_y', z='zoom')}, 9) as max_lat, round({_LON.format(x='min_x', z='zoom')}, 9) as min_lon, round({_LON.format(x='(max_x+1)', z='zoom')}, 9) as max_lon from r"""),
    "location_list": (location_list, f"""with n as (select id, arg_min(place, (d2, place)) as place from (select id, place, round((clat-lat)*(clat-lat)+(clon-lon)*(clon-lon),3) as d2 from {SQL['geo_points']}, ({_CENTRES})) group by id)
select l.*, (select count(*) from n where n.place=l.id) as customers from {L.SQL} l"""),
    "points_in_locations": (points_in_locations, f"select p.id, l.id as place from {SQL['geo_points']} p join {L.SQL} l on p.lat between l.min_lat-15 and l.max_lat+15 and p.lon between l.min_lon-15 and l.max_lon+15"),
    "location_lookup": (location_lookup, f"""select id, n[(id%6)::int+1] as place, id%6<>5 as known, ([40.7595, 35.661, 48.872, 40.752, 34.052, null]::double[])[(id%6)::int+1] as max_lat, ([19, 19, 19, 18, 19, null]::int[])[(id%6)::int+1] as zoom
from {SQL['geo_points']}, (select ['times_square_nyc', 'shibuya_tokyo', 'champs_elysees_paris', 'highway_intersection', 'downtown_la', 'london'] as n)"""),
    "nearest_centre": (nearest_centre, f"select id, arg_min(place, (d2, place)) as place, min(d2) as d2 from (select id, place, round((clat-lat)*(clat-lat)+(clon-lon)*(clon-lon),3) as d2 from {SQL['geo_points']}, ({_CENTRES})) group by id"),
    "pixel_to_geo": (pixel_to_geo, f"select event_id, round({_C}::double+px/640.0::double*({_D}::double-({_C}::double)),9) as lon, round({_B}::double-py/480.0::double*({_B}::double-{_A}::double),9) as lat from {SQL['heat_points']}"),
    "road_bounds": (road_bounds, f"""select id, round(min_lat+(max_lat-min_lat)*0.5::double-(max_lat-min_lat)*0.4::double/2,9) as min_lat, round(min_lat+(max_lat-min_lat)*0.5::double+(max_lat-min_lat)*0.4::double/2,9) as max_lat,
round(min_lon+(max_lon-min_lon)*0.5::double-(max_lon-min_lon)*0.4::double/2,9) as min_lon, round(min_lon+(max_lon-min_lon)*0.5::double+(max_lon-min_lon)*0.4::double/2,9) as max_lon from {SQL['areas']}"""),
    "tile_urls": (tile_urls, f"""select id, seq, case id%4 when 0 then 'https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/' || zoom || '/' || y || '/' || x
when 1 then 'https://server.arcgisonline.com/ArcGIS/rest/services/World_Street_Map/MapServer/tile/' || zoom || '/' || y || '/' || x
when 2 then 'https://tile.openstreetmap.org/' || zoom || '/' || x || '/' || y || '.png' else 'https://cartodb-basemaps-a.global.ssl.fastly.net/light_all/' || zoom || '/' || x || '/' || y || '.png' end as url from ({_TILES})"""),
}
