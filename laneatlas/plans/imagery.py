"""Queries of the extractor's steps, larger stencils, stitching, blending and frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laneatlas.engine import Engine
from laneatlas.functions import geo, shapes
from laneatlas.functions import pixels as X
from laneatlas.functions import polygons as P
from laneatlas.operators import chains, fill, filters, seams
from laneatlas.operators import contours as K
from laneatlas.operators import markings as M
from laneatlas.operators import raster as R
from laneatlas.plans.raster import N, _dil, _ero, _frames, _k, _mask, _M, _P, _pixels
from laneatlas.session import shared_folder
from laneatlas.sources import files, frame_stream, frames, tiles
from laneatlas.sources.adapters import SQL, view
from laneatlas.sources.locations import DEFAULT_BOUNDS
from laneatlas.streaming.density import drained

#: Side of the mosaics.
S = 64


def _spots(spark, d, least):
    return view(spark, d, "mosaics").where(F.col("gray") > least).select("k", "r", "c")


def _images(spark, d):
    return frames.from_pixels(view(spark, d, "mosaics").withColumn("video", F.lit("m")), "video", "k", S, S)


def tile_servers(spark, d):
    """The registry, with the number of areas whose zoom each server has."""
    areas = view(spark, d, "areas").groupBy("zoom").agg(F.count("*").alias("n"))
    return tiles.servers(spark).join(areas, F.col("zoom") <= F.col("max_zoom"), "left").groupBy("server", "url", "attribution", "max_zoom").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("areas"))


def denoised(spark, d):
    return R.denoised(_mask(spark, d, 60), "vec_id", N, N)


def line_mask(spark, d):
    return R.line_mask(_pixels(spark, d), "vec_id", 40, N, N)


def ellipse_open(spark, d):
    return R.opened(_mask(spark, d, 60), "vec_id", R.ellipse(5), N, N)


def ellipse_close(spark, d):
    return R.closed(_mask(spark, d, 150), "vec_id", R.ellipse(5), N, N)


def wide_close_open(spark, d):
    box = R.rectangle(15, 15)
    return R.opened(R.closed(_spots(spark, d, 240), "k", box, S, S), "k", box, S, S)


def wide_dilate(spark, d):
    return R.dilate(_spots(spark, d, 250), "k", R.rectangle(30, 30), S, S)


def dense_line_mask(spark, d):
    """line_mask() as one pass over image rows."""
    patches = frames.from_pixels(_pixels(spark, d).withColumn("video", F.lit("p")), "video", "vec_id", N, N)
    return chains.masks(patches, chains.line_mask, threshold=40).select(F.col("frame_idx").alias("vec_id"), "r", "c")


def bright_clean(spark, d):
    """The mask behind pseudo masks, by the chain."""
    return chains.masks(_images(spark, d), chains.bright, threshold=110).select(F.col("frame_idx").alias("k"), "r", "c")


def outstanding_clean(spark, d):
    """Of the classical detector's mask what follows the equalising: adaptive threshold or bright, opened, closed."""
    return chains.masks(_images(spark, d), _outstanding).select(F.col("frame_idx").alias("k"), "r", "c")


def _outstanding(gray):
    return chains.cleaned((filters.adaptive_threshold(gray, 5, -10) > 0) | (gray > 200))


def pseudo_masks(spark, d):
    mask = Engine(spark).pseudo_masks(_images(spark, d), threshold=110, min_area=10)
    return mask.groupBy("frame_idx", F.col("v").alias("class_id")).agg(F.count("*").alias("pixels"), F.sum(F.col("r") * S + F.col("c")).alias("places"))


def cv_detect(spark, d):
    """What the classical detector finds on the mosaics, in pixels and per cent of each image."""
    e, images = Engine(spark), _images(spark, d)
    return e.mask_statistics(e.detect(images, min_area=1), images)


def ring_measures(spark, d):
    """Area, length and moments of rings by Green's theorem, and the logarithms of their invariants."""
    q = view(spark, d, "quads").select("id", F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(4)]).alias("ring"))
    m = q.select("id", P.area(F.col("ring")).alias("area"), P.perimeter(F.col("ring")).alias("perimeter"), P.moments(F.col("ring")).alias("m"))
    m = m.where("area >= 1").withColumn("hu", F.transform(P.hu(F.col("m")), lambda h: F.round(F.when(F.abs(h) > 1e-7, shapes.log_hu(h)).otherwise(0.0), 5)))
    return m.select("id", "area", F.round("perimeter", 6).alias("perimeter"), *[F.col("hu")[k].alias(f"hu{k}") for k in range(4)])


def tiled_components(spark, d):
    """Components of the mosaics, looked at in tiles of 16 x 16 and united over their seams."""
    return seams.tiled_components(_spots(spark, d, 190), "k", 16)


def streamed_frames(spark, d):
    """The mosaics as footage of four cameras, read as a stream with offsets in batches of three frames."""
    path = f"{shared_folder(spark)}/footage-{uuid.uuid4().hex}"
    p = view(spark, d, "mosaics").withColumn("video", F.col("k") % 4)
    frames.from_pixels(p, "video", "k", S, S).write.parquet(path)
    seen = drained(frame_stream.stream_footage(spark, path, per_batch=3), "append")
    return frames.frame_pixels(seen).groupBy("video_id", "frame_idx").agg(F.sum("gray").alias("light"), F.count("*").alias("pixels"))


def filled_rings(spark, d):
    """Pixels inside or on rings, crossing ones by the even-odd rule."""
    q = view(spark, d, "quads").select("id", F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(4)]).alias("ring"), F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(0).alias("part"))
    return fill.painted(q, ["id"], F.lit(1)).groupBy("id").agg(F.count("*").alias("pixels"), F.sum(F.col("r") * 32 + F.col("c")).alias("places"))


def augment_many(spark, d):
    return R.augmented(_pixels(spark, d), N).groupBy("vec_id", "variant", "t").agg(F.count("*").alias("n"), F.sum(F.col("r") * N + F.col("c")).alias("places"))


def blend(spark, d):
    p = _pixels(spark, d)
    return p.select("vec_id", "r", "c", X.blend(F.col("gray"), F.lit(255) - F.col("gray"), 0.4).alias("v"))


def stitched(spark, d):
    t = _pixels(spark, d).withColumn("id", F.col("vec_id") % 3).withColumn("px", (F.col("vec_id") * N).cast("int")).withColumn("py", F.lit(N))
    return R.stitched(t.withColumnRenamed("gray", "v"))


def largest_components(spark, d):
    k = K.contours(_mask(spark, d), "vec_id", N, N)
    return M.largest(k, "vec_id", "n_pixels", 3, "part").select("vec_id", "rank", "n_pixels")


def component_boxes(spark, d):
    return K.contours(_mask(spark, d), "vec_id", N, N).select("vec_id", "part", "n_pixels", "x", "y", "w", "h")


def hull_area(spark, d):
    return K.contours(_mask(spark, d), "vec_id", N, N).select("vec_id", "part", "hull_area")


def pictures_with_masks(spark, d):
    """Pictures of all customers, masks of every third; the others take a mask made of their own pixels."""
    p = view(spark, d, "geo_points")
    pictures = p.select(F.concat(F.lit("/in/"), "id", F.when(F.col("id") % 2 == 0, ".png").otherwise(".jpg")).alias("path"))
    masks = p.where("id % 3 = 0").select(F.concat(F.lit("/masks/"), "id", F.lit(".png")).alias("path"))
    return files.with_masks(pictures, masks).select("stem", "path", "mask", F.col("mask").isNull().alias("made"))


def bilinear(spark, d):
    return filters.resized(_pixels(spark, d), "vec_id", N, N, 4, 4).select("vec_id", "r", "c", F.round("v", 6).alias("v"))


def frame_bytes(spark, d):
    """Pixels written as frames and read back."""
    return frames.frame_pixels(_frames(spark, d))


def default_bounds(spark, d):
    """Bounds with a side missing take the default ones; zero is a side like any other."""
    side = lambda k, v: F.when(F.col("id") % 5 == k, F.lit(None).cast("double")).otherwise(v)
    b = F.struct(side(0, F.lit(0.0)).alias("min_lat"), F.abs("lat").alias("max_lat"), side(1, F.lit(0.0)).alias("min_lon"), F.abs("lon").alias("max_lon"))
    whole = geo.bounds_or(b, geo.bounds_literal(*DEFAULT_BOUNDS))
    return view(spark, d, "geo_points").select("id", whole.alias("b")).select("id", "b.*")





_DISC = [(-2, 0), *[(r, c) for r in (-1, 0, 1) for c in (-2, -1, 0, 1, 2)], (2, 0)]
_SQ2, _SQ2B = [(-1, -1), (-1, 0), (0, -1), (0, 0)], [(1, 1), (1, 0), (0, 1), (0, 0)]
_SQ3 = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
_COL, _ROW = [(k, 0) for k in range(-3, 4)], [(0, k) for k in range(-3, 4)]
_DEN = _dil(_dil(_ero(_ero(_M(60), _SQ2), _SQ2), _SQ2B), _SQ2B)
_LINES = f"(select * from {_dil(_ero(_DEN, _COL), _COL)} union select * from {_dil(_ero(_DEN, _ROW), _ROW)})"
_SPOTS = lambda t: f"(select k, r, c from {SQL['mosaics']} where gray > {t})"
_ALL = f"(select k, r, c from {SQL['mosaics']})"
_FRAME = f"(select k, r::int as r, c::int as c from (select distinct k from {SQL['mosaics']}) a, range(64) b(r), range(64) c(c))"


def _grown(m: str, low: int, high: int) -> str:
    return f"(select distinct g.k, g.r, g.c from {_FRAME} g join {m} m on m.k=g.k and m.r-g.r between {low} and {high} and m.c-g.c between {low} and {high})"


def _shrunk(m: str, reach: int) -> str:
    """Cells with no unset cell within reach."""
    return f"(select g.k, g.r, g.c from {_FRAME} g where exists (select 1 from {m} x where x.k=g.k) and not exists (select 1 from (select * from {_FRAME} except select k, r, c from {m}) u where u.k=g.k and abs(u.r-g.r)<={reach} and abs(u.c-g.c)<={reach}))"


_CLOSED15 = _shrunk(_grown(_SPOTS(240), -7, 7), 7)


def _clean(m: str) -> str:
    """Opened, then closed by 3 x 3; cells beyond the border do not count."""
    opened = _grown(_shrunk(m, 1), -1, 1)
    return _shrunk(_grown(opened, -1, 1), 1)


_SIDES = f"""(select id, px, py, case k when 0 then x0 when 1 then x1 when 2 then x2 else x3 end as ax, case k when 0 then y0 when 1 then y1 when 2 then y2 else y3 end as ay,
case k when 0 then x1 when 1 then x2 when 2 then x3 else x0 end as zx, case k when 0 then y1 when 1 then y2 when 2 then y3 else y0 end as zy from {{q}}, range(4) t(k))"""
_QUADS = f"(select *, 0 as px, 0 as py from {SQL['quads']})"
_SPREAD = f"(select q.*, px::int as px, py::int as py from {SQL['quads']} q, range(32) a(px), range(32) b(py))"
_G = "least(255,greatest(0,cast(floor(pow(gray/255.0::double,1/{g}::double)*255) as int)))"
_VAR = f"""(select vec_id, 'same' as variant, r, c, gray from {_P} union all select vec_id, 'flipped', 7-r, c, gray from {_P} union all select vec_id, 'mirrored', r, 7-c, gray from {_P}
union all select vec_id, 'clockwise', c, 7-r, gray from {_P} union all select vec_id, 'quarter', 7-c, r, gray from {_P} union all select vec_id, 'half', 7-r, 7-c, gray from {_P}
union all select vec_id, 'gamma_0.8', r, c, {_G.format(g='0.8')} from {_P} union all select vec_id, 'gamma_1.2', r, c, {_G.format(g='1.2')} from {_P})"""
_COMP = f"""with recursive m as (select vec_id, r, c, r*8+c as id from {_M(150)}),
l as (select vec_id, id as root, r, c from m union select l.vec_id, l.root, m.r, m.c from l join m on m.vec_id=l.vec_id and abs(m.r-l.r)<=1 and abs(m.c-l.c)<=1),
s as (select vec_id, r, c, min(root) as root from l group by 1,2,3),
z as (select vec_id, root, count(*) as k, min(c) as x, min(r) as y, max(c)-min(c)+1 as w, max(r)-min(r)+1 as h from s group by 1,2)"""

QUERIES = {
    "tile_servers": (tile_servers, f"""select t.*, (select count(*) from {SQL['areas']} a where a.zoom <= t.max_zoom) as areas from (values ('esri_satellite', 'https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/{{z}}/{{y}}/{{x}}', 'ESRI World Imagery', 19),
('esri_streets', 'https://server.arcgisonline.com/ArcGIS/rest/services/World_Street_Map/MapServer/tile/{{z}}/{{y}}/{{x}}', 'ESRI World Street Map', 19), ('osm', 'https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png', 'OpenStreetMap', 19),
('carto_light', 'https://cartodb-basemaps-a.global.ssl.fastly.net/light_all/{{z}}/{{x}}/{{y}}.png', 'CartoDB', 19)) t(server, url, attribution, max_zoom)"""),
    "denoised": (denoised, f"select * from {_DEN}"),
    "line_mask": (line_mask, f"select * from {_ero(_dil(_LINES, _SQ3), _SQ3)}"),
    "ellipse_open": (ellipse_open, f"select * from {_dil(_ero(_M(60), _DISC), _DISC)}"),
    "ellipse_close": (ellipse_close, f"select * from {_ero(_dil(_M(150), _DISC), _DISC)}"),
    "wide_close_open": (wide_close_open, f"select * from {_grown(_shrunk(_CLOSED15, 7), -7, 7)}"),
    "wide_dilate": (wide_dilate, f"select * from {_grown(_SPOTS(250), -15, 14)}"),
    "dense_line_mask": (dense_line_mask, f"select vec_id::bigint as vec_id, r, c from {_ero(_dil(_LINES, _SQ3), _SQ3)}"),
    "bright_clean": (bright_clean, f"select k::bigint as k, r, c from {_clean(_SPOTS(110))}"),
    "outstanding_clean": (outstanding_clean, f"""with recursive a as (select p.k, r, k.t as c, sum(gray*k.k) as v from {SQL['mosaics']} p join {_k(64, 5)} on c=k.s group by 1,2,3),
b as (select a.k, k.t as r, c, sum(v*k.k) as m from a join {_k(64, 5)} on r=k.s group by 1,2,3),
n as (select p.k, p.r, p.c from {_FRAME} p join b on b.k=p.k and b.r=p.r and b.c=p.c left join {SQL['mosaics']} g on g.k=p.k and g.r=p.r and g.c=p.c where coalesce(gray,0) > round(m)+10 or coalesce(gray,0) > 200) select k::bigint as k, r, c from {_clean('n')}"""),
    "pseudo_masks": (pseudo_masks, None),
    "cv_detect": (cv_detect, None),
    "ring_measures": (ring_measures, f"""with s as (select *, (ax*zy-zx*ay)::double as t from {_SIDES.format(q=_QUADS)}),
g as (select id, sum(t)/2 as a, sum(sqrt((zx-ax)*(zx-ax)+(zy-ay)*(zy-ay))) as perimeter, sum(t*(ax+zx))/6 as sx, sum(t*(ay+zy))/6 as sy, sum(t*(ax*ax+ax*zx+zx*zx))/12 as sxx, sum(t*(ay*ay+ay*zy+zy*zy))/12 as syy,
sum(t*(2*ax*ay+ax*zy+zx*ay+2*zx*zy))/24 as sxy, sum(t*(ax*ax*ax+ax*ax*zx+ax*zx*zx+zx*zx*zx))/20 as sxxx, sum(t*(ay*ay*ay+ay*ay*zy+ay*zy*zy+zy*zy*zy))/20 as syyy,
sum(t*(3*ax*ax*ay+ax*ax*zy+2*ax*zx*ay+2*ax*zx*zy+zx*zx*ay+3*zx*zx*zy))/60 as sxxy, sum(t*(3*ay*ay*ax+ay*ay*zx+2*ay*zy*ax+2*ay*zy*zx+zy*zy*ax+3*zy*zy*zx))/60 as sxyy from s group by 1),
f as (select id, abs(a) as a, perimeter, sx/a as x, sy/a as y, sxx/a as xx, syy/a as yy, sxy/a as xy, sxxx/a as xxx, syyy/a as yyy, sxxy/a as xxy, sxyy/a as xyy from g where abs(a) >= 1),
u as (select id, a, perimeter, (xx-x*x)/a as n20, (yy-y*y)/a as n02, (xy-x*y)/a as n11, (xxx-3*x*xx+2*x*x*x)/pow(a,1.5::double) as n30, (yyy-3*y*yy+2*y*y*y)/pow(a,1.5::double) as n03,
(xxy-2*x*xy-y*xx+2*x*x*y)/pow(a,1.5::double) as n21, (xyy-2*y*xy-x*yy+2*y*y*x)/pow(a,1.5::double) as n12 from f),
h as (select id, a, perimeter, n20+n02 as h0, pow(n20-n02,2)+4*n11*n11 as h1, pow(n30-3*n12,2)+pow(3*n21-n03,2) as h2, pow(n30+n12,2)+pow(n21+n03,2) as h3 from u)
select id, a as area, round(perimeter,6) as perimeter, {', '.join(f"round(case when abs(h{k})>1e-7::double then -sign(h{k})*log10(abs(h{k})+1e-10::double) else 0.0::double end,5) as hu{k}" for k in range(4))} from h"""),
    "tiled_components": (tiled_components, f"""with recursive m as (select k, r, c, r::bigint*4294967296+c as id from {SQL['mosaics']} where gray > 190),
l as (select k, id as root, r, c from m union select l.k, l.root, m.r, m.c from l join m on m.k=l.k and abs(m.r-l.r)<=1 and abs(m.c-l.c)<=1),
s as (select k, r, c, min(root) as root from l group by 1,2,3) select k, root, count(*) as n_pixels, min(c) as x, min(r) as y, max(c)-min(c)+1 as w, max(r)-min(r)+1 as h from s group by 1,2"""),
    "streamed_frames": (streamed_frames, f"select (k%4)::varchar as video_id, k::bigint as frame_idx, sum(gray)::bigint as light, 4096::bigint as pixels from {SQL['mosaics']} group by 1,2"),
    "filled_rings": (filled_rings, f"""with s as (select *, (zx-ax)*(py-ay)-(zy-ay)*(px-ax) as side from {_SIDES.format(q=_SPREAD)}),
p as (select id, px, py, sum(case when (ay>py)<>(zy>py) and px < (zx-ax)*(py-ay)/(zy-ay)::double+ax then 1 else 0 end) % 2 = 1 as inside, bool_or(side=0 and px between least(ax,zx) and greatest(ax,zx) and py between least(ay,zy) and greatest(ay,zy)) as edge from s group by 1,2,3)
select id, count(*) as pixels, sum(py*32+px)::bigint as places from p where inside or edge group by 1"""),
    "augment_many": (augment_many, f"select vec_id, variant, t, count(*) as n, sum(r*8+c)::bigint as places from {_VAR}, (values (170),(180),(190),(200),(210),(220),(230)) w(t) where gray>t group by 1,2,3"),
    "blend": (blend, f"select vec_id, r, c, least(255,greatest(0,round(gray*0.6::double+(255-gray)*0.4::double)))::int as v from {_P}"),
    "stitched": (stitched, f"select vec_id%3 as id, 8+r as r, (vec_id*8)::int+c as c, gray as v from {_P}"),
    "largest_components": (largest_components, f"{_COMP}, q as (select vec_id, k::int as n_pixels, (row_number() over (partition by vec_id order by k desc, root))::int as rank from z) select vec_id, rank, n_pixels from q where rank <= 3"),
    "component_boxes": (component_boxes, f"{_COMP} select vec_id, (row_number() over (partition by vec_id order by root))::int as part, k::int as n_pixels, x::int as x, y::int as y, w::int as w, h::int as h from z"),
    "hull_area": (hull_area, f"""{_COMP}, o as (select vec_id, root, (row_number() over (partition by vec_id order by root))::int as part from z),
e as (select a.vec_id, a.root, a.c*b.r-b.c*a.r as turn from s a join s b on a.vec_id=b.vec_id and a.root=b.root and (a.r<>b.r or a.c<>b.c)
where not exists (select 1 from s q where q.vec_id=a.vec_id and q.root=a.root and ((b.c-a.c)*(q.r-a.r)-(b.r-a.r)*(q.c-a.c) < 0
or ((b.c-a.c)*(q.r-a.r)-(b.r-a.r)*(q.c-a.c) = 0 and (q.c-a.c)*(q.c-b.c)+(q.r-a.r)*(q.r-b.r) > 0))))
select o.vec_id, o.part, coalesce(sum(turn),0)/2.0::double as hull_area from o left join e on e.vec_id=o.vec_id and e.root=o.root group by 1, 2"""),
    "pictures_with_masks": (pictures_with_masks, f"""select id::varchar as stem, '/in/' || id || (case when id%2=0 then '.png' else '.jpg' end) as path, case when id%3=0 then '/masks/' || id || '.png' end as mask, id%3<>0 as made from {SQL['geo_points']}"""),
    "bilinear": (bilinear, f"select vec_id, r//2 as r, c//2 as c, round(avg(gray),6) as v from {_P} group by 1,2,3"),
    "frame_bytes": (frame_bytes, f"select (vec_id%4)::varchar as video_id, vec_id::bigint as frame_idx, r, c, gray from {_P}"),
    "default_bounds": (default_bounds, f"""with b as (select id, case when id%5=0 then null else 0.0::double end as a, abs(lat) as b, case when id%5=1 then null else 0.0::double end as c, abs(lon) as d from {SQL['geo_points']})
select id, case when a is null or c is null then 40.7128::double else a end as min_lat, case when a is null or c is null then 40.7138::double else b end as max_lat,
case when a is null or c is null then -74.006::double else c end as min_lon, case when a is null or c is null then -74.005::double else d end as max_lon from b"""),
}
