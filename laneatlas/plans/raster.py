"""Queries of pixels and stencils over the 8 x 8 patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from laneatlas.functions import pixels as X
from laneatlas.operators import contours as K
from laneatlas.operators import filters
from laneatlas.operators import markings as M
from laneatlas.operators import raster as R
from laneatlas.sources import frames
from laneatlas.sources.adapters import SQL, view

N = 8
BOX = R.rectangle(3, 3)


def _pixels(spark, d):
    return view(spark, d, "pixels")


def _mask(spark, d, least=150):
    return _pixels(spark, d).where(F.col("gray") > least).select("vec_id", "r", "c")


def _other(spark, d):
    return _pixels(spark, d).where(F.col("gray").between(100, 185)).select("vec_id", "r", "c")


def threshold_mask(spark, d):
    return _pixels(spark, d).select("vec_id", "r", "c", F.when(F.col("gray") > 180, 255).otherwise(0).alias("v"))


def inverse_threshold_mask(spark, d):
    return _pixels(spark, d).select("vec_id", "r", "c", F.when(F.col("gray") > 180, 0).otherwise(255).alias("v"))


def range_mask(spark, d):
    return _other(spark, d)


def mask_union(spark, d):
    return _mask(spark, d, 180).union(_other(spark, d)).distinct()


def mask_intersect(spark, d):
    return _mask(spark, d, 150).intersect(_other(spark, d))


def mask_except(spark, d):
    return _mask(spark, d, 150).exceptAll(_other(spark, d))


def _stencil(op):
    return lambda spark, d: op(_mask(spark, d), "vec_id", BOX, N, N)


def line_preserving(spark, d):
    return R.lines_kept(_mask(spark, d, 60), "vec_id", N, N)


def near_mask(spark, d):
    return R.near(_mask(spark, d, 150), _mask(spark, d, 230), "vec_id", 4, N, N)


def class_pixels(spark, d):
    g = F.col("gray")
    return M.class_pixels(_pixels(spark, d).select(F.when(g > 200, 1).when(g > 150, 2).when(g > 100, 3).otherwise(0).alias("cls")))


def brightness_profile(spark, d):
    b = M.brightness(_pixels(spark, d), "vec_id")
    return b.select("vec_id", F.round("mean_bright", 6).alias("mean_bright"), "low", "high", F.round("bright_percent", 6).alias("bright_percent"))


def training_report(spark, d):
    """Brightness of each patch, the number of its outermost bright stripes and the sizes of the first five."""
    b = M.brightness(_pixels(spark, d), "vec_id").where("mean_bright is not null")
    found = M.stripes(K.contours(_mask(spark, d, 180), "vec_id", N, N, external=True), "vec_id")
    sizes = F.array_join(F.transform("sizes", lambda x: F.concat_ws("x", x[0], x[1])), ",")
    return b.join(found, "vec_id").select("vec_id", F.round("mean_bright", 6).alias("mean_bright"), "low", "high", F.round("bright_percent", 6).alias("bright_percent"), "stripes", sizes.alias("sizes"))


def _as_v(spark, d):
    return _pixels(spark, d).select("vec_id", "r", "c", F.col("gray").cast("double").alias("v"))


def block_resample(spark, d):
    return R.area_resampled(_as_v(spark, d), "vec_id", N, N, 4).select("vec_id", "gy", "gx", F.round("v", 6).alias("v"))


def block_resample_uneven(spark, d):
    return R.area_resampled(_as_v(spark, d), "vec_id", N, N, 3).select("vec_id", "gy", "gx", F.round("v", 6).alias("v"))


def motion_accumulate(spark, d):
    m = _pixels(spark, d).select("vec_id", "r", "c", F.when(F.col("gray") > 180, 1.0).otherwise(0.0).alias("v"))
    n = view(spark, d, "features").agg(F.count("*").alias("n"))
    return R.accumulated(R.area_resampled(m, "vec_id", N, N, 4), n).select("gy", "gx", F.round("v", 6).alias("v"))


def blurred(spark, d):
    return R.blurred(_as_v(spark, d), "vec_id", 5, N, N).select("vec_id", "r", "c", F.round("v", 4).alias("v"))


def augment_fanout(spark, d):
    v = R.variants(_pixels(spark, d), N).withColumn("t", F.explode(F.array(*[F.lit(t) for t in (150, 180, 200)])))
    on = v.where(F.col("gray") > F.col("t"))
    return on.groupBy("vec_id", "variant", "t").agg(F.count("*").alias("n"), F.sum(F.col("r") * N + F.col("c")).alias("places"))


def nearest_resample(spark, d):
    cells = _pixels(spark, d).where((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0))
    return cells.select("vec_id", (F.col("r") / 2).cast("int").alias("r"), (F.col("c") / 2).cast("int").alias("c"), "gray")


def gamma_contrast(spark, d):
    p = _pixels(spark, d)
    return p.select("vec_id", "r", "c", X.gamma(F.col("gray"), 0.8).alias("dark"), X.gamma(F.col("gray"), 1.2).alias("light"), X.contrast(F.col("gray"), 1.5, -40).alias("contrast"))


def color_masks(spark, d):
    p = _pixels(spark, d)
    rgb = p.select("vec_id", "r", "c", F.col("gray").alias("red"), (F.col("gray") * 7 % 256).alias("green"), (F.col("gray") * 13 % 256).alias("blue"))
    m = M.marking_masks(rgb, 100)
    return m.select("vec_id", "r", "c", "gray", F.col("hsv.h").alias("h"), F.col("hsv.s").alias("s"), F.col("hsv.v").alias("v"), "is_white", "is_yellow", "is_road")


def components(spark, d):
    k = K.contours(_mask(spark, d), "vec_id", N, N)
    return k.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("n_pixels").alias("largest"))


def contour_features(spark, d):
    k = K.contours(_mask(spark, d), "vec_id", N, N)
    r = F.transform("features", lambda x: F.round(x, 6))
    return k.select("vec_id", "part", "n_pixels", "area", F.round("perimeter", 6).alias("perimeter"), "x", "y", "w", "h", "hull_area", F.array_join(r.cast("array<string>"), ",").alias("features"))


def _filter(kernel, **how):
    return lambda spark, d: filters.filtered(_pixels(spark, d), "vec_id", kernel, N, N, **how)


def _frames(spark, d):
    return frames.from_pixels(_pixels(spark, d).withColumn("video", F.col("vec_id") % 4), "video", "vec_id", N, N)


def moving_pixels(spark, d):
    return filters.foreground(_frames(spark, d))


def flow_pairs(spark, d):
    f = filters.flow_between(_frames(spark, d))
    return f.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"), F.round(F.max("magnitude"), 6).alias("fastest"))


_P = SQL["pixels"]
_M = lambda t: f"(select vec_id, r, c from {_P} where gray > {t})"
_O = f"(select vec_id, r, c from {_P} where gray between 100 and 185)"
_GRID = f"(select distinct vec_id, r, c from {_P})"


def _off(element) -> str:
    return "(values " + ",".join(f"({a},{b})" for a, b in element) + ") o(dr, dc)"


def _dil(m: str, e) -> str:
    return f"(select distinct g.vec_id, g.r, g.c from {_GRID} g, {_off(e)}, {m} m where m.vec_id=g.vec_id and m.r=g.r+o.dr and m.c=g.c+o.dc)"


def _ero(m: str, e) -> str:
    return f"(select g.vec_id, g.r, g.c from {_GRID} g cross join {_off(e)} left join {m} m on m.vec_id=g.vec_id and m.r=g.r+o.dr and m.c=g.c+o.dc where g.r+o.dr between 0 and 7 and g.c+o.dc between 0 and 7 group by 1,2,3 having count(*)=count(m.r))"


def _opn(m: str, e) -> str:
    return _dil(_ero(m, e), R._flip(e))


def _k(n: int, size: int) -> str:
    """(source, target, weight) of a mirrored Gaussian, from its formula."""
    h = size // 2
    w = f"exp(-(d*d)/(2*pow(0.3::double*(({size}-1)*0.5::double-1)+0.8::double, 2)))"
    at = f"(case when t+d < 0 then -(t+d) when t+d > {n - 1} then {2 * (n - 1)}-(t+d) else t+d end)"
    return f"(select {at}::int as s, t::int as t, sum({w})/(select sum({w}) from range(-{h},{h + 1}) z(d)) as k from range({n}) a(t), range(-{h},{h + 1}) b(d) group by 1, 2) k"


def _hsv() -> str:
    return f"""with p as (select vec_id, r, c, gray as red, gray*7%256 as green, gray*13%256 as blue from {_P}),
q as (select *, greatest(red,green,blue) as v, greatest(red,green,blue)-least(red,green,blue) as dd,
 least(255,greatest(0,cast(floor(0.299::double*red+0.587::double*green+0.114::double*blue+0.5::double) as int))) as g from p),
h as (select *, case when dd=0 then 0 when v=red then 60.0::double*(green-blue)/dd when v=green then 120+60.0::double*(blue-red)/dd else 240+60.0::double*(red-green)/dd end as a from q),
i as (select *, cast(floor((case when a<0 then a+360 else a end)/2+0.5::double) as int) as b, case when v=0 then 0 else cast(floor(255.0::double*dd/v+0.5::double) as int) end as s from h),
j as (select vec_id, r, c, g as gray, case when b>=180 then 0 else b end as h, s, v from i)"""


_AREA3 = "(values " + ",".join(f"({p},{g},{(min((g + 1) * 8 / 3, p + 1) - max(g * 8 / 3, p)) * 3 / 8!r}::double)" for p in range(8) for g in range(3) if min((g + 1) * 8 / 3, p + 1) - max(g * 8 / 3, p) > 1e-12) + ")"
_TURNS = "(values ('same'),('mirrored'),('flipped'),('quarter'),('half')) v(variant)"
_TR = "case variant when 'same' then r when 'mirrored' then r when 'flipped' then 7-r when 'quarter' then 7-c else 7-r end"
_TC = "case variant when 'same' then c when 'mirrored' then 7-c when 'flipped' then c when 'quarter' then r else 7-c end"

QUERIES = {
    "threshold_mask": (threshold_mask, f"select vec_id, r, c, case when gray>180 then 255 else 0 end as v from {_P}"),
    "inverse_threshold_mask": (inverse_threshold_mask, f"select vec_id, r, c, case when gray>180 then 0 else 255 end as v from {_P}"),
    "range_mask": (range_mask, f"select * from {_O}"),
    "mask_union": (mask_union, f"select * from {_M(180)} union select * from {_O}"),
    "mask_intersect": (mask_intersect, f"select * from {_M(150)} intersect select * from {_O}"),
    "mask_except": (mask_except, f"select * from {_M(150)} except select * from {_O}"),
    "dilate": (_stencil(R.dilate), f"select * from {_dil(_M(150), BOX)}"),
    "erode": (_stencil(R.erode), f"select * from {_ero(_M(150), BOX)}"),
    "open": (_stencil(R.opened), f"select * from {_opn(_M(150), BOX)}"),
    "close": (_stencil(R.closed), f"select * from {_ero(_dil(_M(150), BOX), R._flip(BOX))}"),
    "line_preserving": (line_preserving, f"select * from {_opn(_M(60), R.rectangle(7, 1))} union select * from {_opn(_M(60), R.rectangle(1, 7))}"),
    "near_mask": (near_mask, f"select m.* from {_M(150)} m where exists (select 1 from {_M(230)} o where o.vec_id=m.vec_id and o.r-m.r between -2 and 1 and o.c-m.c between -2 and 1)"),
    "class_pixels": (class_pixels, f"with k as (select case when gray>200 then 1 when gray>150 then 2 when gray>100 then 3 else 0 end as cls from {_P}) select cls, count(*) as pixels, round(100.0::double*count(*)/(select count(*) from k),2) as percentage from k where cls<>0 group by 1"),
    "brightness_profile": (brightness_profile, f"select vec_id, round(avg(gray) filter (where gray>180),6) as mean_bright, min(gray) as low, max(gray) as high, round(100.0::double*count(*) filter (where gray>180)/count(*),6) as bright_percent from {_P} group by 1"),
    "training_report": (training_report, f"""with recursive m as (select vec_id, r, c, r*8+c as id from {_M(180)}),
o as (select distinct vec_id, -1 as r, -1 as c from m union select o.vec_id, o.r+s.a, o.c+s.b from o, (values (0,1),(0,-1),(1,0),(-1,0)) s(a,b)
where o.r+s.a between -1 and 8 and o.c+s.b between -1 and 8 and not exists (select 1 from m where m.vec_id=o.vec_id and m.r=o.r+s.a and m.c=o.c+s.b)),
l as (select vec_id, id as root, r, c from m union select l.vec_id, l.root, m.r, m.c from l join m on m.vec_id=l.vec_id and abs(m.r-l.r)<=1 and abs(m.c-l.c)<=1),
s as (select vec_id, r, c, min(root) as root from l group by 1,2,3),
z as (select s.vec_id, root, max(c)-min(c)+1 as w, max(r)-min(r)+1 as h from s group by 1,2 having bool_or(exists (select 1 from o where o.vec_id=s.vec_id and abs(o.r-s.r)+abs(o.c-s.c)=1))),
q as (select *, row_number() over (partition by vec_id order by root) as n from z),
b as (select vec_id, round(avg(gray) filter (where gray>180),6) as mean_bright, min(gray) as low, max(gray) as high, round(100.0::double*count(*) filter (where gray>180)/count(*),6) as bright_percent from {_P} group by 1)
select b.*, t.stripes, t.sizes from b join (select vec_id, count(*) as stripes, string_agg(w || 'x' || h, ',' order by n) filter (where n <= 5) as sizes from q group by 1) t on t.vec_id=b.vec_id"""),
    "block_resample": (block_resample, f"select vec_id, r//2 as gy, c//2 as gx, round(avg(gray),6) as v from {_P} group by 1,2,3"),
    "block_resample_uneven": (block_resample_uneven, f"select vec_id, a.g as gy, b.g as gx, round(sum(gray*a.w*b.w),6) as v from {_P} join {_AREA3} a(p,g,w) on a.p=r join {_AREA3} b(p,g,w) on b.p=c group by 1,2,3"),
    "motion_accumulate": (motion_accumulate, f"select r//2 as gy, c//2 as gx, round(sum(case when gray>180 then 0.25::double else 0 end)/count(distinct vec_id),6) as v from {_P} group by 1,2"),
    "blurred": (blurred, f"with a as (select vec_id, r, k.t as c, sum(gray*k.k) as v from {_P} join {_k(8, 5)} on c=k.s group by 1,2,3) select vec_id, k.t as r, c, round(sum(v*k.k),4) as v from a join {_k(8, 5)} on r=k.s group by 1,2,3"),
    "augment_fanout": (augment_fanout, f"select vec_id, variant, t, count(*) as n, sum(({_TR})*8+({_TC}))::bigint as places from {_P}, {_TURNS}, (values (150),(180),(200)) w(t) where gray>t group by 1,2,3"),
    "nearest_resample": (nearest_resample, f"select vec_id, r//2 as r, c//2 as c, gray from {_P} where r%2=0 and c%2=0"),
    "gamma_contrast": (gamma_contrast, f"select vec_id, r, c, least(255,greatest(0,cast(floor(pow(gray/255.0::double,1/0.8::double)*255) as int))) as dark, least(255,greatest(0,cast(floor(pow(gray/255.0::double,1/1.2::double)*255) as int))) as light, least(255,greatest(0,cast(round(abs(1.5::double*gray-40)) as int))) as contrast from {_P}"),
    "color_masks": (color_masks, f"{_hsv()} select *, h between 0 and 180 and s between 0 and 50 and v between 100 and 255 and gray>100 as is_white, h between 15 and 35 and s between 100 and 255 and v between 100 and 255 as is_yellow, gray between 40 and 130 and s between 0 and 60 as is_road from j"),
    "components": (components, f"""with recursive m as (select vec_id, r, c, r*8+c as id from {_M(150)}),
l as (select vec_id, id as root, r, c from m union select l.vec_id, l.root, m.r, m.c from l join m on m.vec_id=l.vec_id and abs(m.r-l.r)<=1 and abs(m.c-l.c)<=1),
s as (select vec_id, r, c, min(root) as root from l group by 1,2,3), z as (select vec_id, root, count(*) as k from s group by 1,2)
select vec_id, count(*) as n, max(k)::int as largest from z group by 1"""),
    "contour_features": (contour_features, None),
    "adaptive_threshold": (_filter("adaptive_threshold", size=5, c=-10), f"""with a as (select vec_id, r, k.t as c, sum(gray*k.k) as v from {_P} join {_k(8, 5)} on c=k.s group by 1,2,3),
b as (select vec_id, k.t as r, c, sum(v*k.k) as m from a join {_k(8, 5)} on r=k.s group by 1,2,3) select p.vec_id, p.r, p.c, case when gray > round(m)+10 then 255 else 0 end as v from {_P} p join b on b.vec_id=p.vec_id and b.r=p.r and b.c=p.c"""),
    "bilateral": (_filter("bilateral", size=5), f"""with o as (select y, x from range(-2,3) a(y), range(-2,3) b(x) where y*y+x*x <= 4),
w as (select p.vec_id, p.r, p.c, q.gray as v, exp(-(y*y+x*x)/11250.0::double-pow(q.gray-p.gray,2)/11250.0::double) as g from {_P} p, o, {_P} q
where q.vec_id=p.vec_id and q.r=(case when p.r+y<0 then -(p.r+y) when p.r+y>7 then 14-(p.r+y) else p.r+y end) and q.c=(case when p.c+x<0 then -(p.c+x) when p.c+x>7 then 14-(p.c+x) else p.c+x end))
select vec_id, r, c, round(sum(g*v)/sum(g))::int as v from w group by 1,2,3"""),
    "equalized": (_filter("equalized", tiles=2), None),
    "moving_pixels": (moving_pixels, None),
    "flow_pairs": (flow_pairs, None),
}
