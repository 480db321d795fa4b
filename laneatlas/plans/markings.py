"""Queries of contour measures and their classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from laneatlas.functions import geo, shapes
from laneatlas.operators import markings as M
from laneatlas.sources.adapters import SQL, view
from laneatlas.sources.locations import NYC, with_bounds

IMAGE = 1920 * 1080


def _c(*names):
    return [F.col(n) for n in names]


def _regions(spark, d):
    return view(spark, d, "regions")


def marking_filter_v2(spark, d):
    return _regions(spark, d).where(shapes.keep_marking(*_c("area", "w", "h", "hull_area"), IMAGE, 80))


def marking_filter_v1(spark, d):
    return _regions(spark, d).where(shapes.keep_marking_rotated(*_c("area", "w", "h"), IMAGE, 100))


def _classified(rule):
    def run(spark, d):
        return _regions(spark, d).select("l_orderkey", "l_linenumber", rule().alias("cls"))

    return run


def classify_v2(spark, d):
    k = shapes.classify_v2(*_c("area", "w", "h", "hull_area"))
    return marking_filter_v2(spark, d).select("l_orderkey", "l_linenumber", k["type"].alias("type"), k["confidence"].alias("confidence"))


def marking_confidence(spark, d):
    return _regions(spark, d).select("l_orderkey", "l_linenumber", F.round(shapes.confidence(*_c("area", "perimeter")), 3).alias("confidence"))


def shape_measures(spark, d):
    return _regions(spark, d).select(
        "l_orderkey", "l_linenumber", F.round(shapes.aspect(*_c("w", "h")), 9).alias("aspect"), F.round(shapes.circularity(*_c("area", "perimeter"), floor=True), 9).alias("circularity"),
        F.round(shapes.solidity(*_c("area", "hull_area")), 9).alias("solidity"), F.round(shapes.extent(*_c("area", "w", "h")), 9).alias("extent"),
    )


def count_by_type(spark, d):
    return M.count_by_type(classify_v2(spark, d))


def mask_class_pixels(spark, d):
    r = _regions(spark, d).select(F.coalesce(shapes.classify_mask(*_c("w", "h")), F.lit(0)).alias("cls"))
    return M.class_pixels(r).select(shapes.class_name(F.col("cls")).alias("class_name"), "pixels", "percentage")


def feature_geojson(spark, d):
    det = view(spark, d, "detections")
    x, y, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    marks = det.withColumn("ring", F.array(corner(x, y), corner(x2, y), corner(x2, y2), corner(x, y2))).withColumn("type", F.lit("lane_line")).withColumn("confidence", F.lit(0.63)).withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    f = M.features(M.numbered(marks, "video_id", ["event_id"]), 640, 480, geo.bounds_literal(*NYC))
    ring = F.transform(F.col("feature.geometry.coordinates")[0], lambda p: F.format_string("%.11f %.11f", p[0], p[1]))
    return f.select("video_id", "id", F.array_join(ring, ",").alias("ring"), "feature.properties.area_pixels", "feature.properties.center_x", "feature.properties.center_y")


def style_lookup(spark, d):
    return M.styled(classify_v2(spark, d)).select("l_orderkey", "l_linenumber", "colour", "title")


def viewport_cull(spark, d):
    p = view(spark, d, "heat_points").select("event_id", (F.col("px") - 300).alias("px"), (F.col("py") - 200).alias("py"))
    return M.in_view(p, 200, 150)


def demo_features(spark, d):
    """The invented features in each area. Formatting rounds; the sign of what lies just below zero stays, as in SQL (Spark's round() drops it)."""
    ring = F.array_join(F.transform("ring", lambda p: F.format_string("%.6f %.6f", p[0], p[1])), ",")
    return M.demo_at(with_bounds(view(spark, d, "areas")).select("id", "bounds")).select("id", "feature_id", "type", "confidence", ring.alias("ring"))


def marking_labels(spark, d):
    name = F.concat(F.lit("markings_"), F.col("l_orderkey"), F.lit(".geojson"))
    return classify_v2(spark, d).select("l_orderkey", "l_linenumber", M.label(F.col("type"), F.col("confidence")).alias("label"), M.annotated_name(name).alias("picture"))


def class_palette(spark, d):
    """Names, colours and pixels of the classes of all patches."""
    g = F.col("gray")
    c = view(spark, d, "pixels").groupBy(F.when(g > 200, 1).when(g > 160, 2).when(g > 120, 3).when(g > 80, 4).otherwise(0).alias("cls")).agg(F.count("*").alias("pixels"))
    rgb = shapes.class_colour(F.col("cls"))
    return c.select("cls", shapes.class_name(F.col("cls")).alias("name"), rgb["red"].alias("red"), rgb["green"].alias("green"), rgb["blue"].alias("blue"), "pixels")


def noise_filters(spark, d):
    r = _regions(spark, d)
    return r.agg(*[F.count_if(F.col("area") >= n).alias(f"from_{n}") for n in (30, 50, 100)])


_R = SQL["regions"]
_ASP = "(greatest(w,h)::double/greatest(least(w,h),1))"
_ROT = "(case when w>0 and h>0 then greatest(w,h)::double/least(w,h) end)"
_CIRC = "(case when perimeter>0 then 4*pi()*area/(perimeter*perimeter) else 0 end)"
_SOL = "(area/greatest(hull_area,1))"
_V2 = f"select * from {_R} where area>=80 and {_ASP}>=2 and least(w,h)<=150 and area<={IMAGE}*0.01::double and {_SOL}>=0.5"
_T2 = f"""case when {_ASP}>8 and least(w,h)<20 then 'lane_line' when {_ASP} between 3 and 8 and least(w,h)>10 then (case when {_SOL}>0.7 then 'crosswalk' else 'lane_line' end)
 when w>h*4 and {_SOL}>0.8 then 'stop_line' else 'lane_line' end"""
_C2 = f"""case when {_ASP}>8 and least(w,h)<20 then 0.9::double when {_ASP} between 3 and 8 and least(w,h)>10 then (case when {_SOL}>0.7 then 0.85::double else 0.63::double end)
 when w>h*4 and {_SOL}>0.8 then 0.8::double else 0.63::double end"""
_ID = "l_orderkey, l_linenumber"
_S = [f"({x!r})::double" for x in NYC]
_LON = f"({_S[2]}+({{x}})/640.0::double*({_S[3]}-{_S[2]}))"
_LAT = f"({_S[1]}-({{y}})/480.0::double*({_S[1]}-{_S[0]}))"
_CORNERS = [("x", "y"), ("x+w-1", "y"), ("x+w-1", "y+h-1"), ("x", "y+h-1"), ("x", "y")]
_RING = ", ".join(_LON.format(x=x) + ", " + _LAT.format(y=y) for x, y in _CORNERS)

_COLOUR = "case type when 'lane_line' then '#FFFF00' when 'crosswalk' then '#FF00FF' when 'stop_line' then '#FF0000' when 'arrow' then '#00FF00' else '#FFA500' end"
_TITLE = "case type when 'lane_line' then 'LANE LINE' when 'stop_line' then 'STOP LINE' when 'crosswalk' then 'CROSSWALK' end"
_P = lambda x, y: f"format('{{:.6f}} {{:.6f}}', round(min_lon+({x})*(max_lon-min_lon),6), round(min_lat+({y})*(max_lat-min_lat),6))"
_Y, _Y2 = "(0.48::double+i*0.01::double)", "(0.48::double+i*0.01::double+0.008::double)"
_BOX = lambda x, y, x2, y2: " || ',' || ".join(_P(a, b) for a, b in ((x, y), (x2, y), (x2, y2), (x, y2), (x, y)))
_DEMO = f"""select id, i::bigint as feature_id, 'lane_line' as type, 0.85::double as confidence, {_P('0.3::double+i*0.2::double', '0.1::double')} || ',' || {_P('0.3::double+i*0.2::double', '0.9::double')} as ring from {SQL['areas']}, range(3) t(i)
union all select id, i+3, 'crosswalk', 0.92::double, {_BOX('0.25::double', _Y, '0.75::double', _Y2)} from {SQL['areas']}, range(5) t(i)
union all select id, 8, 'stop_line', 0.88::double, {_BOX('0.25::double', '0.45::double', '0.45::double', '0.46::double')} from {SQL['areas']}"""

QUERIES = {
    "style_lookup": (style_lookup, f"select {_ID}, {_COLOUR} as colour, {_TITLE} as title from (select {_ID}, {_T2} as type from ({_V2}))"),
    "viewport_cull": (viewport_cull, f"select event_id, px-300 as px, py-200 as py from {SQL['heat_points']} where px-300 between -50 and 250 and py-200 between -50 and 200"),
    "demo_features": (demo_features, _DEMO),
    "marking_labels": (marking_labels, f"select {_ID}, substr(type,1,4) || ' ' || round(confidence*100)::int || '%' as label, 'markings_' || l_orderkey || '_detection.png' as picture from (select {_ID}, {_T2} as type, {_C2} as confidence from ({_V2}))"),
    "class_palette": (class_palette, f"""select t.*, n.pixels from (values (0,'background',0,0,0),(1,'lane_line',255,255,0),(2,'crosswalk',255,255,255),(3,'arrow',0,255,0),(4,'stop_line',255,0,0)) t(cls, name, red, green, blue)
join (select case when gray>200 then 1 when gray>160 then 2 when gray>120 then 3 when gray>80 then 4 else 0 end as cls, count(*) as pixels from {SQL['pixels']} group by 1) n on n.cls=t.cls"""),
    "noise_filters": (noise_filters, f"select count(*) filter (where area>=30) as from_30, count(*) filter (where area>=50) as from_50, count(*) filter (where area>=100) as from_100 from {_R}"),
    "marking_filter_v2": (marking_filter_v2, _V2),
    "marking_filter_v1": (marking_filter_v1, f"select * from {_R} where area>=100 and area<={IMAGE}*0.01::double and {_ROT}>=3"),
    "classify_v2": (classify_v2, f"select {_ID}, {_T2} as type, {_C2} as confidence from ({_V2})"),
    "classify_v1": (_classified(lambda: shapes.classify_v1(*_c("area", "perimeter", "w", "h"))), f"select {_ID}, case when {_ROT}>2 and {_ROT}<=8 and perimeter>0 and {_CIRC}<0.4 then 'crosswalk' else 'lane_line' end as cls from {_R}"),
    "classify_trainer": (_classified(lambda: shapes.classify_trainer(*_c("area", "perimeter", "w", "h"))), f"select {_ID}, case when {_ROT}>2 and {_ROT}<8 and perimeter>0 and {_CIRC}<0.3 then 'crosswalk' else 'lane_line' end as cls from {_R}"),
    "classify_parallel": (_classified(lambda: shapes.classify_parallel(*_c("w", "h"))), f"select {_ID}, case when {_ROT}<=8 then 'crosswalk' else 'lane_line' end as cls from {_R}"),
    "classify_mask": (_classified(lambda: shapes.classify_mask(*_c("w", "h"))), f"select {_ID}, case when {_ROT}>6 then 1 when {_ROT}>3 then 4 when {_ROT}>1.5 then 2 when {_ROT} is not null then 3 end as cls from {_R}"),
    "classify_cv": (_classified(lambda: shapes.classify_cv(*_c("area", "perimeter", "w", "h"))), f"select {_ID}, case when {_ROT}>6 then 1 when {_ROT}>3 then 4 when {_ROT}>1.5 and {_CIRC}<0.5 then 2 when {_ROT} is not null then 3 end as cls from {_R}"),
    "marking_confidence": (marking_confidence, f"select {_ID}, round(least(1,0.6::double*least(1,area/5000)+0.4::double*least(1,perimeter/500)),3) as confidence from {_R}"),
    "shape_measures": (shape_measures, f"select {_ID}, round({_ASP},9) as aspect, round(4*pi()*area/greatest(perimeter*perimeter,1),9) as circularity, round({_SOL},9) as solidity, round(case when w*h>0 then area/(w*h) else 0 end,9) as extent from {_R}"),
    "count_by_type": (count_by_type, f"select {_T2} as type, count(*) as n from ({_V2}) group by 1"),
    "mask_class_pixels": (mask_class_pixels, f"""with k as (select case when {_ROT}>6 then 'lane_line' when {_ROT}>3 then 'stop_line' when {_ROT}>1.5 then 'crosswalk' when {_ROT} is not null then 'arrow' end as class_name from {_R})
select class_name, count(*) as pixels, round(100.0::double*count(*)/(select count(*) from k),2) as percentage from k where class_name is not null group by 1"""),
    "feature_geojson": (feature_geojson, f"""select video_id, (row_number() over (partition by video_id order by event_id)-1)::int as id, format('{','.join(['{:.11f} {:.11f}'] * 5)}', {_RING}) as ring,
round((w*h)::double,1) as area_pixels, x+w//2 as center_x, y+h//2 as center_y from {SQL['detections']}"""),
}
