"""Queries of detections, tracks and heatmaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from laneatlas.functions import boxes, geo
from laneatlas.operators import heatmap as H
from laneatlas.operators import spatial
from laneatlas.operators import traffic as T
from laneatlas.sources.adapters import SQL, view
from laneatlas.sources.locations import NYC, with_bounds

G, W, HT = 50, 640, 480
BOUNDS = geo.bounds_literal
_A, _B, _C, _D = NYC


def _counts(spark, d):
    return T.density(view(spark, d, "heat_points"), "px", "py", W, HT, G)


def frame_sample(spark, d):
    return T.sample_frames(view(spark, d, "tracks"), 5, 3000)


def detection_filter(spark, d):
    return T.plausible_detections(view(spark, d, "detections"))


def iou_pairs(spark, d):
    return T.consecutive_overlaps(view(spark, d, "detections")).withColumn("iou", F.round("iou", 6))


def iou_best_per_det(spark, d):
    p = T.consecutive_overlaps(view(spark, d, "detections")).withColumn("iou", F.round("iou", 6))
    return p.groupBy("b_id").agg(F.min(F.struct((-F.col("iou")).alias("m"), F.col("a_id"))).alias("s")).select("b_id", F.col("s.a_id").alias("a_id"), (-F.col("s.m")).alias("iou"))


def greedy_matches(spark, d):
    return spatial.greedy_matches(iou_pairs(spark, d), ["video_id", "frame_id"], "a_id", "b_id", "iou")


def eligible_tracks(spark, d):
    """Positions are those of every third event, which leaves tracks on both sides of the bounds."""
    return T.eligible(view(spark, d, "tracks").where("frame_idx % 3 = 0"))


def unmatched_detections(spark, d):
    det = view(spark, d, "detections")
    return det.join(T.consecutive_overlaps(det).select(F.col("b_id").alias("event_id")), "event_id", "left_anti").select("event_id", "video_id", "frame_id")


def unmatched_tracks(spark, d):
    det = view(spark, d, "detections")
    return det.join(T.consecutive_overlaps(det).select(F.col("a_id").alias("event_id")), "event_id", "left_anti").select("event_id")


def ids_lost_next_frame(spark, d):
    seen = view(spark, d, "tracks").select((F.floor(F.col("frame_idx") / 100)).cast("long").alias("step"), "track_id").distinct()
    top = seen.agg(F.max("step").alias("top"))
    after = seen.select((F.col("step") - 1).alias("step"), "track_id")
    return seen.join(after, ["step", "track_id"], "left_anti").crossJoin(F.broadcast(top)).where("step < top").select("step", "track_id")


def displacement(spark, d):
    return T.displacements(view(spark, d, "tracks")).select("track_id", "frame_idx", "dx", "dy")


def gap_since_seen(spark, d):
    return T.displacements(view(spark, d, "tracks")).where("gap is not null").select("track_id", "frame_idx", "gap", (F.col("gap") > 30).alias("stale"))


def velocity_ema(spark, d):
    return T.velocities(view(spark, d, "tracks")).select("track_id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


def path_length(spark, d):
    return T.path_lengths(view(spark, d, "tracks")).select("track_id", F.round("length", 6).alias("length"), "n_points")


def last_position(spark, d):
    return view(spark, d, "tracks").groupBy("track_id").agg(F.max_by("px", "frame_idx").alias("px"), F.max_by("py", "frame_idx").alias("py"), F.max("frame_idx").alias("last_seen"))


def traffic_statistics(spark, d):
    t = view(spark, d, "tracks")
    paths = t.groupBy("track_id").agg(F.count("*").alias("n")).where("n > 5")
    return paths.agg(F.count("*").alias("total_paths"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("average_path_length")).crossJoin(F.broadcast(t.agg(F.countDistinct("frame_idx").alias("frames_processed")))).withColumn("grid_size", F.lit(G))


def density_grid(spark, d):
    return T.density(view(spark, d, "tracks"), "px", "py", W, HT, G)


def flow_field(spark, d):
    f = T.flow(view(spark, d, "tracks"), W, HT, G)
    return f.select("gy", "gx", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


def box_centres(spark, d):
    det = view(spark, d, "detections")
    c = boxes.centre(F.struct("x", "y", "w", "h"))
    return det.select("event_id", c["cx"].alias("cx"), c["cy"].alias("cy"), (F.col("w") * F.col("h")).alias("area"))


def density_heatmap(spark, d):
    cells = H.heatmap(_counts(spark, d), G, blur=0)
    return H.points(cells, G, BOUNDS(*NYC))


def smoothed_heatmap(spark, d):
    return H.heatmap(_counts(spark, d), G, 11).select("gy", "gx", F.round("v", 6).alias("v"))


def heatmap_stats(spark, d):
    s = H.statistics(H.heatmap(_counts(spark, d), G, 11))
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns[:3]], "total_points")


def road_heatmap(spark, d):
    cells = H.heatmap(_counts(spark, d), G, blur=0)
    return H.points(cells, G, geo.road_bounds(BOUNDS(*NYC), ratio=0.4))


def heatmap_cells_geojson(spark, d):
    cells = H.heatmap(_counts(spark, d), G, blur=0).where("v >= 0.5")
    ring = F.transform(geo.cell_ring(F.col("gy"), F.col("gx"), G, BOUNDS(*NYC)), lambda p: F.concat_ws(" ", *[F.format_string("%.7f", p[i]) for i in (0, 1)]))
    return cells.select("gy", "gx", F.round("v", 4).alias("intensity"), F.array_join(ring, ",").alias("ring"))


def render_points(spark, d):
    v = H.heatmap(_counts(spark, d), G, blur=0)
    z = 14
    radius = min(30, max(8, 2 * z)) * (0.5 + 0.5 * F.col("v"))
    return v.select("gy", "gx", F.round(radius, 6).alias("radius"), F.round(F.least(F.lit(0.8), 0.9 * F.col("v")), 6).alias("alpha"), F.round(60 * (1 - F.col("v")), 6).alias("hue"))


def demo_heatmap(spark, d):
    """What is fixed about the invented points of each area: their number, their range and the statistics stated with them."""
    doc = H.demo_documents(with_bounds(view(spark, d, "areas")).select("id", "bounds"))
    b = F.col("bounds")
    inside = F.forall("points", lambda p: p["lat"].between(b["min_lat"], b["max_lat"]) & p["lon"].between(b["min_lon"], b["max_lon"]) & p["intensity"].between(0.3, 1.0))
    return doc.select("id", "grid_size", "statistics.*", inside.alias("inside"))


def heatmap_fine(spark, d):
    """The smoothed map down to a thousandth."""
    return H.heatmap(_counts(spark, d), G, 11).where("v >= 0.001").select("gy", "gx", F.round("v", 6).alias("v"))


def live_ids(spark, d):
    """Ids lost from one step to the next that come back later."""
    seen = view(spark, d, "tracks").select((F.floor(F.col("frame_idx") / 100)).cast("long").alias("step"), "track_id").distinct()
    return T.still_live(ids_lost_next_frame(spark, d), seen)


def predicted_position(spark, d):
    return T.predicted(view(spark, d, "tracks"))


def rank_cells(spark, d):
    """Extension: the ten fullest cells of each camera."""
    det = view(spark, d, "detections")
    c = det.select("video_id", geo.cell(F.col("y"), HT, 10).alias("gy"), geo.cell(F.col("x"), W, 10).alias("gx")).groupBy("video_id", "gy", "gx").agg(F.count("*").alias("n"))
    w = Window.partitionBy("video_id").orderBy(F.desc("n"), "gy", "gx")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


_CELL = lambda p, s: f"least({G - 1}, greatest(0, cast(floor({p}/{s}.0::double*{G}) as int)))"
_N = f"(select {_CELL('py', HT)} as gy, {_CELL('px', W)} as gx, count(*) as n from {SQL['heat_points']} group by 1, 2)"
_V = f"(select gy, gx, n::double/(select max(n) from {_N}) as v from {_N})"
_W11 = "exp(-(d*d)/8.0::double)"  # a deviation of 2 for 11 cells
_K = f"(select (case when t+d < 0 then -(t+d) when t+d > 49 then 98-(t+d) else t+d end)::int as s, t::int as t, sum({_W11})/(select sum({_W11}) from range(-5,6) z(d)) as k from range(50) a(t), range(-5,6) b(d) group by 1, 2) k"
_S0 = f"(select b.t as gy, a.gx, sum(a.v*b.k) as v from (select gy, k.t as gx, sum(v*k.k) as v from {_V} join {_K} on gx = k.s group by 1, 2) a join (select * from {_K}) b on a.gy = b.s group by 1, 2)"
_S = f"(select gy, gx, v/(select max(v) from {_S0}) as v from {_S0})"


def _placed(v: str, b: tuple) -> str:
    a, c, e, f = (f"({x})" for x in b)
    return f"select round({c}-(gy+0.5::double)/{G}*({c}-{a}),6) as lat, round({e}+(gx+0.5::double)/{G}*({f}-{e}),6) as lon, round(v,4) as intensity from {v} where v >= 0.01"


_LIT = tuple(f"{x!r}::double" for x in NYC)
_NEG = tuple(f"({x!r})::double" for x in NYC)
_LATS, _LONS = f"({_NEG[1]}-{_NEG[0]})", f"({_NEG[3]}-{_NEG[2]})"
_ROAD = (
    f"{_NEG[0]}+{_LATS}*0.5::double-{_LATS}*0.4::double/2", f"{_NEG[0]}+{_LATS}*0.5::double+{_LATS}*0.4::double/2",
    f"{_NEG[2]}+{_LONS}*0.5::double-{_LONS}*0.4::double/2", f"{_NEG[2]}+{_LONS}*0.5::double+{_LONS}*0.4::double/2",
)
_DET = SQL["detections"]
_IOU = f"""(select b.video_id, b.frame_id, a.event_id as a_id, b.event_id as b_id,
 (least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))::double as i, a.w*a.h+b.w*b.h as s
 from {_DET} a join {_DET} b on a.video_id=b.video_id and b.frame_id=a.frame_id+1
 where least(a.x+a.w,b.x+b.w)>greatest(a.x,b.x) and least(a.y+a.h,b.y+b.h)>greatest(a.y,b.y))"""
_PAIRS = f"(select video_id, frame_id, a_id, b_id, round(i/(s-i),6) as iou from {_IOU} where i/(s-i) >= 0.3)"
_TR = SQL["tracks"]
_DISP = f"(select *, px-lag(px) over w as dx, py-lag(py) over w as dy, frame_idx-lag(frame_idx) over w as gap from {_TR} window w as (partition by track_id order by frame_idx))"
_EMA = "sum(0.3::double*pow(0.7::double, j)*{c})"

QUERIES = {
    "density_heatmap": (density_heatmap, _placed(_V, _NEG)),
    "road_heatmap": (road_heatmap, _placed(_V, _ROAD)),
    "smoothed_heatmap": (smoothed_heatmap, f"select gy, gx, round(v,6) as v from {_S}"),
    "heatmap_stats": (heatmap_stats, f"select round(max(v),4) as max_intensity, round(min(v) filter (where v>0),4) as min_intensity, round(avg(v) filter (where v>0),4) as mean_intensity, count(*) filter (where v>=0.01) as total_points from {_S}"),
    "heatmap_cells_geojson": (heatmap_cells_geojson, f"""with c as (select gy, gx, round(v,4) as intensity, {_NEG[2]}+gx*({_LONS}/{G}) as w, {_NEG[1]}-gy*({_LATS}/{G}) as n from {_V} where v >= 0.5), e as (select *, w+{_LONS}/{G} as e, n-{_LATS}/{G} as s from c)
select gy, gx, intensity, format('{{:.7f}} {{:.7f}},{{:.7f}} {{:.7f}},{{:.7f}} {{:.7f}},{{:.7f}} {{:.7f}},{{:.7f}} {{:.7f}}', w,s,e,s,e,n,w,n,w,s) as ring from e"""),
    "render_points": (render_points, f"select gy, gx, round(28*(0.5::double+0.5::double*v),6) as radius, round(least(0.8::double,0.9::double*v),6) as alpha, round(60*(1-v),6) as hue from {_V}"),
    "demo_heatmap": (demo_heatmap, f"select id, 50 as grid_size, 1.0::double as max_intensity, 0.3::double as min_intensity, 0.65::double as mean_intensity, 200::bigint as total_points, 0 as frames_processed, true as inside from {SQL['areas']}"),
    "heatmap_fine": (heatmap_fine, f"select gy, gx, round(v,6) as v from {_S} where v >= 0.001"),
    "live_ids": (live_ids, f"""with s as (select distinct frame_idx//100 as step, track_id from {_TR}) select step, track_id from s where step < (select max(step) from s) and not exists (select 1 from s n where n.step=s.step+1 and n.track_id=s.track_id)
and exists (select 1 from s n where n.step>s.step and n.track_id=s.track_id)"""),
    "predicted_position": (predicted_position, f"""with s as (select track_id, dx, dy, row_number() over (partition by track_id order by frame_idx desc)-1 as j from {_DISP} where dx is not null),
v as (select track_id, {_EMA.format(c='dx')} as vx, {_EMA.format(c='dy')} as vy from s group by track_id), l as (select track_id, arg_max(px, frame_idx) as px, arg_max(py, frame_idx) as py from {_TR} group by track_id)
select l.track_id, trunc(px+coalesce(vx,0))::int as px, trunc(py+coalesce(vy,0))::int as py from l left join v on l.track_id=v.track_id"""),
    "frame_sample": (frame_sample, f"select * from {_TR} where frame_idx < 3000 and frame_idx % 5 = 0"),
    "detection_filter": (detection_filter, f"select * from {_DET} where w*h between 500 and 50000 and (case when h>0 then w::double/h else 0 end) between 0.2 and 5"),
    "box_centres": (box_centres, f"select event_id, x+w//2 as cx, y+h//2 as cy, w*h as area from {_DET}"),
    "iou_pairs": (iou_pairs, f"select * from {_PAIRS}"),
    "iou_best_per_det": (iou_best_per_det, f"select b_id, arg_min(a_id, (-iou, a_id)) as a_id, max(iou) as iou from {_PAIRS} group by b_id"),
    "greedy_matches": (greedy_matches, f"""with recursive p as (select *, row_number() over (partition by video_id, frame_id order by iou desc, a_id, b_id) as i from {_PAIRS}),
g as (select video_id, frame_id, 0::bigint as i, []::bigint[] as a, []::bigint[] as b, null::bigint as a_id, null::bigint as b_id, null::double as iou from (select distinct video_id, frame_id from p)
union all select p.video_id, p.frame_id, p.i, case when list_contains(g.a, p.a_id) or list_contains(g.b, p.b_id) then g.a else list_append(g.a, p.a_id) end,
case when list_contains(g.a, p.a_id) or list_contains(g.b, p.b_id) then g.b else list_append(g.b, p.b_id) end,
case when list_contains(g.a, p.a_id) or list_contains(g.b, p.b_id) then null else p.a_id end, p.b_id, p.iou from g join p on p.video_id=g.video_id and p.frame_id=g.frame_id and p.i=g.i+1)
select video_id, frame_id, a_id, b_id, iou from g where a_id is not null"""),
    "eligible_tracks": (eligible_tracks, f"select track_id, count(*) as n, count(*)>=2 as in_density, count(*)>5 as is_path from {_TR} where frame_idx%3=0 group by 1"),
    "unmatched_detections": (unmatched_detections, f"select event_id, video_id, frame_id from {_DET} where event_id not in (select b_id from {_PAIRS})"),
    "unmatched_tracks": (unmatched_tracks, f"select event_id from {_DET} where event_id not in (select a_id from {_PAIRS})"),
    "ids_lost_next_frame": (ids_lost_next_frame, f"""with s as (select distinct frame_idx//100 as step, track_id from {_TR}) select step, track_id from s where step < (select max(step) from s) and not exists (select 1 from s n where n.step=s.step+1 and n.track_id=s.track_id)"""),
    "displacement": (displacement, f"select track_id, frame_idx, dx, dy from {_DISP}"),
    "gap_since_seen": (gap_since_seen, f"select track_id, frame_idx, gap, gap > 30 as stale from {_DISP} where gap is not null"),
    "velocity_ema": (velocity_ema, f"""with s as (select track_id, dx, dy, row_number() over (partition by track_id order by frame_idx desc)-1 as j from {_DISP} where dx is not null)
select track_id, round({_EMA.format(c='dx')},6) as vx, round({_EMA.format(c='dy')},6) as vy from s group by track_id"""),
    "path_length": (path_length, f"select track_id, round(coalesce(sum(sqrt(dx*dx+dy*dy)),0),6) as length, count(*) as n_points from {_DISP} group by track_id"),
    "last_position": (last_position, f"select track_id, arg_max(px, frame_idx) as px, arg_max(py, frame_idx) as py, max(frame_idx) as last_seen from {_TR} group by track_id"),
    "traffic_statistics": (traffic_statistics, f"select count(*) as total_paths, round(coalesce(avg(n),0),6) as average_path_length, (select count(distinct frame_idx) from {_TR}) as frames_processed, {G} as grid_size from (select track_id, count(*) as n from {_TR} group by 1 having count(*) > 5)"),
    "density_grid": (density_grid, f"select {_CELL('py', HT)} as gy, {_CELL('px', W)} as gx, count(*) as n from {_TR} group by 1, 2"),
    "flow_field": (flow_field, f"""with c as (select {_CELL('py', HT)} as gy, {_CELL('px', W)} as gx, sum(dx)::double as x, sum(dy)::double as y from {_DISP} where dx is not null group by 1, 2),
m as (select *, case when x=0 and y=0 then 1 else sqrt(x*x+y*y) end as m from c) select gy, gx, round(x/m,6) as vx, round(y/m,6) as vy from m"""),
    "rank_cells": (rank_cells, f"""with c as (select video_id, least(9,greatest(0,cast(floor(y/480.0::double*10) as int))) as gy, least(9,greatest(0,cast(floor(x/640.0::double*10) as int))) as gx, count(*) as n from {_DET} group by 1,2,3),
r as (select *, row_number() over (partition by video_id order by n desc, gy, gx) as rank from c) select video_id, gy, gx, n, rank::int as rank from r where rank <= 10"""),
}
