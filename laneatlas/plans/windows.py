"""Extensions: event-time windows and grouping sets over the events, and the tracker."""

from __future__ import annotations

from pyspark.sql import functions as F

from laneatlas.sources.adapters import SQL, stream, table, view
from laneatlas.streaming import density as D
from laneatlas.streaming import tracker


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def tumbling_counts(spark, d):
    g = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(_stamp("w.start").alias("start"), "event_type", "n")


def sliding_counts(spark, d):
    g = _events(spark, d).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(_stamp("w.start").alias("start"), "n")


def session_counts(spark, d):
    g = _events(spark, d).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", _stamp("w.start").alias("start"), "n")


def rollup_type_hour(spark, d):
    e = _events(spark, d).withColumn("hour", F.hour("ts"))
    return e.rollup("event_type", "hour").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def track_vehicles(spark, d):
    return tracker.track(view(spark, d, "detections"))


def tracked_density(spark, d):
    return tracker.density(tracker.track(view(spark, d, "detections")), 640, 480, 50)


def _lives(spark, d):
    return tracker.track(view(spark, d, "sightings"))


def track_lives(spark, d):
    """Boxes that always overlap: a track ends where no frame holds it for more than thirty."""
    return _lives(spark, d).groupBy("video_id", "track_id").agg(
        F.min("frame_id").alias("first"), F.max(F.when(F.col("seen"), F.col("frame_id"))).alias("last"), F.max("n_positions").alias("n_positions"),
        F.count("*").alias("frames"), F.sum((~F.col("seen")).cast("long")).alias("unseen"))


def lives_density(spark, d):
    """Their density and summed velocities, frames that do not hold them included. Sums may lie between two roundings: both are told apart on one side."""
    return tracker.density(_lives(spark, d), 640, 480, 50, digits=None).select("gy", "gx", "n", *[F.round(F.col(c) + 3e-10, 6).alias(c) for c in ("vx", "vy")])


def clocked_lives(spark, d):
    """The same against a clock that runs over all frames to the end: what ended there stays alive for thirty frames more. The clock is one row a video."""
    seen = view(spark, d, "sightings")
    end = seen.agg(F.max("frame_id").alias("frame_id"))
    t = tracker.track(seen, until=seen.select("video_id").distinct().crossJoin(F.broadcast(end)))
    return t.groupBy("video_id").agg(F.countDistinct("track_id").alias("tracks"), F.count("*").alias("frames"), F.max("frame_id").alias("until"))


def stream_lives(spark, d):
    """track_lives as a stream with map state."""
    tracks = tracker.track_stream(stream(spark, d, "sightings"))
    seen = D.drained(tracks.select("video_id", "track_id", "n_positions"), "append")
    return seen.groupBy("video_id", "track_id").agg(F.max("n_positions").alias("n_positions"), F.count("*").alias("frames"))


def stream_density(spark, d):
    """The grid of the heat points, counted by a stream."""
    return D.drained(D.stream_density(stream(spark, d, "heat_points"), 640, 480, 50))


def stream_tracks(spark, d):
    """The tracker as a stream: positions seen so far of each live track."""
    tracks = tracker.track_stream(stream(spark, d, "detections"))
    return D.drained(tracks.select("video_id", "frame_id", "track_id", "n_positions", "seen"), "append")


_C = lambda p, s: f"least(49, greatest(0, cast(floor({p}/{s}.0::double*50) as int)))"
_LIFE = f"""with s as (select *, x+w//2 as cx, y+h//2 as cy, lag(frame_id) over v as p, lead(frame_id) over v as q from {SQL['sightings']} window v as (partition by video_id order by frame_id)),
i as (select *, sum(case when frame_id-p > 31 then 1 else 0 end) over (partition by video_id order by frame_id) as track_id, case when q is null then {{last}} else least(31, q-frame_id) end as held from s)"""
_LIVES = _LIFE.format(last="1")
QUERIES = {
    "track_lives": (track_lives, f"{_LIVES} select video_id, track_id::int as track_id, min(frame_id) as first, max(frame_id) as last, count(*)::int as n_positions, sum(held)::bigint as frames, (sum(held)-count(*))::bigint as unseen from i group by 1,2"),
    "stream_lives": (stream_lives, f"{_LIVES} select video_id, track_id::int as track_id, count(*)::int as n_positions, sum(held)::bigint as frames from i group by 1,2"),
    "clocked_lives": (clocked_lives, f"{_LIFE.format(last='least(31, (select max(frame_id) from s)-frame_id+1)')} select video_id, count(distinct track_id) as tracks, sum(held)::bigint as frames, max(frame_id+held-1) as until from i group by 1"),
    "lives_density": (lives_density, f"""{_LIVES}, d as (select *, row_number() over v as k, cx-lag(cx) over v as dx, cy-lag(cy) over v as dy from i window v as (partition by video_id, track_id order by frame_id)),
e as (select a.video_id, a.frame_id, sum(0.3::double*pow(0.7::double, a.k-b.k)*b.dx) as vx, sum(0.3::double*pow(0.7::double, a.k-b.k)*b.dy) as vy from d a join d b on a.video_id=b.video_id and a.track_id=b.track_id and b.k between 2 and a.k group by 1,2)
select {_C('cy', 480)} as gy, {_C('cx', 640)} as gx, sum(held)::bigint as n, round(sum(held*vx)+3e-10::double,6) as vx, round(sum(held*vy)+3e-10::double,6) as vy from d join e using (video_id, frame_id) group by 1,2"""),
    "stream_density": (stream_density, f"select {_C('py', 480)} as gy, {_C('px', 640)} as gx, count(*) as n from {SQL['heat_points']} group by 1, 2"),
    "stream_tracks": (stream_tracks, None),
    "tumbling_counts": (tumbling_counts, "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1,2"),
    "sliding_counts": (sliding_counts, "select strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events, (values (0),(1)) v(k) group by 1"),
    "session_counts": (session_counts, """with a as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as f from events window w as (partition by user_id order by ts)),
b as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from b group by user_id, s"""),
    "rollup_type_hour": (rollup_type_hour, "select event_type, hour(ts)::int as hour, count(*) as n, round(sum(value),2) as total from events group by rollup(event_type, hour(ts))"),
    "track_vehicles": (track_vehicles, None),
    "tracked_density": (tracked_density, None),
}
