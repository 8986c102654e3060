"""Legs, profiles, metrics and positions of tracks and routes."""

from pyspark.sql import functions as F

from seaway.operators import tracks
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.views import table, view

TK = ["track_id"]
_PT = """(SELECT *, lag(lon) OVER w AS x1, lag(lat) OVER w AS y1, lag(lon, 2) OVER w AS x0, lag(lat, 2) OVER w AS y0,
  lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, lead(lon, 2) OVER w AS x3, lead(lat, 2) OVER w AS y3 FROM {} WINDOW w AS (PARTITION BY {} ORDER BY seq))"""
TRK, RTE = _PT.format("v_track_points", "track_id"), _PT.format("v_routes", "route_id")


def r(df, **digits):
    return df.withColumns({k: F.round(k, d) for k, d in digits.items()})


@register("route_profile", f"""SELECT route_id, seq, round(seg, 3) AS seg_m, round(sum(seg) OVER (PARTITION BY route_id ORDER BY seq), 2) AS cum_m
  FROM (SELECT *, coalesce({S.hav_m('x1', 'y1', 'lon', 'lat')}, 0) AS seg FROM {RTE})""")
def route_profile(spark, sf):
    return r(tracks.route_profile(view(spark, sf, "v_routes")), seg_m=3, cum_m=2).select("route_id", "seq", "seg_m", "cum_m")


@register("route_legs", f"""SELECT track_id, seq, round(km, 6) AS leg_km, round(b1, 4) AS bearing_in, round(b2, 4) AS bearing_out, round({S.turn('b1', 'b2')}, 4) AS turn,
  CASE WHEN b2 IS NULL THEN NULL WHEN d < 1 OR d > 359 THEN 'STRAIGHT' WHEN d < 180 THEN 'STBD' ELSE 'PORT' END AS side
  FROM (SELECT *, fmod(b2 - b1 + 360, 360) AS d FROM (SELECT *, {S.hav_km('lon', 'lat', 'x2', 'y2')} AS km, {S.bearing('lon', 'lat', 'x2', 'y2')} AS b1,
  {S.bearing('x2', 'y2', 'x3', 'y3')} AS b2 FROM {TRK} WHERE x2 IS NOT NULL))""")
def route_legs(spark, sf):
    x = tracks.route_legs(view(spark, sf, "v_track_points"), TK)
    return r(x, leg_km=6, bearing_in=4, bearing_out=4, turn=4).select("track_id", "seq", "leg_km", "bearing_in", "bearing_out", "turn", "side")


@register("route_length", f"""SELECT route_id, round(coalesce(sum({S.hav_km('x1', 'y1', 'lon', 'lat')}), 0), 4) AS km, round(coalesce(sum({S.hav_km('x1', 'y1', 'lon', 'lat')}), 0) / 1.852e0, 4) AS nm,
  COUNT(*) - 1 AS segments, COUNT(*) AS points FROM {RTE} GROUP BY 1""")
def route_length(spark, sf):
    return r(tracks.route_length(view(spark, sf, "v_routes")), km=4, nm=4)


_QM = f"""WITH q AS (SELECT track_id, COUNT(*) AS n_points, coalesce(sum({S.hav_km('x1', 'y1', 'lon', 'lat')}), 0) AS length_km,
  coalesce(max({S.turn(S.bearing('x0', 'y0', 'x1', 'y1'), S.bearing('x1', 'y1', 'lon', 'lat'))}), 0) AS max_turn,
  coalesce(sum({S.turn(S.bearing('x0', 'y0', 'x1', 'y1'), S.bearing('x1', 'y1', 'lon', 'lat'))}), 0) AS turns,
  arg_min(lon, seq) AS ax, arg_min(lat, seq) AS ay, arg_max(lon, seq) AS bx, arg_max(lat, seq) AS b_y FROM {TRK} GROUP BY 1),
 d AS (SELECT *, {S.hav_km('ax', 'ay', 'bx', 'b_y')} AS direct_km FROM q)
SELECT track_id, n_points, round(length_km, 4) AS length_km, round(max_turn, 4) AS max_turn, round(direct_km, 4) AS direct_km,
 round(CASE WHEN direct_km > 0 THEN length_km / direct_km ELSE 1 END, 5) AS tortuosity,
 round(CASE WHEN n_points > 2 THEN turns / (n_points - 2) ELSE 0 END, 4) AS mean_turn FROM d"""


@register("quality_metrics", _QM)
def quality_metrics(spark, sf):
    x = tracks.quality_metrics(view(spark, sf, "v_track_points"), TK)
    return r(x, length_km=4, max_turn=4, direct_km=4, tortuosity=5, mean_turn=4)


_VP = f"""WITH l AS (SELECT track_id, {S.hav_km('lon', 'lat', 'x2', 'y2')} / 1.852e0 AS nm, (lat + y2) / 2 AS mid FROM {TRK} WHERE x2 IS NOT NULL),
 z AS (SELECT track_id, sum(nm) AS t, coalesce(sum(nm) FILTER (mid > -50), 0) AS o, coalesce(sum(nm) FILTER (mid > -60 AND mid <= -50), 0) AS s, coalesce(sum(nm) FILTER (mid <= -60), 0) AS p FROM l GROUP BY 1)
SELECT track_id, {S.js_round('t * 1.852e0', 1)} AS total_km, {S.js_round('t', 1)} AS total_nm, {S.js_round('o', 1)} AS open_nm, {S.js_round('s', 1)} AS sub_nm, {S.js_round('p', 1)} AS polar_nm,
 {S.js_round('t / 15', 1)} AS nominal_h, {S.js_round('(o / 15 + s / 12 + p / 8.5e0)', 1)} AS adjusted_h, {S.js_round('((o / 15 + s / 12) / 24 * 35 + p / 8.5e0 / 24 * 48)', 1)} AS fuel_t FROM z"""


@register("voyage_profile", _VP)
def voyage_profile(spark, sf):
    return tracks.voyage_profile(view(spark, sf, "v_track_points"), TK)


@register("arrival_schedule", f"""WITH l AS (SELECT route_id, seq, coalesce({S.hav_km('x1', 'y1', 'lon', 'lat')} / 1.852e0 / CASE WHEN (lat + y1) / 2 <= -60 THEN 8.5e0 WHEN (lat + y1) / 2 <= -50 THEN 12 ELSE 15 END, 0) AS h FROM {RTE}),
 c AS (SELECT route_id, seq, sum(h) OVER (PARTITION BY route_id ORDER BY seq) AS cum FROM l)
SELECT route_id, seq, round(cum, 5) AS cum_h, o_orderdate + to_seconds(CAST(floor(cum * 3600 + 0.5) AS BIGINT)) AS arrival FROM c JOIN orders ON o_orderkey = route_id""")
def arrival_schedule(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_orderdate").cast("timestamp").alias("start"))
    x = tracks.arrival_schedule(view(spark, sf, "v_routes").join(o, "route_id"), F.col("start"))
    return r(x, cum_h=5).select("route_id", "seq", "cum_h", "arrival")


_DST = f"ceil({S.hav_km('lon', 'lat', 'x2', 'y2')} / 40)"
_LX, _LY = S.slerp("lon", "lat", "x2", "y2", "(step / n)")


@register("densify", f"""WITH a AS (SELECT *, CASE WHEN x2 IS NULL THEN 1 ELSE greatest(1, {_DST}) END AS n FROM {RTE}),
 b AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS step FROM a)
SELECT route_id, seq, step, round(CASE WHEN step = 0 THEN lon ELSE {_LX} END, 5) AS lon, round(CASE WHEN step = 0 THEN lat ELSE {_LY} END, 5) AS lat FROM b""")
def densify(spark, sf):
    return r(tracks.densify(view(spark, sf, "v_routes"), 40.0), lon=5, lat=5)


def _parts(spark, sf):
    return view(spark, sf, "v_track_points").withColumn("part_no", F.floor(F.col("seq") / 9))


@register("seam_gaps", f"""SELECT track_id, coalesce(bool_or(seq % 9 = 0 AND NOT (abs(abs(x1) - 180) <= 1 AND abs(abs(lon) - 180) <= 1 AND abs(y1 - lat) <= 5)
  AND {S.hav_km('x1', 'y1', 'lon', 'lat')} > 80), false) AS broken FROM {TRK} GROUP BY 1""")
def seam_gaps(spark, sf):
    return tracks.seam_gaps(_parts(spark, sf), 80.0, TK)


@register("first_last_fix", """SELECT track_id, COUNT(*) AS n, arg_min(lon, seq) AS lon_a, arg_min(lat, seq) AS lat_a, arg_max(lon, seq) AS lon_b, arg_max(lat, seq) AS lat_b, arg_max(ts, seq) AS last_ts
  FROM v_track_points GROUP BY 1""")
def first_last_fix(spark, sf):
    x = tracks.first_last_fix(view(spark, sf, "v_track_points"))
    return x.select("track_id", "n", F.col("first.lon").alias("lon_a"), F.col("first.lat").alias("lat_a"), F.col("last.lon").alias("lon_b"),
                    F.col("last.lat").alias("lat_b"), F.col("last.ts").alias("last_ts"))


@register("progress_rows", f"""
WITH p AS (SELECT route_id, seq, lon, lat, sum(seg) OVER (PARTITION BY route_id ORDER BY seq) AS c FROM (SELECT *, coalesce({S.hav_m('x1', 'y1', 'lon', 'lat')}, 0) AS seg FROM {RTE})),
 s AS (SELECT *, lead(c) OVER w AS c2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, max(c) OVER (PARTITION BY route_id) AS total, COUNT(*) OVER (PARTITION BY route_id) AS n FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
 m AS (SELECT o_orderkey AS mark_id, o_orderkey AS route_id, o_totalprice * 2 - 60000 AS at_m FROM orders),
 j AS (SELECT m.mark_id, s.*, least(greatest(at_m, 0), total) AS d, at_m >= total AND at_m > 0 AS done FROM m JOIN s USING (route_id) WHERE lon2 IS NOT NULL AND total > 0 AND
  CASE WHEN at_m <= 0 THEN seq = 1 WHEN at_m >= total THEN seq = n - 1 ELSE at_m > c AND at_m <= c2 END),
 f AS (SELECT *, CASE WHEN done THEN 1 WHEN c2 > c AND d > 0 THEN (d - c) / (c2 - c) ELSE 0 END AS f FROM j)
SELECT mark_id, route_id, seq - 1 AS segment, round(lon + (lon2 - lon) * f, 5) AS lon, round(lat + (lat2 - lat) * f, 5) AS lat, round({S.bearing('lon', 'lat', 'lon2', 'lat2')}, 4) AS heading,
 round(d, 2) AS traveled_m, round(total - d, 2) AS remaining_m, round(d / total * 100, 5) AS percent, done AS completed FROM f""")
def progress_rows(spark, sf):
    marks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mark_id"), F.col("o_orderkey").alias("route_id"),
                                              (F.col("o_totalprice") * 2 - 60000).alias("at_m"))
    x = tracks.progress(tracks.route_profile(view(spark, sf, "v_routes")), marks)
    return r(x, lon=5, lat=5, heading=4, traveled_m=2, remaining_m=2, percent=5)
