"""Hazard audits and route validation."""

from pyspark.sql import functions as F

from seaway.functions import geo
from seaway.operators import hazards as hz
from seaway.operators import validate as va
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.registry.spatial import SEGS, ring_edges, route_segs
from seaway.registry.tracks import RTE
from seaway.views import view


def outlines(spark, sf):
    b = view(spark, sf, "v_bergs")
    pt = lambda i, x, y: F.struct(F.lit(i).cast("bigint").alias("vidx"), (F.col("lon") + x * F.col("half_lon")).alias("lon"), (F.col("lat") + y * F.col("half_lat")).alias("lat"))
    ring = F.array(pt(0, 1, 0), pt(1, 0, 1), pt(2, -1, 0), pt(3, 0, -1), pt(4, 1, 0))
    return b.select("berg_id", F.explode(ring).alias("v")).select("berg_id", "v.*")


def all_targets(spark, sf):
    """Outlined targets and the last position of every track as a drifting one."""
    b = view(spark, sf, "v_bergs").select("berg_id", "source", "lon", "lat", "fast_ice_status")
    t = view(spark, sf, "v_track_points").groupBy("track_id").agg(F.max_by(F.struct("lon", "lat"), "seq").alias("p"))
    d = t.select((-F.col("track_id") - 1).alias("berg_id"), F.lit("DRIFTING").alias("source"), "p.lon", "p.lat", F.lit(None).cast("string").alias("fast_ice_status"))
    return b.unionByName(d)


def audit(spark, sf):
    return hz.audit_hazards(view(spark, sf, "v_routes"), all_targets(spark, sf), outlines(spark, sf))


_B = "v_bergs"
_HAZ = f"""bt AS (SELECT berg_id, source, lon AS blon, lat AS blat, fast_ice_status FROM {_B} UNION ALL
   SELECT -track_id - 1, 'DRIFTING', arg_max(lon, seq), arg_max(lat, seq), NULL FROM v_track_points GROUP BY track_id),
 ov AS (SELECT berg_id, k AS vidx, lon + half_lon * CASE k WHEN 0 THEN 1 WHEN 2 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS vx,
   lat + half_lat * CASE k WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS vy FROM {_B} CROSS JOIN (SELECT UNNEST([0, 1, 2, 3, 4]) AS k)),
 oe AS (SELECT a.berg_id, a.vx AS ox1, a.vy AS oy1, b.vx AS ox2, b.vy AS oy2 FROM ov a JOIN ov b ON b.berg_id = a.berg_id AND b.vidx = a.vidx + 1),
 tp AS (SELECT berg_id, source, blon, blat, blon AS tlon, blat AS tlat, false AS corner FROM bt WHERE source <> 'TRACKED' UNION ALL
   SELECT berg_id, source, blon, blat, vx, vy, true FROM ov JOIN bt USING (berg_id)),
 lg AS (SELECT route_id, seq, lon1 AS sx1, lat1 AS sy1, lon2 AS sx2, lat2 AS sy2 FROM v_legs),
 nr0 AS (SELECT route_id, seq, sx1, sy1, sx2, sy2, berg_id, source, blon, blat, tlon, tlat, corner FROM lg JOIN tp ON tlat BETWEEN least(sy1, sy2) - 0.5 AND greatest(sy1, sy2) + 0.5
   AND (abs(sx1 - sx2) > 180 OR tlon BETWEEN least(sx1, sx2) - 2 AND greatest(sx1, sx2) + 2 OR tlon + 360 BETWEEN least(sx1, sx2) - 2 AND greatest(sx1, sx2) + 2
     OR tlon - 360 BETWEEN least(sx1, sx2) - 2 AND greatest(sx1, sx2) + 2)),
 nr1 AS (SELECT * FROM {S.point_segment('nr0', ('tlon', 'tlat'), ('sx1', 'sy1'), ('sx2', 'sy2'), 'm', 'route_id, seq, sx1, sy1, sx2, sy2, berg_id, source, blon, blat, corner')} WHERE m <= 25000),
 nr AS (SELECT route_id, berg_id, arg_min(seq, (m, seq)) AS near_seq, min(m) AS m FROM {S.point_segment('nr1', ('blon', 'blat'), ('sx1', 'sy1'), ('sx2', 'sy2'), 'cm', 'route_id, seq, berg_id, source, corner, m')}
   WHERE NOT (corner AND source = 'GROUNDED') OR cm < 37500 GROUP BY 1, 2),
 vin AS (SELECT route_id, seq, berg_id FROM v_routes r JOIN oe ON {S.toggles('r.lon', 'r.lat', 'ox1', 'oy1', 'ox2', 'oy2')} GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1),
 ht AS (SELECT route_id, berg_id, min(hit) AS hit FROM (SELECT route_id, berg_id, greatest(1, seq - 1) AS hit FROM vin UNION ALL
   SELECT route_id, berg_id, seq FROM lg JOIN oe ON greatest(oy1, oy2) >= least(sy1, sy2) AND least(oy1, oy2) <= greatest(sy1, sy2)
     AND {S.planar_cross(('sx1', 'sy1'), ('sx2', 'sy2'), ('ox1', 'oy1'), ('ox2', 'oy2'))}) GROUP BY 1, 2),
 bx AS (SELECT route_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, greatest(0.08, cos(radians(greatest(abs(min(lat)), abs(max(lat)))))) AS k FROM v_routes GROUP BY 1 HAVING COUNT(*) >= 2),
 hz AS (SELECT route_id, berg_id, source, fast_ice_status, hit IS NOT NULL OR m <= 50 AS is_hit, CASE WHEN (hit IS NOT NULL OR m <= 50) AND source <> 'DRIFTING' THEN 0 ELSE m END AS m, coalesce(hit, near_seq) - 1 AS segment
   FROM nr FULL JOIN ht USING (route_id, berg_id) JOIN bt USING (berg_id) JOIN bx USING (route_id)
   WHERE blat BETWEEN y0 - 25e0 / 111 AND y1 + 25e0 / 111 AND blon BETWEEN x0 - least(180, 25e0 / (111 * k)) AND x1 + least(180, 25e0 / (111 * k)))"""


@register("audit_hazards", f"""WITH {_HAZ} SELECT route_id, berg_id, source, CASE WHEN is_hit THEN 'INTERSECTING' ELSE 'NEARBY' END AS relationship, round(m, 2) AS distance_m,
  round(m / 1852e0, 5) AS distance_nm, segment FROM hz""")
def audit_hazards(spark, sf):
    x = audit(spark, sf)
    return x.select("route_id", "berg_id", "source", "relationship", F.round("distance_m", 2).alias("distance_m"), F.round("distance_nm", 5).alias("distance_nm"), "segment")


@register("hazard_summary", f"""WITH {_HAZ} SELECT route_id, COUNT(*) AS total, COUNT(*) FILTER (is_hit) AS intersecting, COUNT(*) FILTER (NOT is_hit) AS nearby,
  {', '.join(f"COUNT(*) FILTER (source = '{s}') AS {s.lower()}, COUNT(*) FILTER (source = '{s}' AND is_hit) AS {s.lower()}_intersecting, COUNT(*) FILTER (source = '{s}' AND NOT is_hit) AS {s.lower()}_nearby" for s in hz.SOURCE_RANK)},
  {', '.join(f"COUNT(*) FILTER (source = 'GROUNDED' AND fast_ice_status = '{s}') AS {s.lower()}_fast_ice" for s in ('Outside', 'Inside', 'Partial'))} FROM hz GROUP BY 1""")
def hazard_summary(spark, sf):
    return hz.hazard_summary(audit(spark, sf), all_targets(spark, sf))


@register("sort_hazards", f"""WITH {_HAZ} SELECT route_id, berg_id, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY m, CASE source WHEN 'TRACKED' THEN 0 WHEN 'GROUNDED' THEN 1 ELSE 2 END, berg_id) AS position FROM hz""")
def sort_hazards(spark, sf):
    return hz.sort_hazards(audit(spark, sf)).select("route_id", "berg_id", "position")


# --- validation ---------------------------------------------------------------------------------


def route_ends(spark, sf):
    p = view(spark, sf, "v_routes").groupBy("route_id").agg(F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"))
    tol = F.when(F.col("route_id") % 4 == 0, 12.0).when(F.col("route_id") % 4 == 1, 4.0).otherwise(1.5)
    return p.select("route_id", F.col("a.lon").alias("dep_lon"), F.col("a.lat").alias("dep_lat"), F.col("b.lon").alias("dest_lon"),
                    (F.col("b.lat") + (F.col("route_id") % 3) * 7e-6).alias("dest_lat"), tol.alias("dep_tol"), F.lit(2.5).alias("dest_tol"),
                    (1 + F.col("route_id") % 2).alias("dep_legs"), F.lit(1).cast("bigint").alias("dest_legs"))


_SX, _SY = S.slerp("x1", "y1", "x2", "y2", "(k / n)")
_PX, _PY = S.slerp("x1", "y1", "x2", "y2", "((k - 1) / n)")
_MX, _MY = S.slerp("ax", "ay", "ux", "uy", "0.5e0")
_TX, _TY = S.slerp("ax", "ay", "ux", "uy", "arc_t")
_CELLJ = " AND ".join(f"floor((least(a{c}, u{c}) - mg) / 2) <= floor(greatest({c}1, {c}2) / 2) AND floor((greatest(a{c}, u{c}) + mg) / 2) >= floor(least({c}1, {c}2) / 2)" for c in "xy")
_JUMP = ("(floor((greatest(ax, ux) - mg) / 2) <= floor(greatest(x1, x2) / 2) OR floor((least(ax, ux) + mg) / 2) >= floor(least(x1, x2) / 2)) "
         "AND floor((least(ay, uy) - mg) / 2) <= floor(greatest(y1, y2) / 2) AND floor((greatest(ay, uy) + mg) / 2) >= floor(least(y1, y2) / 2)")
_FAIL = f"""re AS (SELECT route_id, arg_min(lon, seq) AS fx, arg_min(lat, seq) AS fy, arg_max(lon, seq) AS lx, arg_max(lat, seq) AS ly, COUNT(*) AS np,
   CASE route_id % 4 WHEN 0 THEN 12e0 WHEN 1 THEN 4e0 ELSE 1.5e0 END AS dt FROM v_routes GROUP BY 1),
 ll AS (SELECT route_id, seq, lon1 AS x1, lat1 AS y1, lon2 AS x2, lat2 AS y2, {S.hav_km('lon1', 'lat1', 'lon2', 'lat2')} AS km, seq <= 1 + route_id % 2 AS dep, seq > np - 2 AS dst,
   CASE WHEN seq <= 1 + route_id % 2 THEN fx ELSE lx END AS kx, CASE WHEN seq <= 1 + route_id % 2 THEN fy ELSE ly END AS ky, CASE WHEN seq <= 1 + route_id % 2 THEN dt ELSE 2.5e0 END AS tol
   FROM v_legs JOIN re USING (route_id)),
 l2 AS (SELECT *, greatest(0.6e0, tol * 1.5e0 / 111) AS mg, greatest(1, ceil(km / greatest(2.5e0, least(15e0, 20 * cos(radians((y1 + y2) / 2)))))) AS n FROM ll),
 st AS (SELECT route_id, seq, k, {_PX} AS ax, {_PY} AS ay, {_SX} AS ux, {_SY} AS uy, dep OR dst AS term, kx, ky, tol, mg FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM l2)),
 cd AS (SELECT * FROM st JOIN v_ring_edges e ON {_CELLJ} WHERE abs(ax - ux) <= 180 UNION ALL SELECT * FROM st JOIN v_ring_edges e ON {_JUMP} WHERE abs(ax - ux) > 180),
 c1 AS (SELECT route_id, seq, k, 1 AS kind FROM {S.arc_tests('cd', ('ax', 'ay'), ('ux', 'uy'), ('x1', 'y1'), ('x2', 'y2'))} WHERE arc_sign <> 0 AND (NOT term OR arc_t IS NULL OR {S.hav_km('kx', 'ky', _TX, _TY)} > tol)),
 md AS (SELECT *, {_MX} AS mx, {_MY} AS my FROM st),
 c2 AS (SELECT route_id, seq, k, 2 AS kind FROM md JOIN v_ring_edges e ON {S.toggles('mx', 'my', 'x1', 'y1', 'x2', 'y2')} WHERE NOT term OR {S.hav_km('kx', 'ky', 'mx', 'my')} > tol GROUP BY route_id, seq, k, ring_id HAVING COUNT(*) % 2 = 1),
 ff AS (SELECT route_id, seq, arg_min(kind, (k, kind)) AS kind FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY 1, 2),
 fs AS (SELECT route_id, seq, km, sqrt(pow({S.fold('abs(x2 - x1)')}, 2) + pow(y2 - y1, 2)) AS deg, CASE WHEN (dep OR dst) AND kind = 1 THEN 'Terminal harbor approach segment crosses land/peninsula beyond ' || format('{{:.1f}}', tol) || ' km dock tolerance'
   WHEN dep OR dst THEN 'Terminal harbor approach segment traverses land interior beyond ' || format('{{:.1f}}', tol) || ' km dock tolerance'
   WHEN kind = 1 THEN 'Line segment crosses land boundary polygon' ELSE 'Line segment traverses land polygon interior' END AS reason FROM ff JOIN ll USING (route_id, seq))"""


@register("failing_segments", f"WITH {_FAIL} SELECT route_id, seq, round(km, 5) AS leg_km, round(deg, 6) AS crossing_deg, reason FROM fs")
def failing_segments(spark, sf):
    x = va.failing_segments(view(spark, sf, "v_routes"), route_ends(spark, sf), ring_edges(spark, sf))
    return x.withColumns({"leg_km": F.round("leg_km", 5), "crossing_deg": F.round("crossing_deg", 6)})


_VAL = f"""WITH {_FAIL}, g AS (SELECT route_id, COUNT(*) AS failing, sum(deg) AS deg, arg_min(reason, seq) AS first_reason FROM fs GROUP BY 1),
 v AS (SELECT route_id, np, {S.hav_m('lx', '(ly + (route_id % 3) * 7e-6)', 'lx', 'ly')} AS de, coalesce(failing, 0) AS failing, coalesce(deg, 0) AS deg, first_reason FROM re LEFT JOIN g USING (route_id))"""


def report(spark, sf):
    return va.validate_routes(view(spark, sf, "v_routes"), route_ends(spark, sf), ring_edges(spark, sf))


@register("validate_routes", f"""{_VAL} SELECT route_id, np AS n_points, 0e0 AS dep_error_m, round(de, 3) AS dest_error_m, failing, round(deg, 5) AS crossing_deg, first_reason,
  CASE WHEN np >= 2 AND de < 1 AND failing = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM v""")
def validate_routes(spark, sf):
    return report(spark, sf).withColumns({"dep_error_m": F.round("dep_error_m", 3), "dest_error_m": F.round("dest_error_m", 3), "crossing_deg": F.round("crossing_deg", 5)})


@register("suppress_invalid", f"{_VAL} SELECT route_id, seq FROM v_routes JOIN v USING (route_id) WHERE np >= 2 AND de < 1 AND failing = 0")
def suppress_invalid(spark, sf):
    return va.suppress_invalid(view(spark, sf, "v_routes"), report(spark, sf)).select("route_id", "seq")


@register("crossing_total", f"WITH {_FAIL} SELECT route_id, round(sum(deg), 5) AS crossing_deg FROM fs GROUP BY 1")
def crossing_total(spark, sf):
    x = va.failing_segments(view(spark, sf, "v_routes"), route_ends(spark, sf), ring_edges(spark, sf))
    return x.groupBy("route_id").agg(F.round(F.sum("crossing_deg"), 5).alias("crossing_deg"))


@register("prefer_valid", """SELECT o_custkey AS route_id, arg_min(o_orderkey, (o_orderstatus <> 'F', o_orderkey)) AS variant, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'PASS' ELSE 'FAIL' END AS result FROM orders GROUP BY 1""")
def prefer_valid(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return va.prefer_valid(o.select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("variant"),
                                    F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("result")))


@register("terminal_counts", """SELECT o_orderkey AS route_id, CAST(CASE WHEN o_orderstatus = 'P' THEN greatest(1, o_custkey % 6 - 1) WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS dep_legs,
  CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS BIGINT) AS dest_legs FROM orders""")
def terminal_counts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("route_id"), F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") % 6).alias("dep_approach_points"),
        (F.col("o_orderstatus") == "F").alias("dep_projected"), F.lit(None).cast("bigint").alias("dest_approach_points"), (F.col("o_orderpriority") == "5-LOW").alias("dest_projected"))
    return va.terminal_counts(o).select("route_id", "dep_legs", "dest_legs")


# --- leg and arc safety -----------------------------------------------------------------------------

_U = "(SELECT sid, sx1 AS ax, sy1 AS ay, sx2 AS ux, sy2 AS uy, CASE WHEN sid % 2 = 0 THEN sx1 END AS kx, CASE WHEN sid % 2 = 0 THEN sy1 END AS ky, CASE WHEN sid % 2 = 0 THEN 12e0 ELSE 0e0 END AS tol, CASE WHEN sid % 2 = 0 THEN 0e0 ELSE 12e0 END AS clr, 0.6e0 AS mg FROM " + SEGS + ")"
_UP = f"(SELECT * FROM {_U} s JOIN v_ring_edges e ON {_CELLJ})"
_QX, _QY = S.slerp("ax", "ay", "ux", "uy", "t")
_UCL = (f"(SELECT * FROM {_UP} WHERE kx IS NULL AND greatest(x1, x2) >= least(ax, ux) - clr * 1.1e0 / 111 AND least(x1, x2) <= greatest(ax, ux) + clr * 1.1e0 / 111 "
        "AND greatest(y1, y2) >= least(ay, uy) - clr * 1.1e0 / 111 AND least(y1, y2) <= greatest(ay, uy) + clr * 1.1e0 / 111)")


@register("unsafe_segments", f"""SELECT DISTINCT sid FROM (
  SELECT sid FROM {S.arc_tests(_UP, ('ax', 'ay'), ('ux', 'uy'), ('x1', 'y1'), ('x2', 'y2'))} WHERE arc_sign <> 0 AND (kx IS NULL OR {S.hav_km('kx', 'ky', _TX, _TY)} > tol)
  UNION ALL SELECT sid FROM {S.point_segment(_UCL, ('x1', 'y1'), ('ax', 'ay'), ('ux', 'uy'), 'm', 'sid, clr')} WHERE m < clr * 1000
  UNION ALL SELECT sid FROM (SELECT sid, t FROM (SELECT *, CASE WHEN t = 0.5 THEN (ax + ux) / 2 ELSE {_QX} END AS px, CASE WHEN t = 0.5 THEN (ay + uy) / 2 ELSE {_QY} END AS py
    FROM (SELECT *, unnest(CASE WHEN {S.hav_km('ax', 'ay', 'ux', 'uy')} > 15 THEN [0.25e0, 0.5e0, 0.75e0] ELSE [0.5e0] END) AS t FROM {_U})) p JOIN v_ring_edges e
    ON {S.toggles('px', 'py', 'x1', 'y1', 'x2', 'y2')} WHERE kx IS NULL OR {S.hav_km('kx', 'ky', 'px', 'py')} > tol GROUP BY sid, t, ring_id HAVING COUNT(*) % 2 = 1))""")
def unsafe_segments(spark, sf):
    s = route_segs(spark, sf)
    dock = F.col("sid") % 2 == 0
    s = s.withColumns({"dock_x": F.when(dock, F.col("x1")), "dock_y": F.when(dock, F.col("y1")), "tol_km": F.when(dock, 12.0).otherwise(0.0),
                       "clear_km": F.when(dock, 0.0).otherwise(12.0)})
    return va.unsafe_segments(s, ring_edges(spark, sf))


@register("unsafe_arcs")
def unsafe_arcs(spark, sf):
    """Checked against brute force in the tests."""
    return va.unsafe_arcs(route_segs(spark, sf).withColumn("clear_km", F.lit(2.0)), ring_edges(spark, sf))
