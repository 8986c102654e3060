"""Grid joins against brute-force SQL."""

from pyspark.sql import functions as F

from seaway.operators import spatial as sp
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.session import cut
from seaway.views import view


def ring_edges(spark, sf):
    return view(spark, sf, "v_ring_edges")


def route_segs(spark, sf):
    """All legs as planar segments: a leg over the antimeridian is two of them. ``sid`` is even for the first part of a leg, odd for the second."""
    x = view(spark, sf, "v_legs").select(((F.col("route_id") * 1_000_000 + F.col("seq")) * 2).alias("sid"), F.col("lon1").alias("x1"), F.col("lat1").alias("y1"),
                                         F.col("lon2").alias("x2"), F.col("lat2").alias("y2"), F.col("lon1").alias("_x"))
    x = sp.split_antimeridian(x)
    return x.withColumn("sid", F.col("sid") + F.when(F.col("x1") == F.col("_x"), 0).otherwise(1)).drop("_x")


_OVER = "FROM v_legs WHERE abs(lon1 - lon2) > 180"
_SIDE = "CASE WHEN lon1 < 0 THEN -180e0 ELSE 180e0 END"
SEGS = f"""(SELECT (route_id * 1000000 + seq) * 2 AS sid, lon1 AS sx1, lat1 AS sy1, lon2 AS sx2, lat2 AS sy2 FROM v_legs WHERE abs(lon1 - lon2) <= 180
  UNION ALL SELECT (route_id * 1000000 + seq) * 2, lon1, lat1, {_SIDE}, (lat1 + lat2) / 2e0 {_OVER}
  UNION ALL SELECT (route_id * 1000000 + seq) * 2 + 1, -({_SIDE}), (lat1 + lat2) / 2e0, lon2, lat2 {_OVER})"""


def ports_as_points(spark, sf):
    return view(spark, sf, "v_ports").select(F.col("port_id").alias("pid"), "lon", "lat")


def bergs_as_targets(spark, sf):
    return view(spark, sf, "v_bergs").select(F.col("berg_id").alias("tid"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))


def _inside(rule):
    return (f"SELECT port_id AS pid, ring_id FROM v_ports p JOIN v_ring_edges e ON {S.toggles('p.lon', 'p.lat', 'x1', 'y1', 'x2', 'y2', rule)} "
            "GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1")


@register("points_in_rings", _inside("closed_right"))
def points_in_rings(spark, sf):
    return sp.points_in_rings(ports_as_points(spark, sf), ring_edges(spark, sf))


@register("points_in_rings_half_open", _inside("half_open"))
def points_in_rings_half_open(spark, sf):
    return sp.points_in_rings(ports_as_points(spark, sf), ring_edges(spark, sf), "half_open")


@register("radius_join", f"""SELECT pid, tid, round(km, 5) AS km FROM (SELECT port_id AS pid, berg_id AS tid, {S.hav_km('p.lon', 'p.lat', 'b.lon', 'b.lat')} AS km
  FROM v_ports p JOIN v_bergs b ON abs(p.lat - b.lat) < 2) WHERE km <= 150""")
def radius_join(spark, sf):
    j = sp.radius_join(ports_as_points(spark, sf), bergs_as_targets(spark, sf), 150.0)
    return j.select("pid", "tid", F.round("km", 5).alias("km"))


@register("nearest_within_cells", f"""SELECT pid, tid, round(km, 5) AS km FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY km, tid) AS rn
  FROM (SELECT port_id AS pid, berg_id AS tid, {S.hav_km('p.lon', 'p.lat', 'b.lon', 'b.lat')} AS km FROM v_ports p JOIN v_bergs b
  ON abs(floor(p.lat) - floor(b.lat)) <= 2 AND abs(floor(p.lon) - floor(b.lon)) <= 2)) WHERE rn = 1""")
def nearest_within_cells(spark, sf):
    j = sp.knn(ports_as_points(spark, sf), "pid", bergs_as_targets(spark, sf), "tid", 1, [20.0], bins=2)
    return j.select("pid", "tid", F.round("km", 5).alias("km"))


@register("nearest_vertex", f"""SELECT pid, tid, round(km, 5) AS km FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY km, tid) AS rn
  FROM (SELECT node_id AS pid, port_id AS tid, {S.hav_km('n.lon', 'n.lat', 'p.lon', 'p.lat')} AS km FROM v_mesh_nodes n JOIN v_ports p
  ON abs(n.lon - p.lon) <= 4 OR abs(n.lon - p.lon) >= 356)) WHERE rn = 1 AND km <= 80""")
def nearest_vertex(spark, sf):
    n = view(spark, sf, "v_mesh_nodes").select(F.col("node_id").alias("pid"), "lon", "lat")
    t = view(spark, sf, "v_ports").select(F.col("port_id").alias("tid"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    gap = F.abs(F.col("lon") - F.col("tlon"))
    j = sp.knn(n, "pid", t, "tid", 1, [20.0, 80.0], keep=(gap <= 4.0) | (gap >= 356.0))
    return j.select("pid", "tid", F.round("km", 5).alias("km"))


@register("top_candidates", f"""SELECT pid, tid, rank, CASE WHEN rank <= 5 THEN 5 WHEN rank <= 10 THEN 10 WHEN rank <= 20 THEN 20 ELSE 50 END AS stage, round(km, 5) AS km FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY km, tid) AS rank FROM (SELECT port_id AS pid, node_id AS tid, {S.hav_km('p.lon', 'p.lat', 'n.lon', 'n.lat')} AS km
  FROM v_ports p JOIN v_mesh_nodes n ON abs(p.lat - n.lat) < 4) WHERE km <= 400) WHERE rank <= 50""")
def top_candidates(spark, sf):
    t = view(spark, sf, "v_mesh_nodes").select(F.col("node_id").alias("tid"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    j = sp.knn(ports_as_points(spark, sf), "pid", t, "tid", 50, [100.0, 400.0])
    stage = F.when(F.col("rank") <= 5, 5).when(F.col("rank") <= 10, 10).when(F.col("rank") <= 20, 20).otherwise(50)
    return j.select("pid", "tid", "rank", stage.alias("stage"), F.round("km", 5).alias("km"))


@register("planar_crossings", f"SELECT sid, ring_id, edge_idx FROM {SEGS} s JOIN v_ring_edges e ON " + S.planar_cross(("sx1", "sy1"), ("sx2", "sy2"), ("x1", "y1"), ("x2", "y2")))
def planar_crossings(spark, sf):
    return sp.planar_crossings(route_segs(spark, sf), ring_edges(spark, sf)).select("sid", "ring_id", "edge_idx")


_CELLS = ("floor((least(sx1, sx2) - 0.6e0) / 2) <= floor(greatest(x1, x2) / 2) AND floor((greatest(sx1, sx2) + 0.6e0) / 2) >= floor(least(x1, x2) / 2) "
          "AND floor((least(sy1, sy2) - 0.6e0) / 2) <= floor(greatest(y1, y2) / 2) AND floor((greatest(sy1, sy2) + 0.6e0) / 2) >= floor(least(y1, y2) / 2)")
_PAIRS = f"(SELECT * FROM {SEGS} s JOIN v_ring_edges e ON {_CELLS})"


@register("segments_hit_edges", f"SELECT sid, ring_id, edge_idx, round(arc_t, 5) AS t FROM {S.arc_tests(_PAIRS, ('sx1', 'sy1'), ('sx2', 'sy2'), ('x1', 'y1'), ('x2', 'y2'))} WHERE arc_sign <> 0")
def segments_hit_edges(spark, sf):
    j = sp.arc_crossings(route_segs(spark, sf), ring_edges(spark, sf), with_t=True)
    return j.select("sid", "ring_id", "edge_idx", F.round("t", 5).alias("t"))


@register("near_land", f"""WITH b AS (SELECT ring_id, min(x1) AS x1, max(x1) AS x2, min(y1) AS y1, max(y1) AS y2 FROM v_ring_edges GROUP BY 1)
SELECT DISTINCT sid FROM (SELECT sid FROM {_PAIRS} UNION ALL SELECT sid FROM {SEGS} s JOIN b ON {_CELLS})""")
def near_land(spark, sf):
    return sp.near_land(route_segs(spark, sf), ring_edges(spark, sf)).select("sid")


_MID = ("((sx1 + sx2) / 2)", "((sy1 + sy2) / 2)")


@register("line_of_sight", f"""SELECT sid FROM {SEGS} WHERE sid NOT IN (SELECT sid FROM {SEGS} s JOIN v_ring_edges e ON {S.planar_cross(('sx1', 'sy1'), ('sx2', 'sy2'), ('x1', 'y1'), ('x2', 'y2'))})
  AND sid NOT IN (SELECT sid FROM (SELECT sid, ring_id FROM {SEGS} s JOIN v_ring_edges e ON {S.toggles(*_MID, 'x1', 'y1', 'x2', 'y2', 'half_open')} GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1))""")
def line_of_sight(spark, sf):
    s, e = cut(route_segs(spark, sf)), ring_edges(spark, sf)
    return s.join(sp.blocked_sight(s, e), "sid", "left_anti").select("sid")


_T = "(((x2 - x1) * (sy1 - y1) - (y2 - y1) * (sx1 - x1)) / nullif((y2 - y1) * (sx2 - sx1) - (x2 - x1) * (sy2 - sy1), 0))"


@register("connector_water_valid", f"""SELECT sid FROM {SEGS} WHERE sid NOT IN (SELECT sid FROM {SEGS} s JOIN v_ring_edges e ON {S.planar_cross(('sx1', 'sy1'), ('sx2', 'sy2'), ('x1', 'y1'), ('x2', 'y2'))}
   WHERE {S.hav_km('sx1', 'sy1', f'(sx1 + {_T} * (sx2 - sx1))', f'(sy1 + {_T} * (sy2 - sy1))')} > 20)
  AND sid NOT IN (SELECT sid FROM (SELECT sid, ring_id FROM {SEGS} s JOIN v_ring_edges e ON {S.toggles(*_MID, 'x1', 'y1', 'x2', 'y2')}
   WHERE {S.hav_km('sx1', 'sy1', *_MID)} > 20 GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1))""")
def connector_water_valid(spark, sf):
    s, e = cut(route_segs(spark, sf)), ring_edges(spark, sf)
    return s.join(sp.blocked_connectors(s, e, 20.0), "sid", "left_anti").select("sid")


_NEAR = (f"(SELECT * FROM {SEGS} s JOIN v_ring_edges e ON greatest(x1, x2) >= least(sx1, sx2) - 22 * 1.1e0 / 111 AND least(x1, x2) <= greatest(sx1, sx2) + 22 * 1.1e0 / 111 "
         "AND greatest(y1, y2) >= least(sy1, sy2) - 22 * 1.1e0 / 111 AND least(y1, y2) <= greatest(sy1, sy2) + 22 * 1.1e0 / 111 "
         "AND sqrt(pow(greatest(0, least(sx1, sx2) - x1, x1 - greatest(sx1, sx2)) * greatest(0.1, cos(radians((sy1 + sy2) / 2))), 2) "
         "+ pow(greatest(0, least(sy1, sy2) - y1, y1 - greatest(sy1, sy2)), 2)) * 111 <= 22)")


@register("clearance_violations", f"SELECT sid, ring_id, edge_idx, round(m / 1000, 5) AS km FROM {S.point_segment(_NEAR, ('x1', 'y1'), ('sx1', 'sy1'), ('sx2', 'sy2'), 'm', 'sid, ring_id, edge_idx')} WHERE m < 22000")
def clearance_violations(spark, sf):
    s = route_segs(spark, sf).withColumn("clear_km", F.lit(22.0))
    return sp.clearance_violations(s, ring_edges(spark, sf)).withColumn("km", F.round("km", 5))


_LAND = f"""(WITH b AS (SELECT ring_id, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM v_ring_edges GROUP BY 1)
  SELECT port_id AS pid, min({S.hav_km('p.lon', 'p.lat', 'x1', 'y1')}) AS km FROM v_ports p JOIN b ON p.lon BETWEEN bx0 - 3 AND bx1 + 3 AND p.lat BETWEEN by0 - 3 AND by1 + 3
  JOIN v_ring_edges e ON e.ring_id = b.ring_id GROUP BY 1)"""


@register("land_distance", f"SELECT port_id AS pid, round(least(coalesce(km, 500), 500), 5) AS land_km FROM v_ports LEFT JOIN {_LAND} ON pid = port_id")
def land_distance(spark, sf):
    j = sp.land_distance_km(ports_as_points(spark, sf), ring_edges(spark, sf))
    return j.select("pid", F.round("land_km", 5).alias("land_km"))
