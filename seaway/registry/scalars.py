"""Scalar functions over the legs of all routes."""

from pyspark.sql import functions as F

from seaway.functions import geo
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.views import view

P1, P2 = ("lon1", "lat1"), ("lon2", "lat2")


def _legs(spark, sf, **cols):
    return view(spark, sf, "v_legs").select("route_id", "seq", *[v.alias(k) for k, v in cols.items()])


def _legs_sql(**cols):
    return "SELECT route_id, seq, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM v_legs"


def r(x, d):
    return F.round(x, d)


@register("geo_units", _legs_sql(
    rad="round(radians(lon1), 9)", deg="round(degrees(lat1 / 100), 6)", nm="round(lon2 / 1.852e0, 6)",
    km="round(lat2 * 1.852e0, 6)", m_nm="round(lon1 * 1000 / 1852e0, 6)"))
def geo_units(spark, sf):
    return _legs(spark, sf, rad=r(F.radians("lon1"), 9), deg=r(F.degrees(F.col("lat1") / 100), 6),
                 nm=r(geo.km_to_nm("lon2"), 6), km=r(geo.nm_to_km("lat2"), 6), m_nm=r(geo.m_to_nm(F.col("lon1") * 1000), 6))


@register("haversine", _legs_sql(m=f"round({S.hav_m(*P1, *P2)}, 3)", km=f"round({S.hav_km(*P1, *P2)}, 6)"))
def haversine(spark, sf):
    return _legs(spark, sf, m=r(geo.haversine_m(*P1, *P2), 3), km=r(geo.haversine_km(*P1, *P2), 6))


@register("haversine_wrap", f"""
SELECT a.node_id, b.node_id AS other_id, round(2e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat))
  * pow(sin(radians(least(abs(b.lon - a.lon), 360e0 - abs(b.lon - a.lon))) / 2), 2))) * {S.R} / 1000e0, 3) AS km
FROM v_mesh_nodes a JOIN v_mesh_nodes b ON b.node_id = a.node_id + 39""")
def haversine_wrap(spark, sf):
    a = view(spark, sf, "v_mesh_nodes")
    b = a.select((F.col("node_id") - 39).alias("node_id"), F.col("node_id").alias("other_id"),
                 F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, "node_id").select(
        "node_id", "other_id", r(geo.haversine_wrap_km("lon", "lat", "lon2", "lat2"), 3).alias("km"))


@register("bearing", _legs_sql(deg=f"round({S.bearing(*P1, *P2)}, 5)"))
def bearing(spark, sf):
    return _legs(spark, sf, deg=r(geo.bearing_deg(*P1, *P2), 5))


_DX, _DY = S.destination("lon1", "lat1", "(10e0 + seq * 35)", "(route_id % 360)")


@register("destination_point", _legs_sql(lon=f"round({_DX}, 5)", lat=f"round({_DY}, 5)"))
def destination_point(spark, sf):
    x, y = geo.destination_point("lon1", "lat1", 10.0 + F.col("seq") * 35, F.col("route_id") % 360)
    return _legs(spark, sf, lon=r(x, 5), lat=r(y, 5))


_T = "((route_id % 13) / 10e0 - 0.1e0)"
_SX, _SY = S.slerp(*P1, *P2, _T)


@register("slerp", _legs_sql(lon=f"round({_SX}, 5)", lat=f"round({_SY}, 5)"))
def slerp(spark, sf):
    x = geo.arc_points(geo.with_arc(view(spark, sf, "v_legs"), *P1, *P2), *P1, *P2, p=(F.col("route_id") % 13) / 10.0 - 0.1)
    return x.select("route_id", "seq", r("p_lon", 5).alias("lon"), r("p_lat", 5).alias("lat"))


@register("unit_vectors", f"""
WITH v AS (SELECT route_id, seq, {S.unit(*P1, 'a')}, {S.unit(*P2, 'b')} FROM v_legs),
     w AS (SELECT *, {S.cross('a', 'b', 'n')}, {S.dot('a', 'b')} AS d FROM v)
SELECT route_id, seq, round(d, 9) AS dot, round(n_x, 9) + 0e0 AS cx, round(n_y, 9) + 0e0 AS cy, round(n_z, 9) + 0e0 AS cz,
       round(sqrt({S.dot('n', 'n')}), 9) AS norm,
       round(CASE WHEN {S.dot('n', 'n')} = 0 THEN 0 ELSE n_x / sqrt({S.dot('n', 'n')}) END, 6) + 0e0 AS ux FROM w""")
def unit_vectors(spark, sf):
    a, b = geo.unit_vector(*P1), geo.unit_vector(*P2)
    n = geo.cross(a, b)
    return _legs(spark, sf, dot=r(geo.dot(a, b), 9), cx=r(n[0], 9) + 0.0, cy=r(n[1], 9) + 0.0, cz=r(n[2], 9) + 0.0,
                 norm=r(geo.norm(n), 9), ux=r(geo.normalize(n)[0], 6) + 0.0)


def _triples(spark, sf):
    a = view(spark, sf, "v_legs")
    b = view(spark, sf, "v_routes").select("route_id", (F.col("seq") - 2).alias("seq"), F.col("lon").alias("lon3"), F.col("lat").alias("lat3"))
    return a.join(b, ["route_id", "seq"])


_TRIPLES = "(SELECT l.*, p.lon AS lon3, p.lat AS lat3 FROM v_legs l JOIN v_routes p ON p.route_id = l.route_id AND p.seq = l.seq + 2)"


@register("point_segment", "SELECT route_id, seq, round(m, 3) AS m FROM " + S.point_segment(
    _TRIPLES, ("lon3", "lat3"), P1, P2, "m", "route_id, seq"))
def point_segment(spark, sf):
    return _triples(spark, sf).select("route_id", "seq", r(geo.point_segment_m("lon3", "lat3", *P1, *P2), 3).alias("m"))


def _leg_edge(spark, sf):
    """Each leg beside one outline edge close to it."""
    e = view(spark, sf, "v_ring_edges").select(
        (F.col("ring_id") * 6 + F.col("edge_idx")).alias("eid"), "x1", "y1", "x2", "y2")
    n = e.agg((F.max("eid") + 1).alias("n"))
    legs = view(spark, sf, "v_legs").join(F.broadcast(n)).withColumn("eid", F.col("route_id") % F.col("n"))
    x = legs.join(e, "eid")
    dx, dy = F.col("x1") - F.col("lon1"), F.col("y1") - F.col("lat1")
    return x.select("route_id", "seq", F.col("lon1").alias("ax"), F.col("lat1").alias("ay"), F.col("lon2").alias("ux"), F.col("lat2").alias("uy"),
                    (F.col("x1") - dx).alias("cx"), (F.col("y1") - dy + 0.2).alias("cy"),
                    (F.col("x2") - dx).alias("dx"), (F.col("y2") - dy - 0.1).alias("dy"))


_LEG_EDGE = """(SELECT l.route_id, l.seq, lon1 AS ax, lat1 AS ay, lon2 AS ux, lat2 AS uy, x1 - (x1 - lon1) AS cx, y1 - (y1 - lat1) + 0.2e0 AS cy,
  x2 - (x1 - lon1) AS dx, y2 - (y1 - lat1) - 0.1e0 AS dy FROM v_legs l JOIN v_ring_edges e
  ON e.ring_id * 6 + e.edge_idx = l.route_id % (SELECT MAX(ring_id * 6 + edge_idx) + 1 FROM v_ring_edges))"""
_A, _B, _C, _D = ("ax", "ay"), ("ux", "uy"), ("cx", "cy"), ("dx", "dy")
_DEN = "((dy - cy) * (ux - ax) - (dx - cx) * (uy - ay))"
_TT = f"((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) / nullif({_DEN}, 0)"
_UU = f"((ux - ax) * (ay - cy) - (uy - ay) * (ax - cx)) / nullif({_DEN}, 0)"


@register("planar_cross", f"""SELECT route_id, seq, {S.planar_cross(_A, _B, _C, _D)} AS hit,
  round(CASE WHEN abs({_DEN}) < 1e-12 THEN NULL WHEN {_TT} BETWEEN 0 AND 1 AND {_UU} BETWEEN 0 AND 1 THEN {_TT} END, 6) AS t FROM {_LEG_EDGE}""")
def planar_cross(spark, sf):
    return _leg_edge(spark, sf).select("route_id", "seq", geo.planar_segments_cross(_A, _B, _C, _D).alias("hit"),
                                       r(geo.planar_cross_param(_A, _B, _C, _D), 6).alias("t"))


@register("arc_cross", f"SELECT route_id, seq, arc_sign <> 0 AS hit, round(arc_t, 5) AS t FROM {S.arc_tests(_LEG_EDGE, _A, _B, _C, _D)}")
def arc_cross(spark, sf):
    return _leg_edge(spark, sf).select("route_id", "seq", geo.arcs_cross(_A, _B, _C, _D).alias("hit"),
                                       r(geo.arc_cross_param(_A, _B, _C, _D), 5).alias("t"))


@register("cross_track", f"""SELECT route_id, seq, round(asin(sin({S.hav_m(*P1, 'lon3', 'lat3')} / {S.R}) * sin(radians({S.bearing(*P1, 'lon3', 'lat3')})
  - radians({S.bearing(*P1, *P2)}))) * {S.R}, 3) AS m FROM {_TRIPLES}""")
def cross_track(spark, sf):
    return _triples(spark, sf).select("route_id", "seq", r(geo.cross_track_m(P1, P2, ("lon3", "lat3")), 3).alias("m"))


@register("course_change", f"""SELECT route_id, seq, round({S.turn('b1', 'b2')}, 5) AS deg,
  CASE WHEN d < 1 OR d > 359 THEN 'STRAIGHT' WHEN d < 180 THEN 'STBD' ELSE 'PORT' END AS side
  FROM (SELECT *, fmod(b2 - b1 + 360, 360) AS d FROM (SELECT *, {S.bearing(*P1, *P2)} AS b1, {S.bearing(*P2, 'lon3', 'lat3')} AS b2 FROM {_TRIPLES}))""")
def course_change(spark, sf):
    p3 = ("lon3", "lat3")
    return _triples(spark, sf).select(
        "route_id", "seq", r(geo.course_change_deg(P1, P2, p3), 5).alias("deg"),
        geo.turn_direction(geo.bearing_deg(*P1, *P2), geo.bearing_deg(*P2, *p3)).alias("side"))


@register("format_duration", """SELECT o_orderkey, CASE WHEN h <= 0 THEN '0h' WHEN h >= 24 THEN CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || 'd' ||
  CASE WHEN floor(fmod(h, 24) + 0.5) > 0 THEN ' ' || CAST(CAST(floor(fmod(h, 24) + 0.5e0) AS BIGINT) AS VARCHAR) || 'h' ELSE '' END
  ELSE CAST(greatest(1, CAST(floor(h + 0.5e0) AS BIGINT)) AS VARCHAR) || 'h' END AS txt
  FROM (SELECT o_orderkey, o_totalprice / 3000e0 - 2 AS h FROM orders)""")
def format_duration(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", geo.format_duration(F.col("o_totalprice") / 3000.0 - 2).alias("txt"))


@register("project_to_segment", f"""SELECT route_id, seq, round(lon1 + t * (lon2 - lon1), 6) AS lon, round(lat1 + t * (lat2 - lat1), 6) AS lat FROM (
  SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE greatest(0e0, least(1e0, ((lon3 - lon1) * (lon2 - lon1) + (lat3 - lat1) * (lat2 - lat1)) / nullif(l2, 0))) END AS t
  FROM (SELECT *, pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2) AS l2 FROM {_TRIPLES}))""")
def project_to_segment(spark, sf):
    x, y = geo.project_to_segment("lon3", "lat3", *P1, *P2)
    return _triples(spark, sf).select("route_id", "seq", r(x, 6).alias("lon"), r(y, 6).alias("lat"))


@register("equirect", f"""SELECT route_id, seq, round(400 + x / 320, 4) AS px, round(300 - y / 320, 4) AS py, round(lon2, 5) AS lon, round(lat2, 5) AS lat FROM (
  SELECT *, radians(lon2 - lon1) * {S.R} * cos(radians(lat1)) AS x, radians(lat2 - lat1) * {S.R} AS y FROM v_legs)""")
def equirect(spark, sf):
    x, y = geo.equirect_xy("lon2", "lat2", "lon1", "lat1", 320, 800, 600)
    lon, lat = geo.equirect_inverse(x, y, "lon1", "lat1", 320, 800, 600)
    return _legs(spark, sf, px=r(x, 4), py=r(y, 4), lon=r(lon, 5), lat=r(lat, 5))


@register("cells", """SELECT route_id, seq, CAST(floor(lon1 / 2) AS BIGINT) AS cx, CAST(floor(lat1 / 2) AS BIGINT) AS cy,
  floor(lon1 * 200 + 0.5e0) / 200e0 AS qlon, floor(lat1 * 10 + 0.5e0) / 10e0 AS jlat FROM v_legs""")
def cells(spark, sf):
    return _legs(spark, sf, cx=geo.cell("lon1", 2), cy=geo.cell("lat1", 2), qlon=geo.quantise("lon1"), jlat=geo.js_round("lat1", 1))


_CS = (1 - 0.00669437999014132) ** 0.5


@register("polar_stereo", f"""
WITH k AS (SELECT 6378137e0 AS a, 0.00669437999014132e0 AS e2, sqrt(0.00669437999014132e0) AS e, radians(71e0) AS pc),
 g AS (SELECT route_id, seq, lon1 * 20000e0 AS x, (lat1 + 60) * 90000e0 AS y FROM v_legs),
 q AS (SELECT *, cos(pc) / sqrt(1 - e2 * pow(sin(pc), 2)) AS mc, tan(pi() / 4 - pc / 2) / pow((1 - e * sin(pc)) / (1 + e * sin(pc)), e / 2) AS tc FROM k),
 h AS (SELECT g.*, q.*, sqrt(x * x + y * y) AS rho, pi() / 2 - 2 * atan(sqrt(x * x + y * y) * tc / (a * mc)) AS chi FROM g, q)
SELECT route_id, seq, round(CASE WHEN rho = 0 THEN 0e0 ELSE fmod(degrees(atan2(x, y)) + 180, 360) - 180 END, 5) AS lon,
 round(-degrees(chi + (e2 / 2 + 5 * pow(e2, 2) / 24 + pow(e2, 3) / 12 + 13 * pow(e2, 4) / 360) * sin(2 * chi)
  + (7 * pow(e2, 2) / 48 + 29 * pow(e2, 3) / 240 + 811 * pow(e2, 4) / 11520) * sin(4 * chi)
  + (7 * pow(e2, 3) / 120 + 81 * pow(e2, 4) / 1120) * sin(6 * chi) + 4279 * pow(e2, 4) / 161280 * sin(8 * chi)), 5) AS lat FROM h""")
def polar_stereo(spark, sf):
    x, y = geo.polar_stereo_to_lonlat(F.col("lon1") * 20000.0, (F.col("lat1") + 60) * 90000.0)
    return _legs(spark, sf, lon=r(x, 5), lat=r(y, 5))
