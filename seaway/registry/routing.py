"""Route construction, smoothing, scoring and whole plans."""

from pyspark.sql import functions as F

from seaway.functions import classify, geo
from seaway.operators import approach as ap
from seaway.operators import folds
from seaway.operators import ports as po
from seaway.operators import smooth as sm
from seaway.plans import routing as rt
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.registry.graphs import components, mesh
from seaway.registry.places import SNAP, rnd, snapped
from seaway.operators.validate import unsafe_arcs
from seaway.registry.spatial import ring_edges, route_segs
from seaway.session import cut
from seaway.views import table, view

# --- candidate tables: lines of an order are the candidates of a pair ---------------------------------


def cands(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("bigint").alias("cand_id")).agg(
        F.min("l_extendedprice").alias("length_km"), (1 + F.min("l_discount") * 5).alias("tortuosity"), (F.min("l_quantity") * 1.0).alias("mean_turn"),
        (F.min("l_tax") * 100).alias("gap_km"), F.when(F.min("l_returnflag") != "R", "PASS").otherwise("FAIL").alias("result"),
        (F.max("l_extendedprice") * 0.9).alias("bound_km")).withColumn("pick", F.col("cand_id"))


CAND = """ca AS (SELECT l_orderkey AS pair_id, CAST(l_linenumber AS BIGINT) AS cand_id, min(l_extendedprice) AS length_km, 1 + min(l_discount) * 5 AS tortuosity, min(l_quantity) AS mean_turn, min(l_tax) * 100 AS gap_km,
   CASE WHEN min(l_returnflag) <> 'R' THEN 'PASS' ELSE 'FAIL' END AS result, max(l_extendedprice) * 0.9e0 AS bound_km FROM lineitem GROUP BY 1, 2),
 cs AS (SELECT *, 0.5e0 * greatest(0, (length_km - mk) / mk) + 0.25e0 * greatest(0, tortuosity - 1) + 0.15e0 * mean_turn / 45 + 0.1e0 * gap_km / 50 AS score
   FROM (SELECT *, min(CASE WHEN result = 'PASS' THEN length_km END) OVER (PARTITION BY pair_id) AS mk FROM ca))"""


@register("quality_score", f"WITH {CAND} SELECT pair_id, cand_id, round(score, 6) AS score FROM cs")
def quality_score(spark, sf):
    return rnd(rt.quality_score(cands(spark, sf)), score=6).select("pair_id", "cand_id", "score")


@register("candidate_rank", f"WITH {CAND} SELECT pair_id, cand_id, ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY round(score, 4), round(length_km, 1), round(gap_km, 2), cand_id) AS rank FROM cs WHERE result = 'PASS'")
def candidate_rank(spark, sf):
    return rt.candidate_rank(rt.quality_score(cands(spark, sf))).select("pair_id", "cand_id", "rank")


@register("lower_bound_prune", f"""WITH {CAND} SELECT pair_id, cand_id FROM (SELECT *, min(CASE WHEN result = 'PASS' THEN length_km END) OVER (PARTITION BY pair_id ORDER BY cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ca)
  WHERE best IS NULL OR bound_km <= best""")
def lower_bound_prune(spark, sf):
    return rt.lower_bound_prune(cands(spark, sf)).select("pair_id", "cand_id")


@register("hybrid_distance", """SELECT *, round(total_km / 27.78e0, 4) AS hours FROM (SELECT l_orderkey AS route_id, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 4) AS polar_km,
  round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 4) AS network_km, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 4) AS transition_km, round(sum(l_quantity), 4) AS total_km FROM lineitem GROUP BY 1)""")
def hybrid_distance(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "POLAR").when(F.col("l_returnflag") == "N", "NETWORK").otherwise("TRANSITION")
    x = rt.hybrid_distance(li.select(F.col("l_orderkey").alias("route_id"), kind.alias("kind"), F.col("l_quantity").alias("km")))
    return rnd(x, polar_km=4, network_km=4, transition_km=4, total_km=4, hours=4)


def pair_requests(spark, sf, pairs="v_pairs"):
    p = view(spark, sf, "v_ports")
    tol = classify.dock_tolerance_km("harbor_type", "harbor_size", "channel_depth")
    side = lambda k, key: p.select(F.col("port_id").alias(key), F.col("port_id").alias(f"{k}_id"), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"), tol.alias(f"{k}_tol"))
    x = view(spark, sf, pairs).join(side("a", "origin_id"), "origin_id", "left").join(side("b", "dest_id"), "dest_id", "left")
    return x.drop("origin_id", "dest_id")


@register("same_port_guard", "SELECT pair_id, CASE WHEN origin_id = dest_id THEN 'NO_FEASIBLE_ROUTE' END AS guard FROM v_pairs")
def same_port_guard(spark, sf):
    return rt.same_port_guard(pair_requests(spark, sf)).select("pair_id", "guard")


_ISO = "({0}.port_id IN (14190, 14175, 14250) OR ({0}.lon BETWEEN -76 AND -71 AND {0}.lat BETWEEN -56 AND -41))"


@register("classify_pairs", f"""WITH {SNAP}, q AS (SELECT v.pair_id, a.port_id AS ai, a.lat AS aa, b.lat AS ba, {_ISO.format('a')} OR {_ISO.format('b')} AS iso, s.node_id IS NULL AS an, t.node_id IS NULL AS bn
   FROM v_pairs v JOIN v_ports a ON a.port_id = origin_id JOIN v_ports b ON b.port_id = dest_id LEFT JOIN sn s ON s.port_id = origin_id LEFT JOIN sn t ON t.port_id = dest_id)
 SELECT pair_id, CASE WHEN iso THEN 6 WHEN (aa <= -60 AND an) OR (ba <= -60 AND bn) THEN 1 WHEN aa > -50 AND ba > -50 THEN 2 WHEN aa <= -50 AND ba <= -50 AND NOT an AND NOT bn THEN 1
   WHEN NOT an AND (ba > -50 OR bn) THEN 4 WHEN NOT bn AND (aa > -50 OR an) THEN 3 ELSE 2 END AS topology FROM q""")
def classify_pairs(spark, sf):
    return rt.classify_pairs(pair_requests(spark, sf), snapped(spark, sf), components(spark, sf)).select("pair_id", "topology")


# --- folds --------------------------------------------------------------------------------------------


@register("dedupe_consecutive", """SELECT track_id, seq FROM (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM (SELECT track_id, seq * 2 - 1 AS seq, lon, lat FROM v_track_points
  UNION ALL SELECT track_id, seq * 2, lon, lat FROM v_track_points) WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE x IS NULL OR x <> lon OR y <> lat""")
def dedupe_consecutive(spark, sf):
    t = view(spark, sf, "v_track_points").select("track_id", F.explode(F.array(F.col("seq") * 2 - 1, F.col("seq") * 2)).alias("seq"), "lon", "lat")
    return folds.dedupe_consecutive(t, 1.0, ["track_id"]).select("track_id", "seq")


@register("navigational_waypoints")
def navigational_waypoints(spark, sf):
    """Depends on the last kept point; checked against a plain scan in the tests."""
    return folds.navigational_waypoints(view(spark, sf, "v_track_points"), keys=["track_id"])


_VC = S.hav_km("lon", "lat", "x2", "y2")


@register("passage_plan")
def passage_plan(spark, sf):
    from seaway.sources.writers import passage_plan as op

    t, p = view(spark, sf, "v_track_points"), view(spark, sf, "v_ports").select("port_id", "port_name")
    port = lambda end, key: p.select(F.col("port_id").alias(key), F.col("port_name").alias(end), F.col("port_id").alias(end + "_id"))
    ends = t.select("track_id").distinct().withColumn("a", F.col("track_id")).withColumn("b", F.col("track_id") + 1)
    ends = ends.join(port("departure", "a"), "a", "left").join(port("destination", "b"), "b", "left")
    wp = folds.navigational_waypoints(t, keys=["track_id"])
    return op(wp, ["track_id"], ends, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@register("assemble_polyline", """SELECT route_id, CAST(ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY part_no, seq) AS BIGINT) AS seq, lon, lat FROM (SELECT track_id AS route_id, seq // 9 AS part_no, seq, lon, lat FROM v_track_points
   WHERE (track_id % 2 = 0 OR track_id NOT IN (SELECT track_id FROM (SELECT track_id, seq, lon, lat, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM v_track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq))
    WHERE seq % 9 = 0 AND NOT (abs(abs(x) - 180) <= 1 AND abs(abs(lon) - 180) <= 1 AND abs(y - lat) <= 5) AND """ + S.hav_km("x", "y", "lon", "lat") + """ > 80)) AND track_id % 7 <> 3)""")
def assemble_polyline(spark, sf):
    """Parts of nine points. Even tracks repeat the seam point at the start of the next part; tracks 3, 10, 17, ... hold a latitude of -95."""
    t = view(spark, sf, "v_track_points").select(F.col("track_id").alias("route_id"), F.floor(F.col("seq") / 9).alias("part_no"), (F.col("seq") * 2).alias("seq"), "lon", "lat")
    part, last = F.col("part_no"), (F.col("route_id") % 2 == 0) & (F.col("seq") % 18 == 16)
    copies = F.array_compact(F.array(F.struct(part.alias("p"), F.col("seq").alias("s")), F.when(last, F.struct((part + 1).alias("p"), (F.col("seq") + 1).alias("s")))))
    t = t.withColumn("c", F.explode(copies)).select("route_id", F.col("c.p").alias("part_no"), F.col("c.s").alias("seq"), "lon", "lat")
    t = t.withColumn("lat", F.when((F.col("route_id") % 7 == 3) & (F.col("seq") == 4), -95.0).otherwise(F.col("lat")))
    return rt.assemble_polyline(t, 80.0).select("route_id", "seq", "lon", "lat")


# --- smoothing over every route of the lines table ------------------------------------------------------------


def _routes(spark, sf):
    return cut(view(spark, sf, "v_routes"))


@register("string_pull")
def string_pull(spark, sf):
    return sm.string_pull(_routes(spark, sf), ring_edges(spark, sf))


@register("corner_cut")
def corner_cut(spark, sf):
    return sm.corner_cut(_routes(spark, sf), ring_edges(spark, sf))


@register("fillet")
def fillet(spark, sf):
    return sm.fillet(_routes(spark, sf), ring_edges(spark, sf))


@register("detour_repair")
def detour_repair(spark, sf):
    """Detours for the unsafe legs of all routes."""
    e = ring_edges(spark, sf)
    legs = cut(route_segs(spark, sf))
    bad = legs.join(unsafe_arcs(legs.withColumn("clear_km", F.lit(0.0)), e), "sid", "left_semi")
    return sm.detour_repair(cut(bad), e)


@register("terminal_approaches")
def terminal_approaches(spark, sf):
    """From every port with its snap to the snapped node."""
    n, _ = mesh(spark, sf)
    p = view(spark, sf, "v_ports").withColumn("tol_km", classify.dock_tolerance_km("harbor_type", "harbor_size", "channel_depth"))
    s = cut(snapped(spark, sf)).join(n.select("node_id", F.col("lon").alias("nx"), F.col("lat").alias("ny")), "node_id")
    b = p.join(s, "port_id").select(F.col("port_id").alias("req_id"), F.col("lon").alias("bx"), F.col("lat").alias("by"), "nx", "ny", "tol_km")
    return ap.terminal_approaches(b, ring_edges(spark, sf)).select("req_id", "status", F.round("km", 4).alias("km"), F.size("pts").alias("n_points"))


# --- whole plans ----------------------------------------------------------------------------------------------


def world(spark, sf):
    """Water graph south and lane network north of the gateway row, both cut from the lattice."""
    row = view(spark, sf, "v_gateways").agg(F.floor(F.min("node_id") / 40).alias("r"))
    n = view(spark, sf, "v_mesh_nodes").join(F.broadcast(row))
    south = F.floor(F.col("node_id") / 40) <= F.col("r")
    water, lane = n.filter(south).drop("r"), n.filter(~south).drop("r")
    e = view(spark, sf, "v_lattice").withColumn("weight_km", geo.haversine_wrap_km("x1", "y1", "x2", "y2"))
    e = cut(e.join(F.broadcast(row)))
    below = lambda c: F.floor(F.col(c) / 40) <= F.col("r")
    we = e.filter(below("src") & below("dst")).select("src", "dst", "weight_km")
    le = e.filter(~below("src") & ~below("dst")).select("src", "dst", "weight_km", F.when(F.pmod(F.col("src"), F.lit(40)) == 39, "suez").otherwise("open").alias("tag"))
    return cut(water), we, cut(lane), le


def _setup(spark, sf):
    from seaway.operators import graph as g

    water, we, lane, le = world(spark, sf)
    comps = cut(g.connected_components(water, we))
    req = cut(pair_requests(spark, sf, "v_requests"))
    ids = req.select(F.col("a_id").alias("port_id")).unionByName(req.select(F.col("b_id").alias("port_id"))).distinct()
    ports = view(spark, sf, "v_ports").join(ids, "port_id", "left_semi")
    snaps = cut(po.snap_ports(ports, water, ring_edges(spark, sf), comps))
    return req, water, we, lane, le, snaps


@register("polar_routes")
def polar_routes(spark, sf):
    """Routes over the water graph for all requests whose two ports snap to it."""
    req, water, we, _, _, snaps = _setup(spark, sf)
    return rt.polar_routes(req.filter("a_id != b_id"), water, we, snaps, cut(ring_edges(spark, sf)))[1].select("route_id", "result", "length_km", "tortuosity", "n_points")


def plan_routes(spark, sf):
    """Whole plans of the request table: many hundred jobs, so it is not registered; ``tests/test_routes.py`` checks it when slow tests are asked for."""
    req, water, we, lane, le, snaps = _setup(spark, sf)
    return rt.plan_routes(req, water, we, snaps, view(spark, sf, "v_gateways"), lane, le, cut(ring_edges(spark, sf)))[1]
