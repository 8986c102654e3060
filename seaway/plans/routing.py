"""Route construction for tables of requests.

A request row holds ``pair_id`` and both ports: ``a_*`` for the origin and ``b_*`` for the destination, with
``id, lon, lat, tol`` (dock tolerance in km). Every stage works on all requests and all candidates together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seaway.functions import classify, geo
from seaway.operators import approach as ap
from seaway.operators import graph as g
from seaway.operators import spatial as sp
from seaway.operators import tracks
from seaway.operators.folds import dedupe_consecutive
from seaway.operators.gateways import sector_top
from seaway.operators.ordered import ends, number_rows
from seaway.operators.overlay import build_overlay, pair_paths
from seaway.operators.smooth import renumber, smooth
from seaway.operators.validate import terminal_counts, validate_routes
from seaway.session import settle as cut

KMH = 27.78


def classify_pairs(requests: DataFrame, snaps: DataFrame, components: DataFrame) -> DataFrame:
    """Case 1 to 6 of each request. ``snaps(port_id, node_id)``; connectivity is equality of component labels."""
    primary = g.primary_nodes(components).withColumn("_p", F.lit(True))
    s = snaps.select("port_id", "node_id").join(components, "node_id").join(primary, "node_id", "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    side = lambda p: s.select(F.col("port_id").alias(f"{p}_id"), F.col("component_id").alias(f"_{p}c"), F.col("_p").alias(f"_{p}p"))
    x = requests.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    case = classify.topology("a_id", "a_lon", "a_lat", "_ap", "b_id", "b_lon", "b_lat", "_bp", F.col("_ac") == F.col("_bc"))
    return x.withColumn("topology", case).drop("_ac", "_ap", "_bc", "_bp")


def same_port_guard(requests: DataFrame) -> DataFrame:
    """Requests without two different known ends are answered at once."""
    bad = F.col("a_id").isNull() | F.col("b_id").isNull() | (F.col("a_id") == F.col("b_id"))
    return requests.withColumn("guard", F.when(bad, "NO_FEASIBLE_ROUTE"))


def quality_score(cands: DataFrame) -> DataFrame:
    """Composite score of candidates ``(pair_id, cand_id, length_km, tortuosity, mean_turn, gap_km)``; lower is better.

    The shortest passing candidate of a pair normalises the lengths; a pair has a handful of candidates.
    """
    w = Window.partitionBy("pair_id")
    x = cands.withColumn("min_km", F.min(F.when(F.col("result") == "PASS", F.col("length_km"))).over(w))
    extra = F.greatest(F.lit(0.0), (F.col("length_km") - F.col("min_km")) / F.col("min_km"))
    return x.withColumn("score", 0.50 * extra + 0.25 * F.greatest(F.lit(0.0), F.col("tortuosity") - 1.0)
                        + 0.15 * F.col("mean_turn") / 45.0 + 0.10 * F.col("gap_km") / 50.0)


def candidate_rank(cands: DataFrame) -> DataFrame:
    """Rank of passing candidates: score, length, gap, id. The tolerances 1e-4, 0.1 km and 0.01 km are rounded keys."""
    w = Window.partitionBy("pair_id").orderBy(F.round("score", 4), F.round("length_km", 1), F.round("gap_km", 2), "cand_id")
    return cands.filter("result = 'PASS'").withColumn("rank", F.row_number().over(w).cast("bigint"))


def lower_bound_prune(cands: DataFrame) -> DataFrame:
    """Drop a candidate whose bound exceeds the best validated length before it in ``pick`` order.

    ``bound_km`` is the water part plus the gap plus the great circle to the far port.
    """
    w = Window.partitionBy("pair_id").orderBy("pick").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.when(F.col("result") == "PASS", F.col("length_km"))).over(w)
    return cands.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col("bound_km") <= F.col("_best"))).drop("_best")


def hybrid_distance(parts: DataFrame) -> DataFrame:
    """Water, lane and transition length of routes from ``(route_id, kind, km)``, and the hours at service speed."""
    s = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("km"))), F.lit(0.0))
    x = parts.groupBy("route_id").agg(s("POLAR").alias("polar_km"), s("NETWORK").alias("network_km"), s("TRANSITION").alias("transition_km"), F.sum("km").alias("total_km"))
    return x.withColumn("hours", F.col("total_km") / KMH)


def assemble_polyline(parts: DataFrame, max_gap_km: float = 200.0) -> DataFrame:
    """One polyline per route from ordered parts ``(route_id, part_no, seq, lon, lat)``.

    A route with a bad coordinate is left out, as is one with a part that starts more than ``max_gap_km`` from the end of the part
    before it. Seams are tested on the parts as given: where the first point repeats the seam, the next one is an
    ordinary leg of any length. Then points under 1 m from the last kept one are dropped.
    """
    p = cut(number_parts(parts))
    bad = p.groupBy("route_id").agg(F.bool_or(~geo.valid_coord("lon", "lat")).alias("_bad")).filter("_bad").select("route_id")
    broken = tracks.seam_gaps(p, max_gap_km).filter("broken").select("route_id")
    p = p.join(bad.unionByName(broken).distinct(), "route_id", "left_anti")
    kept = renumber(dedupe_consecutive(p), ["seq"])
    n = kept.groupBy("route_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("route_id")
    return kept.join(n, "route_id", "left_semi")


def number_parts(parts: DataFrame) -> DataFrame:
    x = parts.withColumnRenamed("seq", "_s")
    return number_rows(x, ["route_id"], ["part_no", "_s"], F.struct("part_no", F.floor(F.col("_s") / 16384))).drop("_s")


def finish(polylines: DataFrame, route_ends: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smooth, validate, and fall back to the raw polyline where only that one passes: (points, report)."""
    raw = cut(polylines.select("route_id", "seq", "lon", "lat"))
    soft = cut(smooth(raw, edges))
    both = soft.withColumn("v", F.lit(0)).unionByName(raw.withColumn("v", F.lit(1)))
    both = both.select(F.struct("route_id", "v").alias("route_id"), "seq", "lon", "lat")
    e2 = route_ends.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).withColumn("route_id", F.struct("route_id", "v")).drop("v")
    rep = cut(validate_routes(both, e2, edges).withColumns({"variant": F.col("route_id.v")}).withColumn("route_id", F.col("route_id.route_id")))
    key = F.struct((F.col("result") != "PASS").alias("bad"), "variant")
    best = rep.groupBy("route_id").agg(F.min_by(F.struct(*[c for c in rep.columns if c != "route_id"]), key).alias("r")).select("route_id", "r.*")
    pts = both.select("route_id.route_id", F.col("route_id.v").alias("variant"), "seq", "lon", "lat").join(best.select("route_id", "variant"), ["route_id", "variant"])
    return pts.drop("variant"), best


def _metrics(points: DataFrame) -> DataFrame:
    return tracks.quality_metrics(points).select("route_id", "length_km", "tortuosity", "mean_turn", "max_turn")


def _path_parts(pp: DataFrame, od: DataFrame, nodes: DataFrame, part: int, reverse: bool = False) -> DataFrame:
    """Points of the graph path of each route; ``od(route_id, source, target)``, ``pp(source, target, hop, node_id)``."""
    x = od.join(pp, ["source", "target"]).join(nodes.select("node_id", "lon", "lat"), "node_id")
    seq = -F.col("hop") if reverse else F.col("hop")
    if reverse:
        n = pp.groupBy("source", "target").agg(F.max("hop").alias("_m"))
        x, seq = x.join(n, ["source", "target"]), F.col("_m") - F.col("hop")
    return x.select("route_id", F.lit(part).alias("part_no"), seq.cast("bigint").alias("seq"), "lon", "lat")


def _one(df: DataFrame, part: int, lon, lat) -> DataFrame:
    return df.select("route_id", F.lit(part).alias("part_no"), F.lit(0).cast("bigint").alias("seq"), geo.c(lon).alias("lon"), geo.c(lat).alias("lat"))


def _ends(routes: DataFrame, **counts) -> DataFrame:
    x = routes.withColumns({k: counts.get(k, F.lit(None).cast(t)) for k, t in (
        ("dep_approach_points", "bigint"), ("dest_approach_points", "bigint"), ("dep_projected", "boolean"), ("dest_projected", "boolean"))})
    x = terminal_counts(x)
    return x.select("route_id", F.col("a_lon").alias("dep_lon"), F.col("a_lat").alias("dep_lat"), F.col("b_lon").alias("dest_lon"), F.col("b_lat").alias("dest_lat"),
                    F.col("a_tol").alias("dep_tol"), F.col("b_tol").alias("dest_tol"), "dep_legs", "dest_legs")


def _snap_side(snaps: DataFrame, p: str) -> DataFrame:
    return snaps.select(F.col("port_id").alias(f"{p}_id"), F.col("node_id").alias(f"{p}_node"), F.col("projected").alias(f"{p}_proj"), F.col("wlon").alias(f"{p}_wx"), F.col("wlat").alias(f"{p}_wy"))


def polar_routes(requests: DataFrame, nodes: DataFrame, graph: DataFrame, snaps: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes over the water graph between two snapped ports: (points, report with metrics)."""
    r = cut(requests.join(_snap_side(snaps, "a"), "a_id").join(_snap_side(snaps, "b"), "b_id").withColumn("route_id", F.col("pair_id")))
    od = r.select("route_id", F.col("a_node").alias("source"), F.col("b_node").alias("target"))
    _, way = pair_paths(build_overlay(nodes, graph), od)
    mid = cut(_path_parts(way, od, nodes, 2))
    ok = mid.select("route_id").distinct()
    rr = r.join(ok, "route_id", "left_semi")
    parts = (_one(rr, 0, "a_lon", "a_lat").unionByName(_one(rr.filter("a_proj"), 1, "a_wx", "a_wy")).unionByName(mid)
             .unionByName(_one(rr.filter("b_proj"), 3, "b_wx", "b_wy")).unionByName(_one(rr, 4, "b_lon", "b_lat")))
    # berth legs may be long and are no seams: the whole route counts as one part
    line = cut(assemble_polyline(number_parts(parts).withColumn("part_no", F.lit(2))))
    pts, rep = finish(line, _ends(rr, dep_projected=F.col("a_proj"), dest_projected=F.col("b_proj")), edges)
    pts = cut(pts)
    return pts, rep.join(_metrics(pts), "route_id").withColumn("gap_km", F.lit(0.0))


def _lane_candidates(requests: DataFrame, lane_nodes: DataFrame, max_km: float, sides: Sequence[str]) -> DataFrame:
    """Nearest lane vertex of the given ends as ``{side}_vertex``."""
    x = requests
    t = lane_nodes.select("node_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    for p in sides:
        ports = x.select(F.col(f"{p}_id").alias("port_id"), F.col(f"{p}_lon").alias("lon"), F.col(f"{p}_lat").alias("lat")).distinct()
        near = sp.knn(ports, "port_id", t, "node_id", 1, [max_km / 8.0, max_km]).select(F.col("port_id").alias(f"{p}_id"), F.col("node_id").alias(f"{p}_vertex"))
        x = x.join(near, f"{p}_id")
    return x


def _approach(line: DataFrame, routes: DataFrame, p: str, edges: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
    """Approach of one end of a lane line ``(route_id, seq, lon, lat)``: (approach rows, line without trimmed point)."""
    e = ends(line, ["route_id"], "seq", ["seq", "lon", "lat"])
    edge = F.col("first") if first else F.col("last")
    e = e.select("route_id", "n", edge.alias("e"))
    step = 1 if first else -1
    second = line.join(e.select("route_id", (F.col("e.seq") + step).alias("seq")), ["route_id", "seq"]).select("route_id", F.col("lon").alias("n2x"), F.col("lat").alias("n2y"))
    b = routes.select("route_id", F.col(f"{p}_lon").alias("bx"), F.col(f"{p}_lat").alias("by"), F.col(f"{p}_tol").alias("tol_km")).join(e, "route_id").join(second, "route_id", "left")
    b = b.select(F.col("route_id").alias("req_id"), "bx", "by", F.col("e.lon").alias("n1x"), F.col("e.lat").alias("n1y"), "n2x", "n2y", "tol_km")
    got = cut(ap.pick_terminal(b, edges)).withColumnRenamed("req_id", "route_id")
    drop = got.filter("trim = 1").join(e, "route_id").select("route_id", F.col("e.seq").alias("seq"))
    return got, line.join(drop, ["route_id", "seq"], "left_anti")


def _approach_parts(got: DataFrame, part: int, reverse: bool) -> DataFrame:
    x = got.select("route_id", F.posexplode("pts").alias("i", "p"))
    seq = -F.col("i") if reverse else F.col("i")
    return x.select("route_id", F.lit(part).alias("part_no"), (seq + 8).cast("bigint").alias("seq"), "p.lon", "p.lat")


def network_routes(requests: DataFrame, lane_nodes: DataFrame, lanes: DataFrame, edges: DataFrame, restrictions: Sequence[Sequence[str]] = ((), ("suez",), ("panama",)),
                   max_km: float = 2000.0) -> tuple[DataFrame, DataFrame]:
    """Routes over the lane network with terminal approaches; each restriction set is tried, the first that passes wins."""
    r = cut(_lane_candidates(requests, lane_nodes, max_km, ("a", "b")))
    # one layer of the graph per restriction set, so that one search answers all of them
    k = len(restrictions)
    layer = lambda c, i: (F.col(c) * k + i).alias(c)
    places = lane_nodes.select("lon", "lat", "node_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("alt")).withColumn("node_id", F.col("node_id") * k + F.col("alt"))
    layers, od = None, None
    for i, blocked in enumerate(restrictions):
        e = g.restrict_edges(lanes, blocked).select(layer("src", i), layer("dst", i), "weight_km")
        o = r.select("pair_id", F.struct("pair_id", F.lit(i).alias("alt")).alias("route_id"), (F.col("a_vertex") * k + i).alias("source"), (F.col("b_vertex") * k + i).alias("target"))
        layers, od = (e, o) if layers is None else (layers.unionByName(e), od.unionByName(o))
    _, way = pair_paths(build_overlay(places, layers), od)
    mids = cut(_path_parts(way, od.drop("pair_id"), places, 2))
    routes = r.join(od.select("pair_id", "route_id"), "pair_id")
    line = cut(mids.select("route_id", (F.col("seq") + 1).alias("seq"), "lon", "lat"))
    routes = routes.join(line.select("route_id").distinct(), "route_id", "left_semi")
    dep, line = _approach(line, routes, "a", edges, True)
    dest, line = _approach(line, routes, "b", edges, False)
    parts = (_approach_parts(dep, 1, False).unionByName(line.select("route_id", F.lit(2).alias("part_no"), "seq", "lon", "lat")).unionByName(_approach_parts(dest, 3, True)))
    poly = cut(assemble_polyline(parts))
    size = lambda d, n: d.select("route_id", F.size("pts").cast("bigint").alias(n))
    rr = routes.join(size(dep, "_dp"), "route_id").join(size(dest, "_tp"), "route_id")
    pts, rep = finish(poly, _ends(rr, dep_approach_points=F.col("_dp"), dest_approach_points=F.col("_tp")), edges)
    rep = cut(rep.withColumn("pair_id", F.col("route_id.pair_id")))
    best = rep.groupBy("pair_id").agg(F.min_by(F.struct(*[c for c in rep.columns if c != "pair_id"]), F.struct(F.col("result") != "PASS", "route_id.alt")).alias("b")).select("pair_id", "b.*")
    pts = cut(pts.join(best.select("route_id", "pair_id"), "route_id").select(F.col("pair_id").alias("route_id"), "seq", "lon", "lat"))
    best = best.drop("route_id").withColumnRenamed("pair_id", "route_id")
    return pts, best.join(_metrics(pts), "route_id").withColumn("gap_km", F.lit(0.0))


def gateway_routes(requests: DataFrame, nodes: DataFrame, graph: DataFrame, snaps: DataFrame, gateways: DataFrame, lane_nodes: DataFrame, lanes: DataFrame,
                   edges: DataFrame, k: int = 6, max_km: float = 2000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Routes from a polar port over a gateway to a lane port (cases 3 and 4): (points, report of the best, all candidates).

    ``requests`` adds ``polar`` ('a' or 'b'), the end on the water graph. Work runs from the polar end; routes of
    requests that start at the lane end are turned round at the end.
    """
    flip = F.col("polar") == "b"
    sw = lambda p, q: [F.when(flip, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for c in ("id", "lon", "lat", "tol")]
    r = requests.select("pair_id", "polar", *sw("a", "b"), *sw("b", "a"))
    r = cut(_lane_candidates(r.join(_snap_side(snaps, "a"), "a_id"), lane_nodes, max_km, ("b",)))
    top = sector_top(r, gateways, k).join(gateways.drop("sector"), "gateway_id")
    c = cut(r.join(top, "pair_id").withColumn("route_id", F.struct("pair_id", "gateway_id")))
    # water and lanes as two layers of one graph
    even, odd = lambda x: x * 2, lambda x: x * 2 + 1
    places = nodes.select(even(F.col("node_id")).alias("node_id"), "lon", "lat").unionByName(lane_nodes.select(odd(F.col("node_id")).alias("node_id"), "lon", "lat"))
    both = graph.select(even(F.col("src")).alias("src"), even(F.col("dst")).alias("dst"), F.col("weight_km").cast("double").alias("weight_km")).unionByName(
        lanes.select(odd(F.col("src")).alias("src"), odd(F.col("dst")).alias("dst"), F.col("weight_km").cast("double").alias("weight_km")))
    wod = c.select("route_id", even(F.col("node_id")).alias("source"), even(F.col("a_node")).alias("target"))
    lod = c.select("route_id", odd(F.col("vertex_id")).alias("source"), odd(F.col("b_vertex")).alias("target"))
    dist, way = pair_paths(build_overlay(places, both), wod.unionByName(lod))
    way = cut(way)
    wpart, lpart = _path_parts(way, wod, places, 2, reverse=True), cut(_path_parts(way, lod, places, 3))
    wkm = dist.select((F.col("source") / 2).cast("bigint").alias("node_id"), (F.col("target") / 2).cast("bigint").alias("a_node"), F.col("dist_km").alias("water_km")).join(
        wod.select((F.col("source") / 2).cast("bigint").alias("node_id"), (F.col("target") / 2).cast("bigint").alias("a_node")).distinct(), ["node_id", "a_node"])
    c = cut(c.join(wkm, ["node_id", "a_node"]).join(lpart.select("route_id").distinct(), "route_id", "left_semi"))
    line = cut(lpart.select("route_id", (F.col("seq") + 1).alias("seq"), "lon", "lat"))
    far, line = _approach(line, c, "b", edges, False)
    parts = (_one(c, 0, "a_lon", "a_lat").unionByName(_one(c.filter("a_proj"), 1, "a_wx", "a_wy")).unionByName(wpart)
             .unionByName(line.select("route_id", F.lit(3).alias("part_no"), "seq", "lon", "lat")).unionByName(_approach_parts(far, 4, True)))
    parts = number_parts(parts.join(c.select("route_id"), "route_id", "left_semi"))
    poly = cut(assemble_polyline(parts.withColumn("part_no", F.greatest("part_no", F.lit(2)))))  # berth, projection and water path are one part
    rr = c.join(far.select("route_id", F.size("pts").cast("bigint").alias("_tp")), "route_id")
    pts, rep = finish(poly, _ends(rr, dep_projected=F.col("a_proj"), dest_approach_points=F.col("_tp")), edges)
    pts = cut(pts)
    cand = rep.join(_metrics(pts), "route_id").join(c.select("route_id", "pair_id", "gateway_id", "gap_km", "pick", "polar", "water_km",
                                                             geo.haversine_km("global_lon", "global_lat", "b_lon", "b_lat").alias("_far")), "route_id")
    cand = cand.withColumns({"bound_km": F.col("water_km") + F.col("gap_km") + F.col("_far"), "cand_id": F.col("gateway_id")}).drop("_far")
    ranked = cut(candidate_rank(quality_score(lower_bound_prune(cut(cand)))))
    best = ranked.filter("rank = 1")
    bp = pts.join(best.select("route_id", "pair_id", "polar"), "route_id")
    bp = bp.select(F.col("pair_id").alias("route_id"), F.when(F.col("polar") == "b", -F.col("seq")).otherwise(F.col("seq")).alias("seq"), "lon", "lat")
    bp = renumber(bp.withColumn("_o", F.lit(0)), ["seq", "_o"])
    return bp, best.drop("route_id").withColumnRenamed("pair_id", "route_id"), cand


def direct_lines(requests: DataFrame, edges: DataFrame, max_km: float = 150.0) -> tuple[DataFrame, DataFrame]:
    """The straight leg between ports under ``max_km`` apart."""
    r = requests.filter(geo.haversine_km("a_lon", "a_lat", "b_lon", "b_lat") < max_km).withColumn("route_id", F.col("pair_id"))
    pts = _one(r, 0, "a_lon", "a_lat").withColumn("seq", F.lit(1).cast("bigint")).unionByName(_one(r, 0, "b_lon", "b_lat").withColumn("seq", F.lit(2).cast("bigint"))).drop("part_no")
    rep = validate_routes(pts, _ends(r), edges)
    return pts, rep.join(_metrics(pts), "route_id").withColumn("gap_km", F.lit(0.0))


def choose_strategy(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """The strategy of each request from its reports ``(pair_id, strategy, result, length_km, tortuosity)``.

    Water graph first. Then lanes against gateway: without an end at or below -60 the lanes win when they are
    shorter, or straight (under 1.25) while the gateway route winds (over 1.35). Then lanes, then the direct line.
    """
    ok = F.col("result") == "PASS"
    pick = lambda s, c: F.max(F.when(ok & (F.col("strategy") == s), F.col(c)))
    x = reports.groupBy("pair_id").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("POLAR", "NETWORK", "GATEWAY", "DIRECT") for c in ("length_km", "tortuosity")])
    x = requests.select("pair_id", F.least("a_lat", "b_lat").alias("_south"), "guard").join(x, "pair_id", "left")
    n, gw = F.col("NETWORK_length_km"), F.col("GATEWAY_length_km")
    lanes = n.isNotNull() & (F.col("_south") > -60.0) & (gw.isNull() | (n < gw) | ((F.col("GATEWAY_tortuosity") > 1.35) & (F.col("NETWORK_tortuosity") < 1.25)))
    s = (F.when(F.col("guard").isNotNull(), F.lit(None)).when(F.col("POLAR_length_km").isNotNull(), "POLAR").when(lanes, "NETWORK").when(gw.isNotNull(), "GATEWAY")
         .when(n.isNotNull(), "NETWORK").when(F.col("DIRECT_length_km").isNotNull(), "DIRECT"))
    x = x.withColumn("strategy", s)
    return x.select("pair_id", "strategy", F.coalesce("guard", F.when(F.col("strategy").isNotNull(), "SUCCESS").otherwise("REJECTED_LAND_INTERSECTION")).alias("status"))


def plan_routes(requests: DataFrame, nodes: DataFrame, graph: DataFrame, snaps: DataFrame, gateways: DataFrame, lane_nodes: DataFrame, lanes: DataFrame,
                edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best route of every request: (points, one summary row per request). Failed requests carry no points."""
    req = cut(same_port_guard(requests))
    live = req.filter("guard is null")
    comps = cut(g.connected_components(nodes, graph))
    case = cut(classify_pairs(live, snaps, comps))
    # each strategy works on what the ones before it left open; lanes and gateways are compared, so they share a stage
    done: list[tuple[str, tuple[DataFrame, DataFrame]]] = []

    def left(requests: DataFrame) -> DataFrame:
        for _, (_, r) in done:
            requests = requests.join(r.filter("result = 'PASS'").select(F.col("route_id").alias("pair_id")), "pair_id", "left_anti")
        return cut(requests)

    def stage(name: str, requests: DataFrame, build) -> None:
        if not requests.isEmpty():
            points, report = build(requests)
            done.append((name, (points, cut(report))))

    stage("POLAR", live, lambda r: polar_routes(r, nodes, graph, snaps, edges))
    todo = left(live)
    lanes_of = lambda r: network_routes(r, lane_nodes, lanes, edges)
    mixed = case.filter("topology in (3, 4)").withColumn("polar", F.when(F.col("topology") == 4, "a").otherwise("b"))
    stage("NETWORK", todo.filter("a_lat > -60 and b_lat > -60"), lanes_of)
    stage("GATEWAY", mixed.join(todo.select("pair_id"), "pair_id", "left_semi"), lambda r: gateway_routes(r, nodes, graph, snaps, gateways, lane_nodes, lanes, edges)[:2])
    todo = left(todo)
    stage("NETWORK", todo.filter("(a_lat > -60) <> (b_lat > -60)"), lanes_of)
    stage("DIRECT", left(todo), lambda r: direct_lines(r, edges))
    cols = ["route_id", "result", "length_km", "tortuosity", "first_reason"]
    rep, pts = None, None
    for name, (p, r) in done:
        r = r.select(*cols).withColumn("strategy", F.lit(name))
        p = p.select("route_id", "seq", "lon", "lat").withColumn("strategy", F.lit(name))
        rep = r if rep is None else rep.unionByName(r)
        pts = p if pts is None else pts.unionByName(p)
    if rep is None:
        rep = live.sparkSession.createDataFrame([], f"route_id {req.schema['pair_id'].dataType.simpleString()}, result string, length_km double, tortuosity double, first_reason string, strategy string")
        pts = live.sparkSession.createDataFrame([], f"route_id {req.schema['pair_id'].dataType.simpleString()}, seq long, lon double, lat double, strategy string")
    rep = cut(rep.withColumnRenamed("route_id", "pair_id"))
    pick = cut(choose_strategy(rep, req))
    why = rep.filter("first_reason is not null").groupBy("pair_id").agg(F.min("first_reason").alias("reason"))
    s = pick.join(case.select("pair_id", "topology"), "pair_id", "left").join(rep.drop("first_reason"), ["pair_id", "strategy"], "left").join(why, "pair_id", "left")
    s = s.withColumn("reason", F.when(F.col("status") != "SUCCESS", F.col("reason")))
    s = s.withColumn("category", classify.failure_category("status", "reason")).drop("result")
    good = pick.filter("strategy is not null").select(F.col("pair_id").alias("route_id"), "strategy")
    return pts.join(good, ["route_id", "strategy"], "left_semi"), s
