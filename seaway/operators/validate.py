"""Land safety of legs, arcs and whole routes. All checks are joins over tables of legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaway.functions import geo
from seaway.operators import spatial as sp
from seaway.operators.ordered import ends
from seaway.operators.tracks import legs
from seaway.session import settle


_KM = geo.haversine_sql("x1", "y1", "x2", "y2")
# fixed values: steps of a leg that are tested together, until one fails
STEP_WAVES = ((1, 1), (2, 4), (5, None))


@geo.remembered
def _outside_dock(x, y, tol) -> Column:
    """True unless the dock exists and (x, y) lies within the tolerance of it."""
    d = geo.haversine_km("dock_x", "dock_y", x, y)
    return F.coalesce(d > geo.c(tol), F.lit(True))


def _test_points(segs: DataFrame) -> DataFrame:
    """Positions ``lon1, lat1`` to ``lon3, lat3`` that must be in the water: the middle, and the quarter points of segments over 15 km."""
    s = geo.with_arc(segs.select("*", geo.c(_KM).alias("_len")), "x1", "y1", "x2", "y2")
    s = geo.arc_points(s, "x1", "y1", "x2", "y2", p=F.lit(0.25), q=F.lit(0.75))
    far = geo.c("_len > 15.0D")
    pos = {"lon1": F.when(far, F.col("p_lon")), "lat1": F.when(far, F.col("p_lat")), "lon2": geo.c("(x1 + x2) / 2.0D"), "lat2": geo.c("(y1 + y2) / 2.0D"),
           "lon3": F.when(far, F.col("q_lon")), "lat3": F.when(far, F.col("q_lat"))}
    return geo.let(s, **pos).drop("p_lon", "p_lat", "q_lon", "q_lat", "_len")


def _with_states(segs: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments with ``_land1`` to ``_land3`` of their test points, looked up where the rows are."""
    for i in (1, 2, 3):
        segs = sp.with_land_state(segs, edges, f"lon{i}", f"lat{i}", f"_land{i}")
    return segs


_SURE = "greatest(_land1, _land2, _land3) = 2"


def unsafe_segments(segs: DataFrame, edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Distinct sids of segments that touch land.

    ``segs(sid, x1, y1, x2, y2, dock_x, dock_y, tol_km, clear_km)``; the dock may be null. Land within
    ``tol_km`` of the dock is allowed; without a dock an edge start closer than ``clear_km`` is not. ``points(sid, lon, lat)`` must
    not lie on land either. Points come first: a segment with one in a cell inside a ring is settled where it is. Crossings and clearance of the
    segments that are left come from one join with the edges.
    """
    s = sp.split_antimeridian(segs).filter("abs(x1 - x2) >= 1e-6 or abs(y1 - y2) >= 1e-6")
    s = _test_points(s.select("sid", "x1", "y1", "x2", "y2", "dock_x", "dock_y", "tol_km", "clear_km"))
    s = s.withColumns({f"lon{i}": F.when(_outside_dock(f"lon{i}", f"lat{i}", "tol_km"), F.col(f"lon{i}")) for i in (1, 2, 3)})
    s = _with_states(s, edges).withColumn("_sure", F.expr(_SURE))
    own = ["x1", "y1", "x2", "y2", "dock_x", "dock_y", "tol_km", "clear_km"]
    on_edge = F.filter(F.array(*[F.when(F.col(f"_land{i}") == 1, F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))) for i in (1, 2, 3)]), lambda v: v.isNotNull())
    s = settle(s.select("sid", "_sure", *[F.when(~F.col("_sure"), F.col(k)).alias(k) for k in own], F.when(~F.col("_sure"), on_edge).alias("_pts")))
    left = s.filter("not _sure")
    p = left.selectExpr("sid", "inline(_pts)").selectExpr("struct(sid, lon, lat) as pid", "lon", "lat")
    inside = s.filter("_sure").select("sid").unionByName(sp.border_points(p, edges).selectExpr("pid.sid as sid"))
    if points is not None:
        inside = inside.unionByName(sp.land_points(points.selectExpr("struct(sid, lon, lat) as pid", "lon", "lat"), edges).selectExpr("pid.sid as sid"))
    inside = settle(inside.distinct())
    # what lies on land with a point is settled and needs no edges
    near = sp.edges_near(left.drop("_sure", "_pts").join(inside, "sid", "left_anti"), edges, F.greatest(F.lit(0.6), F.greatest("tol_km", "clear_km") * 1.5 / 111.0))
    near = sp.with_crossing_param(near)
    cx, cy = geo.slerp("x1", "y1", "x2", "y2", "t")
    crossed = F.col("t").isNotNull()
    near = geo.let(near, cx=F.when(crossed, cx), cy=F.when(crossed, cy))
    cross = F.col("t").isNotNull() & _outside_dock("cx", "cy", "tol_km")
    bad = near.filter(cross | (F.col("dock_x").isNull() & sp.too_close())).select("sid")
    return inside.unionByName(bad.distinct())


def safe_segments(segs: DataFrame, edges: DataFrame) -> DataFrame:
    return segs.join(unsafe_segments(segs, edges), "sid", "left_anti")


def unsafe_arcs(arcs: DataFrame, edges: DataFrame, step_km: float = 75.0, points: DataFrame | None = None) -> DataFrame:
    """sids of great-circle arcs ``(sid, x1, y1, x2, y2, clear_km)`` that touch land or break the clearance, and of ``points`` on land.

    ``arcs`` is read several times and should be settled.
    """
    a = arcs.selectExpr("sid", "x1", "y1", "x2", "y2", "clear_km", f"{_KM} as _km").withColumn("_n", F.expr(f"int(greatest(1, ceil(_km / {step_km}D)))"))
    # arcs with a point in a cell inside a ring are settled where they are, only the others are cut into steps
    t = geo.arc_points(geo.with_arc(a, "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", p=F.lit(0.25), m=F.lit(0.5), q=F.lit(0.75))
    long = F.col("_km") > 80.0
    whole = (F.col("_n") == 1) & (F.abs(F.col("x1") - F.col("x2")) <= 180.0) & geo.c("abs(x1 - x2) >= 1e-6 or abs(y1 - y2) >= 1e-6")
    at = lambda c, mean: F.when(long, F.col(c)).when(whole & (geo.c("_km > 15.0D") if mean is None else F.lit(True)), F.col(c) if mean is None else geo.c(mean))
    t = geo.let(t, lon1=at("p_lon", None), lat1=at("p_lat", None), lon2=at("m_lon", "(x1 + x2) / 2.0D"), lat2=at("m_lat", "(y1 + y2) / 2.0D"), lon3=at("q_lon", None), lat3=at("q_lat", None))
    t = _with_states(t, edges).withColumn("_sure", F.expr(_SURE))
    t = settle(t.select("sid", "_sure", *[F.when(~F.col("_sure"), F.col(k)).alias(k) for k in ("x1", "y1", "x2", "y2", "clear_km", "_km", "_n")]))
    sure = t.filter("_sure").select("sid")
    a = geo.with_arc(t.filter("not _sure").drop("_sure"), "x1", "y1", "x2", "y2")
    long = a.filter("_km > 80").withColumn("_t", F.explode(F.array(*[F.lit(t) for t in (0.25, 0.5, 0.75)])))
    long = geo.arc_points(long, "x1", "y1", "x2", "y2", m="_t").selectExpr("sid", "m_lon as lon", "m_lat as lat")
    sub = a.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    sub = geo.arc_points(sub, "x1", "y1", "x2", "y2", p="(_k - 1) / _n", q="_k / _n").selectExpr(
        "sid", "p_lon as x1", "p_lat as y1", "q_lon as x2", "q_lat as y2", "cast(null as double) as dock_x", "cast(null as double) as dock_y", "0.0D as tol_km", "clear_km")
    rest = unsafe_segments(sub, edges, long if points is None else long.unionByName(points.select("sid", "lon", "lat")))
    return rest.unionByName(sure).distinct()


def terminal_counts(routes: DataFrame) -> DataFrame:
    """Legs at each end that get the dock tolerance: an approach's points - 1, 2 with a projected berth, else 1."""

    def count(side):
        pts, berth = F.col(f"{side}_approach_points"), F.col(f"{side}_projected")
        return F.when(pts.isNotNull(), F.greatest(F.lit(1).cast("bigint"), pts - 1)).when(berth, 2).otherwise(1).cast("bigint")

    return routes.withColumns({"dep_legs": count("dep"), "dest_legs": count("dest")})


def _first_failing(legs: DataFrame, lo: int, hi: int | None, edges: DataFrame) -> DataFrame:
    """(sid, hit): number and kind of the first failing step of each leg among its steps ``lo`` to ``hi``."""
    s = geo.with_arc(legs.select("sid", "x1", "y1", "x2", "y2", F.when(F.col("terminal"), F.col("dock.lon")).alias("dock_x"),
                                 F.when(F.col("terminal"), F.col("dock.lat")).alias("dock_y"), "tol_km", "_n"), "x1", "y1", "x2", "y2")
    s = s.select("*", F.explode(F.sequence(F.lit(lo), F.col("_n") if hi is None else F.least(F.lit(hi), "_n"))).alias("k"))
    s = geo.arc_points(s, "x1", "y1", "x2", "y2", p=(F.col("k") - 1) / F.col("_n"), q=F.col("k") / F.col("_n"), m=(F.col("k") - 0.5) / F.col("_n"))
    s = s.drop("x1", "y1", "x2", "y2", "_n").withColumnsRenamed({"p_lon": "x1", "p_lat": "y1", "q_lon": "x2", "q_lat": "y2", "m_lon": "lon", "m_lat": "lat"})
    # the middle of a step is looked up where the step is; what lies on land by that is not moved for it
    s = s.withColumns({c: F.when(_outside_dock("lon", "lat", "tol_km"), F.col(c)) for c in ("lon", "lat")})
    s = sp.with_land_state(s, edges)
    s = settle(s.select("sid", "k", "x1", "y1", "x2", "y2", "dock_x", "dock_y", "tol_km", "_land", *[F.when(F.col("_land") == 1, F.col(c)).alias(c) for c in ("lon", "lat")]))
    on = sp.border_points(s.filter("_land = 1").select(F.struct("sid", "k").alias("pid"), "lon", "lat"), edges).select("pid.sid", "pid.k")
    inside = settle(s.filter("_land = 2").select("sid", "k").unionByName(on).groupBy("sid").agg(F.min("k").alias("_k")))
    # a crossing counts up to the first step inside, so the steps behind it need no edges; with one step a leg there are none behind
    ahead = s.drop("lon", "lat", "_land")
    if lo != hi:
        ahead = ahead.join(inside, "sid", "left").filter("_k is null or k <= _k").drop("_k")
    hits = sp.steps_crossed(ahead, edges, F.greatest(F.lit(0.6), F.col("tol_km") * 1.5 / 111.0))
    cx, cy = geo.slerp("x1", "y1", "x2", "y2", "t")
    hits = geo.let(hits, cx=cx, cy=cy).filter(F.col("t").isNull() | _outside_dock("cx", "cy", "tol_km"))
    hits = hits.select("sid", F.struct("k", F.lit(1).alias("kind")).alias("hit"))
    return hits.unionByName(inside.select("sid", F.struct(F.col("_k").alias("k"), F.lit(2).alias("kind")).alias("hit"))).groupBy("sid").agg(F.min("hit").alias("hit"))


def failing_segments(points: DataFrame, route_ends: DataFrame, edges: DataFrame) -> DataFrame:
    """Legs that meet land beyond the dock tolerance of their end.

    ``route_ends(route_id, dep_tol, dest_tol, dep_legs, dest_legs)``. Legs are cut into steps of
    2.5 to 15 km; the first failing step of a leg decides, a crossing before an interior point. Legs that fail in their first
    steps are not tested further, so dense land costs less and not more.
    """
    points = settle(points.select("route_id", "seq", "lon", "lat"))
    e = ends(points, ["route_id"], "seq", ["lon", "lat"])
    info = e.select("route_id", "first", "last", (F.col("n") - 1).alias("n_legs")).join(
        route_ends.select("route_id", "dep_tol", "dest_tol", "dep_legs", "dest_legs"), "route_id")
    x = legs(points).withColumnsRenamed({"lon1": "x1", "lat1": "y1", "lon2": "x2", "lat2": "y2"}).drop("bearing")
    x = x.join(info, "route_id")
    dep = F.col("seq") <= F.greatest(F.lit(1), F.col("dep_legs"))
    dest = F.col("seq") > F.col("n_legs") - F.greatest(F.lit(1), F.col("dest_legs"))
    dock = F.when(dep, F.col("first")).otherwise(F.col("last"))
    x = x.select("route_id", "seq", "x1", "y1", "x2", "y2", "leg_km", (dep | dest).alias("terminal"), F.when(dep | dest, dock).alias("dock"),
                 F.when(dep, F.col("dep_tol")).otherwise(F.col("dest_tol")).alias("tol_km"))
    step = geo.clamp(20.0 * F.cos(F.radians((F.col("y1") + F.col("y2")) / 2.0)), 2.5, 15.0)
    x = settle(x.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("leg_km") / step)).cast("int"))).withColumn("sid", F.struct("route_id", "seq"))
    todo, first = x, None
    for lo, hi in STEP_WAVES:
        hit = settle(_first_failing(todo.filter(F.col("_n") >= lo), lo, hi, edges))
        first = hit if first is None else first.unionByName(hit)
        if hi is None:
            break
        todo = todo.filter(F.col("_n") > hi).join(hit, "sid", "left_anti")
    tol = F.format_string("%.1f", "tol_km")
    reason = (F.when(F.col("terminal") & (F.col("hit.kind") == 1),
                     F.concat(F.lit("Terminal harbor approach segment crosses land/peninsula beyond "), tol, F.lit(" km dock tolerance")))
              .when(F.col("terminal"), F.concat(F.lit("Terminal harbor approach segment traverses land interior beyond "), tol, F.lit(" km dock tolerance")))
              .when(F.col("hit.kind") == 1, "Line segment crosses land boundary polygon").otherwise("Line segment traverses land polygon interior"))
    gap = geo.fold_180(F.abs(F.col("x2") - F.col("x1")))
    dy = F.col("y2") - F.col("y1")
    return x.join(first, "sid").select("route_id", "seq", "leg_km", F.sqrt(gap * gap + dy * dy).alias("crossing_deg"), reason.alias("reason"))


def validate_routes(points: DataFrame, route_ends: DataFrame, edges: DataFrame) -> DataFrame:
    """One report row per route. ``route_ends`` also holds the port positions dep_lon, dep_lat, dest_lon, dest_lat."""
    bad = failing_segments(points, route_ends, edges).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("failing"), F.sum("crossing_deg").alias("crossing_deg"), F.min(F.struct("seq", "reason")).alias("_f"))
    e = ends(points, ["route_id"], "seq", ["lon", "lat"])
    x = route_ends.join(e, "route_id").join(bad, "route_id", "left")
    x = x.withColumns({
        "dep_error_m": geo.haversine_m("dep_lon", "dep_lat", "first.lon", "first.lat"),
        "dest_error_m": geo.haversine_m("dest_lon", "dest_lat", "last.lon", "last.lat"),
        "failing": F.coalesce("failing", F.lit(0).cast("bigint")), "crossing_deg": F.coalesce("crossing_deg", F.lit(0.0))})
    ok = (F.col("n") >= 2) & (F.col("dep_error_m") < 1.0) & (F.col("dest_error_m") < 1.0) & (F.col("failing") == 0)
    return x.select("route_id", F.col("n").alias("n_points"), "dep_error_m", "dest_error_m", "failing", "crossing_deg",
                    F.col("_f.reason").alias("first_reason"), F.when(ok, "PASS").otherwise("FAIL").alias("result"))


def suppress_invalid(points: DataFrame, report: DataFrame) -> DataFrame:
    """Points of passing routes only; the constructed length stays in the report."""
    return points.join(report.filter("result = 'PASS'").select("route_id"), "route_id", "left_semi")


def prefer_valid(variants: DataFrame) -> DataFrame:
    """Per route the first passing variant in ``variant`` order, else the first variant (aggregation, no window)."""
    key = F.struct((F.col("result") != "PASS").alias("bad"), "variant")
    return variants.groupBy("route_id").agg(F.min_by(F.struct("variant", "result"), key).alias("v")).select("route_id", "v.variant", "v.result")
