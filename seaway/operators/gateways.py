"""Gateways between a water graph and a lane network: discovery, ranking, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaway.functions import classify, geo
from seaway.operators import graph as g
from seaway.operators import spatial as sp
from seaway.session import cut

# a gateway catalogue up to this size is sent to every task; see sector_top
MAX_BROADCAST = 20_000


def _pair_checks(nodes: DataFrame, vertices: DataFrame, ring_edges: DataFrame, max_lon: float, max_km: float) -> DataFrame:
    """Nearest vertex of each node with the land checks: node_id, vertex_id, km, flags."""
    v = vertices.select("vertex_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    gap = F.abs(F.col("lon") - F.col("tlon"))
    near = sp.knn(nodes, "node_id", v, "vertex_id", 1, [max_km / 4.0, max_km], keep=(gap <= max_lon) | (gap >= 360.0 - max_lon))
    pos = nodes.select("node_id", F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    pair = cut(near.select("node_id", "vertex_id", "km").join(pos, "node_id").join(v, "vertex_id").withColumnsRenamed({"tlon": "x2", "tlat": "y2"}))
    blocked = sp.blocked_sight(pair.select(F.col("node_id").alias("sid"), "x1", "y1", "x2", "y2"), ring_edges)
    wet = sp.points_on_land(pair.select(F.col("vertex_id").alias("pid"), F.col("x2").alias("lon"), F.col("y2").alias("lat")).distinct(), ring_edges, "half_open")
    flag = lambda df, key, name: df.select(F.col(df.columns[0]).alias(key), F.lit(True).alias(name))
    pair = pair.join(flag(blocked, "node_id", "blocked"), "node_id", "left").join(flag(wet, "vertex_id", "vertex_land"), "vertex_id", "left")
    return pair


def discover_gateways(nodes: DataFrame, edges: DataFrame, vertices: DataFrame, ring_edges: DataFrame, components: DataFrame,
                      lat: tuple[float, float] = (-56.0, -33.0), max_lon: float = 4.0, max_km: float = 80.0) -> DataFrame:
    """Every node of the corridor with its first reject reason, or its score when it is a gateway.

    ``vertices(vertex_id, lon, lat, in_network)`` are the lane vertices; ``in_network`` tells whether the
    vertex hangs on the main lane component. A nearest vertex past ``max_km`` gives DISTANCE_EXCEEDED.
    """
    n = nodes.filter(F.col("lat").between(*lat)).select("node_id", "lon", "lat")
    v = vertices.filter(F.col("lat").between(*lat))
    primary = g.primary_nodes(components).withColumn("primary", F.lit(True))
    land = sp.points_on_land(n.select(F.col("node_id").alias("pid"), "lon", "lat"), ring_edges, "half_open").select(F.col("pid").alias("node_id"), F.lit(True).alias("on_land"))
    pair = _pair_checks(n, v, ring_edges, max_lon, max_km).join(v.select("vertex_id", "in_network"), "vertex_id")
    clear = sp.land_distance_km(n.select(F.col("node_id").alias("pid"), "lon", "lat"), ring_edges).select(F.col("pid").alias("node_id"), F.col("land_km").alias("clearance_km"))
    # a node with no vertex within max_lon at all is told apart from one whose nearest is too far: one row
    # per longitude band (at most 360 / max_lon) with the outermost vertices answers that
    nb = int(360.0 / max_lon)
    band = lambda c, k=0: F.pmod(F.floor((F.col(c) + 180.0) / (360.0 / nb)) + k, F.lit(nb))
    tv = F.broadcast(v.groupBy(band("lon").alias("_b")).agg(F.min("lon").alias("_lo"), F.max("lon").alias("_hi")))
    some = n.select("node_id", "lon", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("_k"))
    some = some.withColumn("_b", band("lon", F.col("_k"))).join(tv, "_b")
    off = F.abs(F.col("lon") - F.when(F.col("_k") < 0, F.col("_hi")).otherwise(F.col("_lo")))
    some = some.filter((F.col("_k") == 0) | (F.least(off, 360.0 - off) <= max_lon)).select("node_id").distinct().withColumn("any_vertex", F.lit(True))
    deg = g.node_degree(n, edges)
    x = n
    for part in (primary, land, pair.drop("x1", "y1"), clear, some, deg):
        x = x.join(part, "node_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (F.when(~yes("primary"), "NON_PRIMARY_COMPONENT").when(yes("on_land"), "POLAR_NODE_IN_LAND")
              .when(F.col("vertex_id").isNull() & yes("any_vertex"), "DISTANCE_EXCEEDED")
              .when(F.col("vertex_id").isNull(), "NO_GLOBAL_VERTEX_IN_RANGE").when(yes("vertex_land"), "GLOBAL_VERTEX_IN_LAND")
              .when(yes("blocked"), "LINE_OF_SIGHT_BLOCKED").when(~yes("in_network"), "GLOBAL_NETWORK_DISCONNECTED"))
    s_dist = F.greatest(F.lit(0.0), 1.0 - F.col("km") / max_km)
    s_clear = F.least(F.lit(1.0), F.col("clearance_km") / 200.0)
    s_deg = F.least(F.lit(1.0), F.col("degree") / 8.0)
    x = x.withColumns({"reason": reason, "sector": classify.ocean_sector("lon")})
    ok = F.col("reason").isNull()
    name = F.concat(F.lit("GW-"), F.when(F.col("lon") >= 0.0, "+").otherwise(""), F.format_string("%.1f_%.1f", "lon", "lat"))
    return x.select(
        "node_id", "lon", "lat", "vertex_id", F.col("x2").alias("global_lon"), F.col("y2").alias("global_lat"), "km", "clearance_km", "degree", "sector", "reason",
        F.when(ok, name).alias("gateway_id"), F.when(ok, 0.50 * s_dist + 0.35 * s_clear + 0.15 * s_deg).alias("score"))


def rank_gateways(gateways: DataFrame, k: int = 20) -> DataFrame:
    """The k best by score. Ties by node id."""
    return gateways.filter("score is not null").orderBy(F.col("score").desc(), "node_id").limit(k)


def sector_distribution(gateways: DataFrame) -> DataFrame:
    """Gateways per sector, empty sectors with zero."""
    spark = gateways.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in classify.SECTOR_NAMES])).alias("sector"))
    n = gateways.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "sector", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def element_at_rank(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], fractions: dict[str, float]) -> DataFrame:
    """Elements at position floor(n * q) of the sorted values of each key, q per output name (not interpolated).

    Values are numbered in two levels over value bands, so one key never sorts in one task.
    """
    from seaway.operators.ordered import number_rows

    x = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    cols = [f"_o{i}" for i in range(len(order))]
    x = number_rows(x, list(keys), cols, F.floor(F.col("_o0") / 8.0), "_pos")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, list(keys))
    pick = lambda q: F.max(F.when(F.col("_pos") - 1 == F.floor(F.col("_n") * q), F.col(value)))
    return x.groupBy(*keys).agg(*[pick(q).alias(k) for k, q in fractions.items()])


def gateway_catalog_summary(gateways: DataFrame) -> DataFrame:
    """Counts, and the gap and clearance of the gateway at position floor(n/2) of the ranking."""
    counts = gateways.agg(F.count(F.lit(1)).alias("evaluated"), F.count("score").alias("valid"), F.count("reason").alias("rejected"))
    ok = gateways.filter("score is not null").select(F.lit(1).alias("k"), (-F.col("score") * 1000.0).alias("s"), "node_id", F.struct("km", "clearance_km").alias("v"))
    mid = element_at_rank(ok, ["k"], "v", [F.col("s"), F.col("node_id")], {"m": 0.5}).select(F.col("m.km").alias("median_km"), F.col("m.clearance_km").alias("median_clearance"))
    return counts.join(mid, F.lit(True), "left")


def corridor_benchmark(nodes: DataFrame, vertices: DataFrame, ring_edges: DataFrame, components: DataFrame, lats: Sequence[float],
                       half: float = 0.75, max_lon: float = 3.0, max_km: float = 100.0) -> DataFrame:
    """One row per candidate latitude: counts, rejects, gap and clearance statistics, sectors covered.

    All latitudes run in one job: rows are tagged with the bands they fall in (a literal list).
    """
    def tag(df):
        hit = F.array_compact(F.array(*[F.when(F.col("lat").between(c - half, c + half), F.lit(float(c))) for c in lats]))
        return df.select("*", F.explode(hit).alias("band"))

    n = tag(nodes.select("node_id", "lon", "lat")).join(g.primary_nodes(components).withColumn("primary", F.lit(True)), "node_id", "left")
    n = n.withColumn("primary", F.coalesce("primary", F.lit(False)))
    land = sp.points_on_land(nodes.select(F.col("node_id").alias("pid"), "lon", "lat"), ring_edges, "half_open").select(F.col("pid").alias("node_id"), F.lit(True).alias("on_land"))
    v = tag(vertices.select("vertex_id", "lon", "lat"))
    key = F.struct("band", "node_id")
    pts = n.filter("primary").select(key.alias("node_id"), "lon", "lat", "band")
    tv = v.select(F.struct("band", "vertex_id").alias("vertex_id"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), F.col("band").alias("tband"))
    gap = F.abs(F.col("lon") - F.col("tlon"))
    same = ((gap <= max_lon) | (gap >= 360.0 - max_lon)) & (F.col("node_id.band") == F.col("tband"))
    near = sp.knn(pts, "node_id", tv, "vertex_id", 1, [max_km / 4.0, max_km], keep=same)
    pair = near.select("node_id", "vertex_id", "km").join(pts.select("node_id", F.col("lon").alias("x1"), F.col("lat").alias("y1")), "node_id").join(
        tv.select("vertex_id", F.col("tlon").alias("x2"), F.col("tlat").alias("y2")), "vertex_id")
    pair = cut(pair)
    blocked = sp.blocked_sight(pair.select(F.col("node_id").alias("sid"), "x1", "y1", "x2", "y2"), ring_edges).select(F.col("sid").alias("node_id"), F.lit(True).alias("blocked"))
    vland = sp.points_on_land(tv.select(F.col("vertex_id").alias("pid"), F.col("tlon").alias("lon"), F.col("tlat").alias("lat")), ring_edges, "half_open").select(
        F.col("pid").alias("vertex_id"), F.lit(True).alias("vertex_land"))
    pair = pair.join(blocked, "node_id", "left").join(vland, "vertex_id", "left").select("node_id.band", "node_id.node_id", "km", "blocked", "vertex_land")
    x = n.join(land, "node_id", "left").join(pair, ["band", "node_id"], "left")
    clear = sp.land_distance_km(nodes.select(F.col("node_id").alias("pid"), "lon", "lat"), ring_edges).select(F.col("pid").alias("node_id"), "land_km")
    x = x.join(clear, "node_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = (F.when(~F.col("primary"), "other").when(yes("on_land"), "land").when(F.col("km").isNull(), "far").when(yes("vertex_land"), "land")
             .when(yes("blocked"), "sight").otherwise("ok"))
    x = x.withColumns({"state": state, "sector": classify.ocean_sector("lon")})
    x = cut(x)
    ok = x.filter("state = 'ok'").groupBy("band", "lon", "lat").agg(F.min_by(F.struct("km", "land_km", "sector"), "node_id").alias("r")).select("band", "r.*")
    ok = cut(ok)
    head = x.groupBy("band").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("primary").alias("primary_nodes"), F.count_if(F.col("state") == "far").alias("too_far"),
        F.count_if(F.col("state") == "land").alias("land_hits"), F.count_if(F.col("state") == "sight").alias("sight_blocked"))
    nv = v.groupBy("band").agg(F.count(F.lit(1)).alias("vertices"))
    st = ok.groupBy("band").agg(F.count(F.lit(1)).alias("viable"), F.min("km").alias("min_km"), F.avg("km").alias("mean_km"), F.min("land_km").alias("min_clear"),
                                F.count_distinct("sector").alias("sectors"))
    q = element_at_rank(ok, ["band"], "km", [F.col("km")], {"median_km": 0.5, "p90_km": 0.9})
    qc = element_at_rank(ok, ["band"], "land_km", [F.col("land_km")], {"median_clear": 0.5})
    out = head.join(nv, "band", "left").join(st, "band", "left").join(q, "band", "left").join(qc, "band", "left")
    return out.fillna(0)


def sector_top(pairs: DataFrame, gateways: DataFrame, k: int = 6, per_sector: int = 2, max_catalog: int = MAX_BROADCAST) -> DataFrame:
    """Candidate gateways of each pair ``(pair_id, a_lon, a_lat, b_lon, b_lat)``: (pair_id, gateway_id, est_km, pick).

    Best estimate first (ties within 1e-4 km by id), up to ``per_sector`` per sector, then filled by rank.
    A catalogue is a few hundred fixed places. Its size is counted first: while small it travels to the
    tasks as one array and every pair picks its k inside its own row, so no pair-gateway rows are shuffled.
    A larger catalogue is cut into chunks that are reduced one after the other; a sector's best few and
    the overall best k can only come from the best of each chunk, so the result is the same.
    """
    cols = ["gateway_id", "sector", "polar_lon", "polar_lat", "global_lon", "global_lat", "gap_km"]
    cat = gateways.select(*cols)
    n = cat.limit(max_catalog + 1).count()
    chunks = 1 if n <= max_catalog else -(-cat.count() // max_catalog)
    best = None
    for i in range(chunks):
        part = cat if chunks == 1 else cat.filter(F.pmod(F.xxhash64("gateway_id"), F.lit(chunks)) == i)
        sector = F.coalesce("sector", F.lit("Other")).alias("sector")
        arr = part.groupBy(sector).agg(F.collect_list(F.struct(*cols)).alias("s")).agg(F.collect_list("s").alias("_cat"))
        x = pairs.select("pair_id", "a_lon", "a_lat", "b_lon", "b_lat").join(F.broadcast(arr))

        def estimate(gw):
            gap = gw["gap_km"]
            est = (geo.haversine_km("a_lon", "a_lat", gw["polar_lon"], gw["polar_lat"]) + geo.haversine_km(gw["global_lon"], gw["global_lat"], "b_lon", "b_lat")
                   + gap + F.when(gap > 5.0, gap * 2.0).otherwise(0.0))
            return F.struct(est.alias("est_km"), gw["gateway_id"].alias("gateway_id"), F.coalesce(gw["sector"], F.lit("Other")).alias("sector"))

        def score(v):
            return F.struct(F.round(v["est_km"], 4).alias("key"), v["gateway_id"].alias("gateway_id"), v["est_km"].alias("est_km"), v["sector"].alias("sector"))

        top = F.transform("_cat", lambda sec: _first(F.transform(F.transform(sec, estimate), score), per_sector + k))
        x = x.select("pair_id", top.alias("top"))
        best = x if best is None else best.unionByName(x)
    if chunks > 1:
        best = best.select("pair_id", F.explode("top").alias("s")).groupBy("pair_id", F.col("s")[0]["sector"].alias("sector")).agg(
            _first(F.flatten(F.collect_list("s")), per_sector + k).alias("s"))
        best = best.groupBy("pair_id").agg(F.collect_list("s").alias("top"))
    # the lists are sorted, so the position in its own list tells whether a gateway leads its sector
    marked = F.transform("top", lambda sec: F.transform(sec, lambda v, i: F.struct((i >= per_sector).alias("rest"), v.alias("v"))))
    out = best.select("pair_id", F.posexplode(_first(F.flatten(marked), k)).alias("pos", "m"))
    return out.select("pair_id", F.col("m.v.gateway_id").alias("gateway_id"), F.col("m.v.est_km").alias("est_km"), (F.col("pos") + 1).cast("bigint").alias("pick"))


def _first(arr: Column, n: int) -> Column:
    return F.slice(F.array_sort(arr), 1, n)


def gateway_usage(routes: DataFrame) -> DataFrame:
    """Routes per gateway from an array column ``gateway_ids``."""
    return routes.select(F.explode("gateway_ids").alias("gateway_id")).groupBy("gateway_id").agg(F.count(F.lit(1)).alias("n"))


def port_access(ports: DataFrame, nodes: DataFrame, gateways: DataFrame, components: DataFrame, max_km: float = 400.0) -> DataFrame:
    """Snap status, nearest gateway and whether the port's node reaches it through the graph."""
    p = ports.select("port_id", "lon", "lat")
    primary = g.primary_nodes(components)
    t = nodes.select("node_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    # four degrees of latitude are 444 km
    keep = None if max_km <= 440.0 else F.abs(F.col("tlat") - F.col("lat")) <= 4.0
    snap = sp.knn(p, "port_id", t, "node_id", 1, [max_km / 4.0, max_km], keep=keep)
    snap = snap.select("port_id", "node_id", F.col("km").alias("snap_km")).join(primary.withColumn("ok", F.lit(True)), "node_id", "left")
    tg = gateways.select("gateway_id", F.col("polar_lon").alias("tlon"), F.col("polar_lat").alias("tlat"))
    near = sp.knn(p, "port_id", tg, "gateway_id", 1, [1000.0, 4000.0, 20_100.0]).select("port_id", "gateway_id", F.col("km").alias("gateway_km"))
    gn = gateways.select("gateway_id", F.col("node_id").alias("b"))
    x = p.join(snap, "port_id", "left").join(near, "port_id", "left").join(gn, "gateway_id", "left")
    x = g.reachable(x.withColumnRenamed("node_id", "a"), components)
    ok = F.coalesce("ok", F.lit(False))
    return x.select("port_id", F.col("a").alias("node_id"), F.when(ok, "PASS").otherwise("REJECT").alias("snap_status"), "gateway_id", "gateway_km",
                    (ok & F.col("reachable")).alias("reachable"))


def component_nearest(nodes: DataFrame, components: DataFrame, ring_edges: DataFrame, gateways: DataFrame) -> DataFrame:
    """Minor components: size, distance to the nearest primary node within (1, 2) degrees, sight there, nearest gateway."""
    primary = g.primary_nodes(components)
    pos = nodes.select("node_id", "lon", "lat")
    minor = pos.join(primary, "node_id", "left_anti").join(components, "node_id")
    t = pos.join(primary, "node_id", "left_semi").select(F.col("node_id").alias("tid"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    box = (F.abs(F.col("lat") - F.col("tlat")) <= 1.0) & (F.abs(F.col("lon") - F.col("tlon")) <= 2.0)
    near = sp.knn(minor, "node_id", t, "tid", 1, [40.0, 255.0], keep=box).select("node_id", "tid", "km")
    near = near.join(minor, "node_id").groupBy("component_id").agg(F.min_by(F.struct("km", "node_id", "tid", "lon", "lat"), F.struct("km", "node_id", "tid")).alias("b"))
    seg = near.select(F.col("component_id").alias("sid"), F.col("b.lon").alias("x1"), F.col("b.lat").alias("y1"), F.col("b.tid").alias("tid")).join(
        t.withColumnsRenamed({"tlon": "x2", "tlat": "y2"}), "tid")
    blocked = sp.blocked_sight(seg.select("sid", "x1", "y1", "x2", "y2"), ring_edges).select(F.col("sid").alias("component_id"), F.lit(True).alias("blocked"))
    tg = gateways.select("gateway_id", F.col("polar_lon").alias("tlon"), F.col("polar_lat").alias("tlat"))
    gw = sp.knn(minor, "node_id", tg, "gateway_id", 1, [1000.0, 4000.0, 20_100.0]).join(minor.select("node_id", "component_id"), "node_id")
    gw = gw.groupBy("component_id").agg(F.min("km").alias("gateway_km"))
    size = minor.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    x = size.join(near.select("component_id", F.col("b.km").alias("primary_km")), "component_id", "left").join(blocked, "component_id", "left").join(gw, "component_id", "left")
    return x.select("component_id", "n_nodes", "primary_km", (F.col("primary_km").isNotNull() & F.col("blocked").isNull()).alias("sight"), "gateway_km")
