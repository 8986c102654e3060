"""Graph operators on the mesh views."""

from pyspark.sql import functions as F

from seaway.operators import graph as g
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.registry.spatial import ring_edges
from seaway.views import table, view


def mesh(spark, sf):
    return view(spark, sf, "v_mesh_nodes"), view(spark, sf, "v_mesh_edges")


def components(spark, sf):
    return g.connected_components(*mesh(spark, sf))


SYM = "(SELECT src, dst, weight_km FROM v_mesh_edges UNION ALL SELECT dst, src, weight_km FROM v_mesh_edges)"
COMP = f"""RECURSIVE sy AS {SYM}, rc(n, l) AS (SELECT node_id, node_id FROM v_mesh_nodes UNION SELECT sy.dst, rc.l FROM rc JOIN sy ON sy.src = rc.n WHERE rc.l < sy.dst),
 cp AS (SELECT n AS node_id, MIN(l) AS component_id FROM rc GROUP BY n),
 pc AS (SELECT component_id, COUNT(*) AS n FROM cp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@register("connected_components", f"WITH {COMP} SELECT node_id, component_id FROM cp")
def connected_components(spark, sf):
    return components(spark, sf)


@register("component_sizes", f"WITH {COMP} SELECT component_id, COUNT(*) AS n FROM cp GROUP BY 1")
def component_sizes(spark, sf):
    return g.component_sizes(components(spark, sf))


@register("primary_component", f"WITH {COMP} SELECT component_id, n FROM pc")
def primary_component(spark, sf):
    return g.primary_component(components(spark, sf))


@register("node_degree", f"SELECT node_id, COUNT(dst) AS degree FROM v_mesh_nodes LEFT JOIN {SYM} ON src = node_id GROUP BY 1")
def node_degree(spark, sf):
    return g.node_degree(*mesh(spark, sf))


@register("prune_isolated", f"SELECT node_id FROM v_mesh_nodes WHERE node_id IN (SELECT src FROM {SYM})")
def prune_isolated(spark, sf):
    return g.prune_isolated(*mesh(spark, sf)).select("node_id")


_GONE = "(SELECT c_custkey AS node_id FROM customer WHERE c_acctbal > 8000)"


@register("exclude_nodes", f"SELECT src, dst FROM v_mesh_edges WHERE src NOT IN (SELECT node_id FROM {_GONE}) AND dst NOT IN (SELECT node_id FROM {_GONE})")
def exclude_nodes(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("node_id"))
    return g.drop_nodes(*mesh(spark, sf), gone)[1].select("src", "dst")


@register("mirrored_edges", f"SELECT src, dst, weight_km FROM {SYM}")
def mirrored_edges(spark, sf):
    return g.mirrored(view(spark, sf, "v_mesh_edges"))


_RAWE = """(SELECT a.lon + 0.0002e0 AS x1, a.lat AS y1, b.lon AS x2, b.lat + CASE WHEN weight_km > 30 THEN 0.3e0 ELSE 0.0001e0 END AS y2, weight_km, src, dst FROM v_mesh_edges JOIN v_mesh_nodes a ON a.node_id = src JOIN v_mesh_nodes b ON b.node_id = dst)"""


@register("resolve_edges", f"""SELECT a.node_id AS src, b.node_id AS dst, weight_km FROM {_RAWE} r
  JOIN v_mesh_nodes a ON floor(a.lon * 1000 + 0.5) = floor(x1 * 1000 + 0.5) AND floor(a.lat * 1000 + 0.5) = floor(y1 * 1000 + 0.5)
  JOIN v_mesh_nodes b ON floor(b.lon * 1000 + 0.5) = floor(x2 * 1000 + 0.5) AND floor(b.lat * 1000 + 0.5) = floor(y2 * 1000 + 0.5)""")
def resolve_edges(spark, sf):
    n, e = mesh(spark, sf)
    a = n.select(F.col("node_id").alias("src"), (F.col("lon") + 0.0002).alias("x1"), F.col("lat").alias("y1"))
    b = n.select(F.col("node_id").alias("dst"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    raw = e.join(a, "src").join(b, "dst").drop("src", "dst").withColumn("y2", F.col("y2") + F.when(F.col("weight_km") > 30, 0.3).otherwise(0.0001))
    return g.resolve_edges(n, raw)


@register("network_vertices", """SELECT arg_min(port_id, port_id) AS vertex_id, kx, ky FROM (SELECT port_id, round(lon / 10, 0) AS kx, round(lat / 10, 0) AS ky FROM v_ports) GROUP BY kx, ky""")
def network_vertices(spark, sf):
    from seaway.sources.readers import network_vertices as op

    p = view(spark, sf, "v_ports").select((F.col("lon") / 10).alias("lon"), (F.col("lat") / 10).alias("lat"), F.col("port_id").alias("ord"))
    return op(p, digits=0).select(F.col("ord").alias("vertex_id"), "kx", "ky")


@register("drop_long_edges_in_box", """SELECT src, dst FROM v_mesh_edges WHERE NOT (weight_km > 20 AND (src IN (SELECT node_id FROM v_mesh_nodes WHERE lon BETWEEN -90 AND 0 AND lat BETWEEN -70 AND -50)
  OR dst IN (SELECT node_id FROM v_mesh_nodes WHERE lon BETWEEN -90 AND 0 AND lat BETWEEN -70 AND -50)))""")
def drop_long_edges_in_box(spark, sf):
    n, e = mesh(spark, sf)
    return g.drop_long_edges_in_box(e, n, (-90.0, -70.0, 0.0, -50.0)).select("src", "dst")


_SW = f"round(2e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(9) / 2), 2))) * {S.R} / 1000e0, 2)"
_SH = "(SELECT x1, y1, x2, y2 FROM v_ring_edges UNION ALL SELECT CASE WHEN x1 < 0 THEN x1 + 360 ELSE x1 END, y1, CASE WHEN x2 < 0 THEN x2 + 360 ELSE x2 END, y2 FROM v_ring_edges WHERE x1 < -170 OR x2 < -170)"


@register("stitch_antimeridian", f"""SELECT a.node_id AS src, b.node_id AS dst, {_SW} AS weight_km FROM v_mesh_nodes a JOIN v_mesh_nodes b ON a.lon = 171 AND b.lon = -180 AND abs(a.node_id // 40 - b.node_id // 40) <= 1
  WHERE NOT EXISTS (SELECT 1 FROM {_SH} e WHERE {S.planar_cross(('a.lon', 'a.lat'), ('(b.lon + 360)', 'b.lat'), ('x1', 'y1'), ('x2', 'y2'))})""")
def stitch_antimeridian(spark, sf):
    n = view(spark, sf, "v_mesh_nodes")
    return g.stitch_antimeridian(n, ring_edges(spark, sf), F.floor(F.col("node_id") / 40), east=171.0)


@register("check_graph", f"""WITH {COMP} SELECT 'duplicate_coordinates' AS issue, CAST(COUNT(*) - COUNT(DISTINCT (lon, lat)) AS BIGINT) AS n FROM v_mesh_nodes
  UNION ALL SELECT 'bad_weights', COUNT(*) FILTER (weight_km <= 0) FROM v_mesh_edges
  UNION ALL SELECT 'dangling_edges', COUNT(*) FROM v_mesh_edges WHERE src NOT IN (SELECT node_id FROM v_mesh_nodes) OR dst NOT IN (SELECT node_id FROM v_mesh_nodes)
  UNION ALL SELECT 'components', COUNT(DISTINCT component_id) FROM cp""")
def check_graph(spark, sf):
    n, e = mesh(spark, sf)
    return g.check_graph(n, e, g.connected_components(n, e))


@register("reachable_pairs", f"WITH {COMP} SELECT pair_id, coalesce(a.component_id = b.component_id, false) AS reachable FROM v_pairs LEFT JOIN cp a ON a.node_id = origin_id LEFT JOIN cp b ON b.node_id = dest_id")
def reachable_pairs(spark, sf):
    p = view(spark, sf, "v_pairs").select("pair_id", F.col("origin_id").alias("a"), F.col("dest_id").alias("b"))
    return g.reachable(p, components(spark, sf)).select("pair_id", "reachable")


def gateway_paths(spark, sf):
    """Distances from every gateway node to the whole mesh."""
    src = view(spark, sf, "v_gateways").select(F.col("node_id").alias("source"))
    return g.shortest_paths(view(spark, sf, "v_mesh_edges"), src)


_SP = f"""RECURSIVE sy AS {SYM}, r(s, n, d) USING KEY (s, n) AS (SELECT node_id, node_id, CAST(0 AS BIGINT) FROM v_gateways
  UNION SELECT r.s, sy.dst, MIN(r.d + sy.weight_km) FROM r JOIN sy ON sy.src = r.n LEFT JOIN recurring.r q ON q.s = r.s AND q.n = sy.dst WHERE q.d IS NULL OR r.d + sy.weight_km < q.d GROUP BY r.s, sy.dst),
 b AS (SELECT s, n, d FROM r)"""


@register("shortest_paths", f"""WITH {_SP} SELECT b.s AS source, b.n AS node_id, CAST(b.d AS BIGINT) AS dist_km, MIN(p.n) AS pred FROM b LEFT JOIN (SELECT b.s, b.n, b.d, sy.dst, sy.weight_km FROM b JOIN sy ON sy.src = b.n) p
  ON p.s = b.s AND p.dst = b.n AND p.d + p.weight_km = b.d GROUP BY 1, 2, 3""")
def shortest_paths(spark, sf):
    return gateway_paths(spark, sf).select("source", "node_id", F.col("dist_km").cast("bigint").alias("dist_km"), "pred")


@register("path_points", f"""WITH {_SP}, pr AS (SELECT b.s AS source, b.n AS node_id, MIN(p.n) AS pred FROM b LEFT JOIN (SELECT b.s, b.n, b.d, sy.dst, sy.weight_km FROM b JOIN sy ON sy.src = b.n) p
  ON p.s = b.s AND p.dst = b.n AND p.d + p.weight_km = b.d GROUP BY 1, 2, b.d),
 walk(source, target, node_id, back, pred) AS (SELECT source, node_id, node_id, CAST(0 AS BIGINT), pred FROM pr
  UNION ALL SELECT w.source, w.target, w.pred, w.back + 1, p.pred FROM walk w JOIN pr p ON p.source = w.source AND p.node_id = w.pred)
 SELECT source, target, CAST(max(back) OVER (PARTITION BY source, target) - back AS BIGINT) AS hop, node_id FROM walk""")
def path_points(spark, sf):
    """Paths from every gateway node to every node it reaches."""
    p = gateway_paths(spark, sf)
    return g.path_points(p, p.select("source", F.col("node_id").alias("target")))


@register("restrict_edges", "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def restrict_edges(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("tag"))
    return g.restrict_edges(li, ["A", "N"]).select("src", "dst")
