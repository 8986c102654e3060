"""Gateways, ports and registry reconciliation."""

from pyspark.sql import functions as F

from seaway.operators import gateways as gw
from seaway.operators import graph as g
from seaway.operators import ports as po
from seaway.operators import reconcile as rc
from seaway.operators import spatial as sp
from seaway.registry import register
from seaway.registry import sqltext as S
from seaway.registry.cleaning import _SECTOR
from seaway.registry.graphs import COMP, components, mesh
from seaway.registry.safety import outlines
from seaway.registry.spatial import ring_edges
from seaway.views import table, view


def rnd(df, **digits):
    return df.withColumns({k: F.round(k, d) for k, d in digits.items()})


def vertices(spark, sf):
    return view(spark, sf, "v_ports").select(F.col("port_id").alias("vertex_id"), "lon", "lat", (F.col("harbor_size") != "Small").alias("in_network"))


def discovered(spark, sf):
    n, e = mesh(spark, sf)
    return gw.discover_gateways(n, e, vertices(spark, sf), ring_edges(spark, sf), g.connected_components(n, e), lat=(-76.0, -43.0))


def _inland(rel, pid, x, y):
    return f"(SELECT DISTINCT {pid} AS pid FROM (SELECT {pid}, ring_id FROM {rel} JOIN v_ring_edges e ON {S.toggles(x, y, 'x1', 'y1', 'x2', 'y2', 'half_open')} GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1))"


def _sight(rel):
    """Blocked pairs of a relation with pid, ax, ay, ux, uy."""
    return f"""(SELECT pid FROM {rel} JOIN v_ring_edges e ON {S.planar_cross(('ax', 'ay'), ('ux', 'uy'), ('x1', 'y1'), ('x2', 'y2'))} UNION
  SELECT pid FROM (SELECT pid, ring_id FROM {rel} JOIN v_ring_edges e ON {S.toggles('((ax + ux) / 2)', '((ay + uy) / 2)', 'x1', 'y1', 'x2', 'y2', 'half_open')} GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1))"""


def _land_km(rel, pid):
    return f"""(SELECT {pid} AS pid, min({S.hav_km('p.lon', 'p.lat', 'x1', 'y1')}) AS km FROM {rel} p JOIN rb ON p.lon BETWEEN bx0 - 3 AND bx1 + 3 AND p.lat BETWEEN by0 - 3 AND by1 + 3
  JOIN v_ring_edges e ON e.ring_id = rb.ring_id GROUP BY 1)"""


_RB = "rb AS (SELECT ring_id, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM v_ring_edges GROUP BY 1)"
_SECT = _SECTOR.replace("w <", "(fmod(lon + 540, 360) - 180) <")
DISC = f"""{COMP}, {_RB},
 nn AS (SELECT node_id, lon, lat FROM v_mesh_nodes WHERE lat BETWEEN -76 AND -43), vv AS (SELECT port_id, lon AS tx, lat AS ty, harbor_size <> 'Small' AS net FROM v_ports WHERE lat BETWEEN -76 AND -43),
 nv AS (SELECT node_id AS pid, port_id, lon AS ax, lat AS ay, tx AS ux, ty AS uy, net, {S.hav_km('lon', 'lat', 'tx', 'ty')} AS km FROM nn JOIN vv ON abs(lon - tx) <= 4 OR abs(lon - tx) >= 356),
 bv AS (SELECT * FROM nv QUALIFY ROW_NUMBER() OVER (PARTITION BY pid ORDER BY km, port_id) = 1), gd AS (SELECT src, COUNT(*) AS deg FROM sy GROUP BY 1),
 il AS {_inland('nn', 'node_id', 'nn.lon', 'nn.lat')}, vl AS {_inland('vv', 'port_id', 'tx', 'ty')}, bk AS {_sight('bv')}, lk AS {_land_km('nn', 'node_id')},
 ev AS (SELECT node_id, lon, lat, port_id, bv.km, ux, uy, least(500, coalesce(lk.km, 500)) AS clr, coalesce(deg, 0) AS deg, {_SECT} AS sector,
   CASE WHEN component_id <> (SELECT component_id FROM pc) THEN 'NON_PRIMARY_COMPONENT' WHEN node_id IN (SELECT pid FROM il) THEN 'POLAR_NODE_IN_LAND'
    WHEN bv.km IS NULL THEN 'NO_GLOBAL_VERTEX_IN_RANGE' WHEN bv.km > 80 THEN 'DISTANCE_EXCEEDED' WHEN port_id IN (SELECT pid FROM vl) THEN 'GLOBAL_VERTEX_IN_LAND'
    WHEN node_id IN (SELECT pid FROM bk) THEN 'LINE_OF_SIGHT_BLOCKED' WHEN NOT net THEN 'GLOBAL_NETWORK_DISCONNECTED' END AS reason
   FROM nn LEFT JOIN bv ON bv.pid = node_id LEFT JOIN cp USING (node_id) LEFT JOIN gd ON gd.src = node_id LEFT JOIN lk ON lk.pid = node_id),
 gw AS (SELECT *, CASE WHEN reason IS NULL THEN 0.5e0 * greatest(0, 1 - km / 80) + 0.35e0 * least(1, clr / 200) + 0.15e0 * least(1, deg / 8e0) END AS score FROM ev)"""


@register("discover_gateways", f"""WITH {DISC} SELECT node_id, reason, sector, deg AS degree, round(clr, 5) AS clearance_km, round(score, 6) AS score,
  CASE WHEN reason IS NULL THEN port_id END AS vertex_id, CASE WHEN reason IS NULL THEN round(km, 5) END AS km FROM gw""")
def discover_gateways(spark, sf):
    x = discovered(spark, sf)
    ok = F.col("reason").isNull()
    return x.select("node_id", "reason", "sector", "degree", F.round("clearance_km", 5).alias("clearance_km"), F.round("score", 6).alias("score"),
                    F.when(ok, F.col("vertex_id")).alias("vertex_id"), F.when(ok, F.round("km", 5)).alias("km"))


@register("rank_gateways", f"WITH {DISC} SELECT node_id, round(score, 6) AS score FROM gw WHERE score IS NOT NULL ORDER BY gw.score DESC, node_id LIMIT 20")
def rank_gateways(spark, sf):
    return gw.rank_gateways(discovered(spark, sf)).select("node_id", F.round("score", 6).alias("score"))


@register("sector_distribution", f"""WITH {DISC}, al AS (SELECT DISTINCT {_SECTOR} AS sector FROM (SELECT unnest(range(-180, 180)) AS w))
 SELECT al.sector, COUNT(node_id) AS n FROM al LEFT JOIN (SELECT * FROM gw WHERE score IS NOT NULL) g ON g.sector = al.sector GROUP BY 1""")
def sector_distribution(spark, sf):
    return gw.sector_distribution(discovered(spark, sf).filter("score is not null"))


@register("gateway_catalog_summary", f"""WITH {DISC}, rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, node_id) AS rn FROM gw WHERE score IS NOT NULL)
 SELECT (SELECT COUNT(*) FROM gw) AS evaluated, (SELECT COUNT(*) FROM rk) AS valid, (SELECT COUNT(*) FROM gw WHERE reason IS NOT NULL) AS rejected, round(km, 5) AS median_km, round(clr, 5) AS median_clearance
 FROM rk WHERE rn - 1 = (SELECT COUNT(*) // 2 FROM rk)""")
def gateway_catalog_summary(spark, sf):
    return rnd(gw.gateway_catalog_summary(discovered(spark, sf)), median_km=5, median_clearance=5)


_LATS = (-75.0, -65.0, -55.0, -45.0)
CORR = f"""{COMP}, {_RB}, bd AS (SELECT UNNEST([{', '.join(f'{v}e0' for v in _LATS)}]) AS band),
 nn AS (SELECT band, node_id, lon, lat, component_id = (SELECT component_id FROM pc) AS prim FROM v_mesh_nodes JOIN bd ON lat BETWEEN band - 3 AND band + 3 JOIN cp USING (node_id)),
 vv AS (SELECT band, port_id, lon AS tx, lat AS ty FROM v_ports JOIN bd ON lat BETWEEN band - 3 AND band + 3),
 nv AS (SELECT node_id AS pid, nn.band, port_id, lon AS ax, lat AS ay, tx AS ux, ty AS uy, {S.hav_km('lon', 'lat', 'tx', 'ty')} AS km FROM nn JOIN vv ON nn.band = vv.band AND (abs(lon - tx) <= 3 OR abs(lon - tx) >= 357)),
 bv AS (SELECT * FROM nv QUALIFY ROW_NUMBER() OVER (PARTITION BY band, pid ORDER BY km, port_id) = 1),
 il AS {_inland('v_mesh_nodes n', 'node_id', 'n.lon', 'n.lat')}, vl AS {_inland('vv', 'port_id', 'tx', 'ty')}, bk AS {_sight('bv')}, lk AS {_land_km('v_mesh_nodes', 'node_id')},
 stt AS (SELECT nn.*, bv.km, least(500, coalesce(lk.km, 500)) AS clr, {_SECT} AS sector, CASE WHEN NOT prim THEN 'other' WHEN node_id IN (SELECT pid FROM il) THEN 'land' WHEN bv.km IS NULL OR bv.km > 100 THEN 'far'
   WHEN port_id IN (SELECT pid FROM vl) THEN 'land' WHEN node_id IN (SELECT pid FROM bk) THEN 'sight' ELSE 'ok' END AS state FROM nn LEFT JOIN bv ON bv.pid = node_id AND bv.band = nn.band LEFT JOIN lk ON lk.pid = node_id),
 okk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY band ORDER BY km) - 1 AS r1, ROW_NUMBER() OVER (PARTITION BY band ORDER BY clr) - 1 AS r2, COUNT(*) OVER (PARTITION BY band) AS n FROM stt WHERE state = 'ok')"""


@register("corridor_benchmark", f"""WITH {CORR}, hd AS (SELECT band, COUNT(*) AS candidates, COUNT(*) FILTER (prim) AS primary_nodes, COUNT(*) FILTER (state = 'far') AS too_far, COUNT(*) FILTER (state = 'land') AS land_hits,
   COUNT(*) FILTER (state = 'sight') AS sight_blocked FROM stt GROUP BY 1), vc AS (SELECT band, COUNT(*) AS vertices FROM vv GROUP BY 1),
 ot AS (SELECT band, COUNT(*) AS viable, min(km) AS min_km, avg(km) AS mean_km, min(clr) AS min_clear, COUNT(DISTINCT sector) AS sectors, max(km) FILTER (r1 = n // 2) AS median_km, max(km) FILTER (r1 = floor(n * 0.9e0)) AS p90_km,
   max(clr) FILTER (r2 = n // 2) AS median_clear FROM okk GROUP BY 1)
 SELECT hd.*, coalesce(vertices, 0) AS vertices, coalesce(viable, 0) AS viable, coalesce(sectors, 0) AS sectors, {', '.join(f'round(coalesce({c}, 0), 4) AS {c}' for c in ('min_km', 'mean_km', 'min_clear', 'median_km', 'p90_km', 'median_clear'))}
 FROM hd LEFT JOIN vc USING (band) LEFT JOIN ot USING (band)""")
def corridor_benchmark(spark, sf):
    n, e = mesh(spark, sf)
    x = gw.corridor_benchmark(n, vertices(spark, sf), ring_edges(spark, sf), g.connected_components(n, e), _LATS, half=3.0)
    return rnd(x, min_km=4, mean_km=4, min_clear=4, median_km=4, p90_km=4, median_clear=4)


def od_pairs(spark, sf):
    p = po.resolve_pairs(view(spark, sf, "v_pairs"), view(spark, sf, "v_ports"))
    return p.select("pair_id", "a_lon", "a_lat", "b_lon", "b_lat")


@register("resolve_pairs", "SELECT pair_id, a.lon AS a_lon, a.lat AS a_lat, b.lon AS b_lon, b.lat AS b_lat FROM v_pairs JOIN v_ports a ON a.port_id = origin_id JOIN v_ports b ON b.port_id = dest_id")
def resolve_pairs(spark, sf):
    return od_pairs(spark, sf)


EST = f"""es AS (SELECT pair_id, gateway_id, sector, {S.hav_km('a.lon', 'a.lat', 'polar_lon', 'polar_lat')} + {S.hav_km('global_lon', 'global_lat', 'b.lon', 'b.lat')} + gap_km + CASE WHEN gap_km > 5 THEN gap_km * 2 ELSE 0 END AS est
   FROM v_pairs JOIN v_ports a ON a.port_id = origin_id JOIN v_ports b ON b.port_id = dest_id CROSS JOIN v_gateways),
 r1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, sector ORDER BY round(est, 4), gateway_id) AS rs FROM es),
 r2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY CASE WHEN rs <= 2 THEN 0 ELSE 1 END, round(est, 4), gateway_id) AS pick FROM r1)"""


@register("sector_top", f"WITH {EST} SELECT pair_id, gateway_id, round(est, 4) AS est_km, pick FROM r2 WHERE pick <= 6")
def sector_top(spark, sf):
    return rnd(gw.sector_top(od_pairs(spark, sf), view(spark, sf, "v_gateways")), est_km=4)


@register("gateway_usage", f"WITH {EST} SELECT gateway_id, COUNT(*) AS n FROM r2 WHERE pick <= 6 GROUP BY 1")
def gateway_usage(spark, sf):
    t = sector_top(spark, sf).groupBy("pair_id").agg(F.collect_set("gateway_id").alias("gateway_ids"))
    return gw.gateway_usage(t)


@register("filter_primary_gateways", f"WITH {COMP} SELECT gateway_id FROM v_gateways WHERE node_id IN (SELECT node_id FROM cp WHERE component_id = (SELECT component_id FROM pc))")
def filter_primary_gateways(spark, sf):
    return view(spark, sf, "v_gateways").join(g.primary_nodes(components(spark, sf)), "node_id", "left_semi").select("gateway_id")


@register("port_access", f"""WITH {COMP}, sn AS (SELECT port_id, node_id, {S.hav_km('p.lon', 'p.lat', 'n.lon', 'n.lat')} AS km FROM v_ports p JOIN v_mesh_nodes n ON abs(p.lat - n.lat) <= 4),
 s1 AS (SELECT * FROM sn WHERE km <= 400 QUALIFY ROW_NUMBER() OVER (PARTITION BY port_id ORDER BY km, node_id) = 1),
 g1 AS (SELECT port_id, gateway_id, w.node_id AS gn, {S.hav_km('p.lon', 'p.lat', 'polar_lon', 'polar_lat')} AS km FROM v_ports p CROSS JOIN v_gateways w QUALIFY ROW_NUMBER() OVER (PARTITION BY port_id ORDER BY km, gateway_id) = 1)
 SELECT p.port_id, s1.node_id, CASE WHEN a.component_id = (SELECT component_id FROM pc) THEN 'PASS' ELSE 'REJECT' END AS snap_status, g1.gateway_id, round(g1.km, 4) AS gateway_km,
  coalesce(a.component_id = (SELECT component_id FROM pc) AND a.component_id = b.component_id, false) AS reachable
 FROM v_ports p LEFT JOIN s1 USING (port_id) LEFT JOIN g1 USING (port_id) LEFT JOIN cp a ON a.node_id = s1.node_id LEFT JOIN cp b ON b.node_id = g1.gn""")
def port_access(spark, sf):
    n, _ = mesh(spark, sf)
    return rnd(gw.port_access(view(spark, sf, "v_ports"), n, view(spark, sf, "v_gateways"), components(spark, sf)), gateway_km=4)


@register("component_nearest", f"""WITH {COMP}, ms AS (SELECT n.node_id, n.lon, n.lat, c.component_id FROM v_mesh_nodes n JOIN cp c USING (node_id)), pm AS (SELECT node_id AS tid, lon AS tx, lat AS ty FROM ms WHERE component_id = (SELECT component_id FROM pc)),
 mn AS (SELECT * FROM ms WHERE component_id <> (SELECT component_id FROM pc)), cd AS (SELECT component_id AS pid, node_id, tid, lon AS ax, lat AS ay, tx AS ux, ty AS uy, {S.hav_km('lon', 'lat', 'tx', 'ty')} AS km FROM mn JOIN pm ON abs(lat - ty) <= 1 AND abs(lon - tx) <= 2),
 b1 AS (SELECT * FROM cd QUALIFY ROW_NUMBER() OVER (PARTITION BY pid ORDER BY km, node_id, tid) = 1), bk AS {_sight('b1')},
 gk AS (SELECT component_id, min({S.hav_km('lon', 'lat', 'polar_lon', 'polar_lat')}) AS km FROM mn CROSS JOIN v_gateways GROUP BY 1)
 SELECT c.component_id, c.n_nodes, round(b1.km, 4) AS primary_km, b1.km IS NOT NULL AND c.component_id NOT IN (SELECT pid FROM bk) AS sight, round(gk.km, 4) AS gateway_km
 FROM (SELECT component_id, COUNT(*) AS n_nodes FROM mn GROUP BY 1) c LEFT JOIN b1 ON b1.pid = c.component_id LEFT JOIN gk USING (component_id)""")
def component_nearest(spark, sf):
    n, _ = mesh(spark, sf)
    return rnd(gw.component_nearest(n, components(spark, sf), ring_edges(spark, sf), view(spark, sf, "v_gateways")), primary_km=4, gateway_km=4)


def named_ports(spark, sf):
    p = view(spark, sf, "v_ports")
    return p.withColumn("alternate_name", F.concat_ws(" ", "harbor_type", "harbor_size"))


_TERMS = ["12", "customer#00000001", "ria", "nation_1", "asia", "river basin large", "  "]
_QT = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TERMS) if t.strip())


def _ladder(t, a, b, c):
    return f"CASE WHEN {t} = q THEN {a} WHEN starts_with({t}, q) THEN {b} WHEN contains({t}, q) THEN {c} ELSE 0 END"


@register("search_ports", f"""WITH p AS (SELECT port_id, CAST(port_id AS VARCHAR) AS pid, lower(port_name) AS nm, lower(concat_ws(' ', harbor_type, harbor_size)) AS al, lower(country) AS cy, lower(region_name) AS rg FROM v_ports),
 qt AS (SELECT * FROM (VALUES {_QT}) t(i, q) UNION ALL SELECT 1000 + min(port_id), substr(nm, 1, 16) AS q FROM p GROUP BY q UNION ALL SELECT -1 - min(port_id), cy FROM p GROUP BY cy),
 s AS (SELECT CAST(i AS BIGINT) AS query_id, port_id, CASE WHEN regexp_full_match(q, '[0-9]+') THEN CASE WHEN pid = q THEN 1000 WHEN starts_with(pid, q) THEN 500 ELSE 0 END ELSE 0 END
   + {_ladder('nm', 500, 300, 150)} + {_ladder('al', 400, 250, 100)} + CASE WHEN cy = q THEN 80 WHEN starts_with(cy, q) THEN 40 WHEN contains(rg, q) THEN 30 ELSE 0 END AS score FROM p CROSS JOIN qt)
 SELECT query_id, port_id, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, port_id) AS rank FROM s WHERE score > 0) WHERE rank <= 6""")
def search_ports(spark, sf):
    """Written-out terms, the beginnings of all port names, and all countries."""
    p = named_ports(spark, sf)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(_TERMS)], "query_id long, text string")
    names = p.groupBy(F.substring("port_name", 1, 16).alias("text")).agg((F.min("port_id") + 1000).alias("query_id"))
    countries = p.groupBy(F.col("country").alias("text")).agg((-1 - F.min("port_id")).alias("query_id"))
    return po.search_ports(q.unionByName(names).unionByName(countries), p)


_PRJ = f"""ip AS (SELECT port_id, min(ring_id) AS ring_id FROM (SELECT port_id, ring_id FROM v_ports p JOIN v_ring_edges e ON {S.toggles('p.lon', 'p.lat', 'x1', 'y1', 'x2', 'y2')} GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1) GROUP BY 1),
 pe AS (SELECT p.port_id, p.lon, p.lat, edge_idx, x1, y1, x2, y2, greatest(0e0, least(1e0, ((p.lon - x1) * (x2 - x1) + (p.lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM v_ports p JOIN ip USING (port_id) JOIN v_ring_edges e ON e.ring_id = ip.ring_id),
 pq AS (SELECT port_id, lon, lat, edge_idx, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM pe),
 pb AS (SELECT *, sqrt(pow(px - lon, 2) + pow(py - lat, 2)) AS d FROM pq QUALIFY ROW_NUMBER() OVER (PARTITION BY port_id ORDER BY pow(px - lon, 2) + pow(py - lat, 2), edge_idx) = 1),
 pw AS (SELECT p.port_id, p.lon, p.lat, coalesce(px + (px - p.lon) / d * 400 / (111000 * greatest(0.08, cos(radians(p.lat)))), p.lon) AS wlon, coalesce(py + (py - p.lat) / d * 400 / 111000e0, p.lat) AS wlat FROM v_ports p LEFT JOIN pb USING (port_id))"""


@register("project_to_water", f"WITH {_PRJ} SELECT port_id, round(wlon, 6) AS wlon, round(wlat, 6) AS wlat FROM pw")
def project_to_water(spark, sf):
    x = po.project_to_water(view(spark, sf, "v_ports").select("port_id", "lon", "lat"), ring_edges(spark, sf))
    return x.select("port_id", F.round("wlon", 6).alias("wlon"), F.round("wlat", 6).alias("wlat"))


_T = "(((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) / nullif((y2 - y1) * (ux - ax) - (x2 - x1) * (uy - ay), 0))"
SNAP = f"""{COMP}, {_PRJ}, sc AS (SELECT port_id, node_id, wlon AS px, wlat AS py, n.lon AS qx, n.lat AS qy, {S.hav_km('wlon', 'wlat', 'n.lon', 'n.lat')} AS km FROM pw JOIN v_mesh_nodes n ON abs(wlat - n.lat) < 4),
 sk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY port_id ORDER BY km, node_id) AS rank FROM sc WHERE km <= 400),
 sp AS (SELECT * FROM sk WHERE rank <= 50 AND node_id IN (SELECT node_id FROM cp WHERE component_id = (SELECT component_id FROM pc))),
 sg AS (SELECT port_id, node_id, px, py, px AS ax, py AS ay, qx AS ux, qy AS uy FROM sp WHERE abs(px - qx) <= 180
   UNION ALL SELECT port_id, node_id, px, py, px, py, CASE WHEN px < 0 THEN -180e0 ELSE 180e0 END, (py + qy) / 2 FROM sp WHERE abs(px - qx) > 180
   UNION ALL SELECT port_id, node_id, px, py, CASE WHEN px < 0 THEN 180e0 ELSE -180e0 END, (py + qy) / 2, qx, qy FROM sp WHERE abs(px - qx) > 180),
 sb AS (SELECT port_id, node_id FROM sg JOIN v_ring_edges e ON {S.planar_cross(('ax', 'ay'), ('ux', 'uy'), ('x1', 'y1'), ('x2', 'y2'))} WHERE {S.hav_km('px', 'py', f'(ax + {_T} * (ux - ax))', f'(ay + {_T} * (uy - ay))')} > 1.5
   UNION SELECT port_id, node_id FROM (SELECT port_id, node_id, ax, ring_id FROM sg JOIN v_ring_edges e ON {S.toggles('((ax + ux) / 2)', '((ay + uy) / 2)', 'x1', 'y1', 'x2', 'y2')} WHERE {S.hav_km('px', 'py', '((ax + ux) / 2)', '((ay + uy) / 2)')} > 1.5 GROUP BY 1, 2, 3, 4 HAVING COUNT(*) % 2 = 1)),
 sn AS (SELECT sp.* FROM sp WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.port_id = sp.port_id AND sb.node_id = sp.node_id) QUALIFY ROW_NUMBER() OVER (PARTITION BY port_id ORDER BY rank) = 1)"""


def snapped(spark, sf):
    n, _ = mesh(spark, sf)
    return po.snap_ports(view(spark, sf, "v_ports"), n, ring_edges(spark, sf), components(spark, sf))


@register("snap_ports", f"WITH {SNAP} SELECT port_id, node_id, round(km, 5) AS km, CASE WHEN rank <= 5 THEN 5 WHEN rank <= 10 THEN 10 WHEN rank <= 20 THEN 20 ELSE 50 END AS stage FROM sn")
def snap_ports(spark, sf):
    return snapped(spark, sf).select("port_id", "node_id", F.round("km", 5).alias("km"), "stage")


# --- reconciliation -----------------------------------------------------------------------------------


def registry_inputs(spark, sf):
    b = view(spark, sf, "v_bergs")
    grounded = b.filter("source = 'GROUNDED'").select(F.col("berg_id").alias("tid"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), F.col("fast_ice_status").alias("status"))
    base = b.select("berg_id", "lon", "lat", "area_km2", "source")
    return base, view(spark, sf, "v_bergs_prev"), view(spark, sf, "v_track_points"), grounded


def reconciled(spark, sf):
    return rc.reconcile(*registry_inputs(spark, sf))


REC = f"""fx AS (SELECT track_id, COUNT(*) AS fix_count, arg_max(lon, seq) AS fl, arg_max(lat, seq) AS fa, arg_max(ts, seq) AS ft FROM v_track_points GROUP BY 1),
 gd AS (SELECT b.berg_id, g.berg_id AS tid, g.fast_ice_status AS status, {S.hav_km('b.lon', 'b.lat', 'g.lon', 'g.lat')} AS gkm FROM v_bergs b JOIN v_bergs g ON g.source = 'GROUNDED' AND abs(floor(b.lon) - floor(g.lon)) <= 2 AND abs(floor(b.lat) - floor(g.lat)) <= 2
   QUALIFY ROW_NUMBER() OVER (PARTITION BY b.berg_id ORDER BY gkm, tid) = 1),
 rx AS (SELECT b.berg_id, b.lon, b.lat, b.area_km2, p.lon AS prev_lon, p.lat AS prev_lat, p.area_km2 AS prev_area, p.berg_id IS NOT NULL AS in_prev, coalesce({S.hav_km('b.lon', 'b.lat', 'p.lon', 'p.lat')}, 0) AS shift_km,
   CASE WHEN p.area_km2 > 0 THEN abs(b.area_km2 - p.area_km2) / p.area_km2 * 100 ELSE 0 END AS area_pct, fix_count, fl, fa, {S.hav_km('b.lon', 'b.lat', 'fl', 'fa')} AS track_km, tid, status, gkm,
   1 + CAST(p.berg_id IS NOT NULL AS INT) + CAST(fix_count IS NOT NULL AS INT) + CAST(coalesce(gkm <= 30, false) AS INT) AS match_count
   FROM v_bergs b LEFT JOIN v_bergs_prev p USING (berg_id) LEFT JOIN fx ON fx.track_id = b.berg_id LEFT JOIN gd USING (berg_id))"""
_PC = "CASE WHEN shift_km > 5 THEN 'Drifting (Open Ocean)' WHEN gkm > 0 AND gkm <= 25 THEN 'Grounded (Coastal / Fast-Ice: ' || status || ')' ELSE 'Stationary / Entrapped (Pack Ice)' END"


@register("compare_snapshots", f"WITH {REC} SELECT berg_id, in_prev, round(shift_km, 5) AS shift_km, round(area_pct, 6) AS area_pct FROM rx")
def compare_snapshots(spark, sf):
    base, prev, *_ = registry_inputs(spark, sf)
    return rnd(rc.compare_snapshots(base, prev), shift_km=5, area_pct=6).select("berg_id", "in_prev", "shift_km", "area_pct")


@register("attach_last_fix", f"WITH {REC} SELECT berg_id, fix_count, round(track_km, 4) AS track_km FROM rx")
def attach_last_fix(spark, sf):
    base, _, fixes, _ = registry_inputs(spark, sf)
    return rnd(rc.attach_last_fix(base, fixes), track_km=4).select("berg_id", "fix_count", "track_km")


@register("attach_attributes", "SELECT berg_id, coalesce(CAST(p.size_nm AS VARCHAR), '08/27/2026') AS last_update FROM v_bergs b LEFT JOIN v_bergs_prev p USING (berg_id)")
def attach_attributes(spark, sf):
    base, prev, *_ = registry_inputs(spark, sf)
    attrs = prev.select("berg_id", F.col("size_nm").cast("string").alias("last_update"))
    return rc.attach_attributes(base, attrs, "berg_id", "last_update", "08/27/2026").select("berg_id", "last_update")


@register("missing_from_baseline", f"WITH {REC} SELECT track_id AS berg_id, fix_count, fl AS lon, ft AS last_ts, CAST(NULL AS VARCHAR) AS why_absent FROM fx WHERE track_id NOT IN (SELECT berg_id FROM v_bergs_prev) AND year(ft) >= 2024")
def missing_from_baseline(spark, sf):
    _, prev, fixes, _ = registry_inputs(spark, sf)
    return rc.missing_from_baseline(fixes, prev).select("berg_id", "fix_count", "lon", "last_ts", "why_absent")


@register("reconcile", f"""WITH {REC} SELECT berg_id, match_count, CASE WHEN match_count >= 2 THEN 'CONFIRMED_MATCH' ELSE 'SOURCE_EXCLUSIVE' END AS identity_status, {_PC} AS physical_class,
  CASE WHEN shift_km > 1 THEN 'TEMPORAL_POSITION_UPDATE' ELSE 'TEMPORAL_STABLE' END AS temporal_status, CASE WHEN shift_km > 1 THEN 'CONFIRMED CORRECTION' ELSE 'NO CHANGE REQUIRED' END AS decision,
  concat_ws('|', 'BASELINE', CASE WHEN in_prev THEN 'PREVIOUS' END, CASE WHEN fix_count IS NOT NULL THEN 'TRACKS' END, CASE WHEN gkm <= 30 THEN 'GROUNDED' END) AS sources FROM rx""")
def reconcile(spark, sf):
    return reconciled(spark, sf).select("berg_id", "match_count", "identity_status", "physical_class", "temporal_status", "decision", F.array_join("sources", "|").alias("sources"))


@register("coordinate_discrepancies", f"WITH {REC} SELECT berg_id, lon, lat, prev_lon, prev_lat, round(shift_km, 2) AS shift_km FROM rx WHERE shift_km > 1")
def coordinate_discrepancies(spark, sf):
    return rc.coordinate_discrepancies(reconciled(spark, sf))


@register("size_discrepancies", f"WITH {REC} SELECT berg_id, area_km2, prev_area, round(area_pct, 2) AS area_pct FROM rx WHERE area_pct > 0.1")
def size_discrepancies(spark, sf):
    return rc.size_discrepancies(reconciled(spark, sf))


@register("corrections", f"""WITH {REC} SELECT berg_id, 'COORDINATES_AND_OBSERVATION_DATE' AS attribute, prev_lon AS old_lon, lon AS new_lon, CAST(NULL AS DOUBLE) AS old_area, round(shift_km, 2) AS amount FROM rx WHERE shift_km > 1
  UNION ALL SELECT berg_id, 'AREA_AND_DIMENSIONS', NULL, NULL, prev_area, round(area_pct, 2) FROM rx WHERE area_pct > 0.1""")
def corrections(spark, sf):
    c = rc.corrections(reconciled(spark, sf))
    return c.select("berg_id", "attribute", F.col("old.lon").alias("old_lon"), F.col("new.lon").alias("new_lon"), F.col("old.area_km2").alias("old_area"), "amount")


@register("cross_matches", f"""WITH {REC} SELECT berg_id, match_count, CASE WHEN shift_km > 5 THEN 'YES (TEMPORAL_DRIFT_EXPLAINED)' ELSE 'YES (STABLE)' END AS coordinate_agreement,
  CASE WHEN area_pct < 10 THEN 'YES' ELSE 'CALVING_ADJUSTED' END AS size_agreement, fix_count IS NOT NULL AS track_available, CASE WHEN gkm > 0 THEN round(gkm, 2) END AS grounded_km FROM rx""")
def cross_matches(spark, sf):
    return rc.cross_matches(reconciled(spark, sf)).drop("sources")


@register("apply_update", """SELECT b.berg_id, k AS vidx, round(b.lon + b.half_lon * CASE k WHEN 0 THEN 1 WHEN 2 THEN -1 WHEN 4 THEN 1 ELSE 0 END + coalesce(b.lon - p.lon, 0), 6) AS lon,
  round(b.lat + b.half_lat * CASE k WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END + coalesce(b.lat - p.lat, 0), 6) AS lat FROM v_bergs b LEFT JOIN v_bergs_prev p USING (berg_id) CROSS JOIN (SELECT CAST(UNNEST([0, 1, 2, 3, 4]) AS BIGINT) AS k)""")
def apply_update(spark, sf):
    base, prev, *_ = registry_inputs(spark, sf)
    return rc.apply_update(base, prev, outlines(spark, sf))[1]


@register("updated_status", "SELECT berg_id, CASE WHEN abs(coalesce(b.lat - p.lat, 0)) > 0.05 OR abs(coalesce(b.lon - p.lon, 0)) > 0.05 THEN 'Drifting' ELSE 'Grounded/Stationary' END AS status FROM v_bergs b LEFT JOIN v_bergs_prev p USING (berg_id)")
def updated_status(spark, sf):
    base, prev, *_ = registry_inputs(spark, sf)
    return rc.apply_update(base, prev, outlines(spark, sf))[0].select("berg_id", "status")


@register("audit_trail", "SELECT berg_id, p.lat AS prev_lat, b.lat AS new_lat, p.area_km2 AS prev_area, b.area_km2 AS new_area FROM v_bergs b LEFT JOIN v_bergs_prev p USING (berg_id)")
def audit_trail(spark, sf):
    base, prev, *_ = registry_inputs(spark, sf)
    a = rc.audit_trail(base, prev)
    return a.select("berg_id", F.col("lat.previous").alias("prev_lat"), F.col("lat.updated").alias("new_lat"), F.col("area_km2.previous").alias("prev_area"), F.col("area_km2.updated").alias("new_area"))


@register("source_reports", f"""WITH {REC} SELECT 'total_baseline' AS report, COUNT(*) AS n FROM rx UNION ALL SELECT 'track_matched', COUNT(fix_count) FROM rx UNION ALL SELECT 'grounded_matched', COUNT(*) FILTER (gkm <= 30) FROM rx
  UNION ALL SELECT 'cross_source_matches', COUNT(*) FILTER (match_count >= 2) FROM rx UNION ALL SELECT 'corrections', COUNT(*) FILTER (shift_km > 1) + COUNT(*) FILTER (area_pct > 0.1) FROM rx""")
def source_reports(spark, sf):
    x = reconciled(spark, sf)
    return rc.source_reports(x, rc.corrections(x))


@register("compare_runs", """SELECT o_orderkey AS pair_id, o_orderstatus AS status, o_orderpriority AS new_status, CASE WHEN o_totalprice - 200000 > 0 AND o_totalprice - 100000 > 0 THEN round((o_totalprice - 100000) - (o_totalprice - 200000) * 1.01e0, 4) END AS delta_km FROM orders""")
def compare_runs(spark, sf):
    o = table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderstatus").alias("status"), (F.when(F.col("o_totalprice") > 200000, (F.col("o_totalprice") - 200000) * 1.01).otherwise(0.0)).alias("km"))
    new = o.select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("status"), (F.col("o_totalprice") - 100000).alias("km"))
    return rnd(rc.compare_runs(old, new), delta_km=4)


@register("latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events")
def latency_percentiles(spark, sf):
    e = table(spark, sf, "events").select(F.col("value").alias("ms"))
    return rnd(rc.latency_percentiles(e), p50=6, p90=6, p95=6)
