"""Cleaning, reject rules, labels and build statistics."""

from pyspark.sql import functions as F

from seaway.functions import classify, clean
from seaway.operators import ingest
from seaway.registry import register
from seaway.views import table, view


def _raw(spark, sf):
    return view(spark, sf, "v_raw_rows")


_NUM = "TRY_CAST(trim({}) AS DOUBLE)".format


@register("clean_text", f"""SELECT row_no, CASE WHEN trim(size_raw) <> '' AND lower(trim(size_raw)) <> 'unknown' THEN trim(size_raw) END AS txt,
  nullif({_NUM('size_raw')}, 0) AS zero_null, coalesce({_NUM('lon_raw')}, -1) AS num, CAST(trunc({_NUM('id_raw')}) AS BIGINT) AS id,
  TRY_CAST(trim(replace(replace(size_raw, 'NM', ''), 'nm', '')) AS DOUBLE) AS nm, CASE WHEN lat_raw <> '0' THEN {_NUM('lat_raw')} END AS size FROM v_raw_rows""")
def clean_text(spark, sf):
    return _raw(spark, sf).select(
        "row_no", clean.clean_str("size_raw").alias("txt"), clean.clean_num_zero_null("size_raw").alias("zero_null"),
        clean.clean_num_default("lon_raw", -1, finite=True).alias("num"), clean.parse_int_via_float("id_raw").alias("id"),
        clean.parse_nm("size_raw").alias("nm"), clean.size_or_null("lat_raw").alias("size"))


@register("parse_yyyyddd", """SELECT row_no, CASE WHEN d BETWEEN 1000000 AND 9999999 THEN CAST(make_date(CAST(d // 1000 AS INT), 1, 1)
  + CAST(d % 1000 - 1 AS INT) AS VARCHAR) END AS strict, CASE WHEN d2 BETWEEN 1000000 AND 9999999 THEN CAST(make_date(CAST(d2 // 1000 AS INT), 1, 1)
  + CAST(d2 % 1000 - 1 AS INT) AS VARCHAR) ELSE id_raw END AS lenient
  FROM (SELECT *, CAST(yyyyddd AS BIGINT) AS d, CAST(trunc(TRY_CAST(trim(id_raw) AS DOUBLE)) AS BIGINT) AS d2 FROM v_raw_rows)""")
def parse_yyyyddd(spark, sf):
    return _raw(spark, sf).select("row_no", clean.parse_yyyyddd("yyyyddd").alias("strict"),
                                  clean.parse_yyyyddd("id_raw", strict=False).alias("lenient"))


def _rules():
    return clean.port_rules("id_raw", "name_raw", "lat_raw", "lon_raw")


_REASON = f"""CASE WHEN trim(id_raw) = '' THEN 'missing id' WHEN {_NUM('id_raw')} IS NULL THEN 'non-numeric id'
  WHEN trim(name_raw) = '' THEN 'missing name' WHEN trim(lat_raw) = '' OR trim(lon_raw) = '' THEN 'missing coordinates'
  WHEN {_NUM('lat_raw')} IS NULL OR {_NUM('lon_raw')} IS NULL THEN 'non-numeric coordinates'
  WHEN NOT ({_NUM('lat_raw')} BETWEEN -90 AND 90) THEN 'latitude out of range'
  WHEN NOT ({_NUM('lon_raw')} BETWEEN -180 AND 180) THEN 'longitude out of range' END"""


@register("split_valid", f"SELECT row_no, {_REASON} AS reason FROM v_raw_rows WHERE {_REASON} IS NOT NULL")
def split_valid_rejects(spark, sf):
    return ingest.split_valid(_raw(spark, sf), _rules())[1].select("row_no", "reason")


@register("valid_rows", f"SELECT row_no, CAST({_NUM('id_raw')} AS BIGINT) AS id, {_NUM('lat_raw')} AS lat, {_NUM('lon_raw')} AS lon FROM v_raw_rows WHERE {_REASON} IS NULL")
def valid_rows(spark, sf):
    ok = ingest.split_valid(_raw(spark, sf), _rules())[0]
    return ok.select("row_no", clean.parse_int_via_float("id_raw").alias("id"), clean.to_double("lat_raw").alias("lat"),
                     clean.to_double("lon_raw").alias("lon"))


@register("ingest_counts", f"SELECT COUNT(*) AS raw, COUNT(*) FILTER ({_REASON} IS NULL) AS valid, COUNT(*) FILTER ({_REASON} IS NOT NULL) AS rejected FROM v_raw_rows")
def ingest_counts(spark, sf):
    return ingest.ingest_counts(_raw(spark, sf), _rules())


@register("reject_counts", f"SELECT coalesce({_REASON}, 'valid') AS reason, COUNT(*) AS n FROM v_raw_rows GROUP BY 1")
def reject_counts(spark, sf):
    return ingest.reject_counts(_raw(spark, sf), _rules())


@register("pick_sensor", """SELECT event_id, CASE WHEN lat1 <> 0 AND lon1 <> 0 AND lon1 BETWEEN -180 AND 180 THEN 'ASCAT' WHEN value BETWEEN 0.01 AND 90 THEN 'QSCAT' WHEN lon1 <> 0 AND lon1 BETWEEN -180 AND 180 THEN 'NIC' END AS sensor,
  CASE WHEN lat1 <> 0 AND lon1 <> 0 AND lon1 BETWEEN -180 AND 180 THEN lat1 WHEN value BETWEEN 0.01 AND 90 THEN -value WHEN lon1 <> 0 AND lon1 BETWEEN -180 AND 180 THEN -60e0 END AS lat
  FROM (SELECT event_id, value, CASE event_type WHEN 'error' THEN 0e0 WHEN 'view' THEN -95e0 ELSE -50 - value / 100 END AS lat0,
  CASE event_type WHEN 'error' THEN 0e0 WHEN 'view' THEN 0e0 ELSE -50 - value / 100 END AS lat1, value - 20 AS lon1 FROM events)""")
def pick_sensor(spark, sf):
    e = table(spark, sf, "events")
    lat = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "view", -95.0).otherwise(-50 - F.col("value") / 100)
    fixes = {"ascat": (lat, F.col("value") - 20), "qscat": (-F.col("value"), F.lit(10.0)), "nic": (F.lit(-60.0), F.col("value") - 20)}
    none = F.lit(None).cast("double")
    s = e.select("event_id", clean.pick_sensor(lambda n: fixes.get(n, (none, none))).alias("s"))
    return s.select("event_id", F.col("s.sensor").alias("sensor"), F.col("s.lat").alias("lat"))


@register("last_row_wins", """SELECT id, event_id, value FROM (SELECT trim(event_type || ' ' || CAST(user_id AS VARCHAR)) AS id, event_id, value,
  ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_row_wins(spark, sf):
    e = table(spark, sf, "events")
    key = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))
    return ingest.last_row_wins(e, key, F.struct("ts", "event_id")).select("id", "event_id", "value")


def _verts(spark, sf):
    """Closed outlines, three islands to a geometry."""
    e = view(spark, sf, "v_ring_edges")
    v = e.select("ring_id", F.col("edge_idx").alias("idx"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    return v.unionByName(v.filter("idx = 0").withColumn("idx", F.lit(6).cast("bigint")))


@register("largest_part", """
WITH v AS (SELECT CAST(floor(ring_id / 3) AS BIGINT) AS geom_id, ring_id % 3 AS part_no, edge_idx AS idx, x1, y1, x2, y2 FROM v_ring_edges),
 a AS (SELECT geom_id, part_no, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM v GROUP BY ALL),
 b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY geom_id ORDER BY area DESC, part_no) AS rn FROM a),
 p AS (SELECT geom_id, part_no, idx, x1 AS lon, y1 AS lat FROM v UNION ALL SELECT geom_id, part_no, 6, x1, y1 FROM v WHERE idx = 0)
SELECT geom_id, part_no, idx, round(lon, 5) AS lon, round(lat, 5) AS lat, round(area, 6) AS area FROM p JOIN b USING (geom_id, part_no) WHERE rn = 1""")
def largest_part(spark, sf):
    v = _verts(spark, sf).select(F.floor(F.col("ring_id") / 3).alias("geom_id"), (F.col("ring_id") % 3).alias("part_no"), "idx", "lon", "lat")
    return ingest.largest_part(v).withColumn("area", F.round("area", 6))


_OPEN = "(SELECT ring_id, edge_idx AS idx, floor(x1 * 10000 + 0.5) / 1e4 AS lon, floor(y1 * 10000 + 0.5) / 1e4 AS lat FROM v_ring_edges)"


@register("normalise_ring", f"SELECT * FROM {_OPEN} UNION ALL SELECT ring_id, 6, lon, lat FROM {_OPEN} WHERE idx = 0")
def normalise_ring(spark, sf):
    return ingest.normalise_ring(_verts(spark, sf).filter("idx < 6"))[0]


@register("ring_boxes", f"SELECT ring_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM {_OPEN} GROUP BY 1")
def ring_boxes(spark, sf):
    return ingest.normalise_ring(_verts(spark, sf).filter("idx < 6"))[1]


@register("target_stats", """SELECT COUNT(*) AS total, COUNT(*) FILTER (fast_ice_status = 'Outside') AS outside, COUNT(*) FILTER (fast_ice_status = 'Inside') AS inside,
  COUNT(*) FILTER (fast_ice_status = 'Partial') AS partial, min(area_km2) AS min_area, max(area_km2) AS max_area, round(median(area_km2), 6) AS median_area,
  round(avg(area_km2), 6) AS mean_area, round(COUNT(*) FILTER (area_km2 < 1) * 100e0 / COUNT(*), 6) AS pct_under_1 FROM v_bergs""")
def target_stats(spark, sf):
    s = ingest.target_stats(view(spark, sf, "v_bergs"))
    return s.withColumns({k: F.round(k, 6) for k in ("median_area", "mean_area", "pct_under_1")})


@register("track_summary", """SELECT track_id, COUNT(*) AS n, arg_min(lon, (ts, seq)) AS first_lon, arg_max(lon, (ts, seq)) AS last_lon, min(ts) AS start_ts, max(ts) AS end_ts,
  arg_max(sensor, (ts, seq)) AS last_sensor, round(max(lat), 4) AS max_lat, round(min(lat), 4) AS min_lat, max(lat) > -60 AS open_ocean FROM v_track_points GROUP BY 1""")
def track_summary(spark, sf):
    t = ingest.track_summary(view(spark, sf, "v_track_points"))
    return t.select("track_id", "n", F.col("first.lon").alias("first_lon"), F.col("last.lon").alias("last_lon"), F.col("first.ts").alias("start_ts"),
                    F.col("last.ts").alias("end_ts"), F.col("last.sensor").alias("last_sensor"), "max_lat", "min_lat", "open_ocean")


@register("drift_stats", """SELECT COUNT(*) AS observations, COUNT(DISTINCT track_id) AS tracks, min(ts) AS earliest, max(ts) AS latest, min(lat) AS min_lat, max(lat) AS max_lat,
  min(lon) AS min_lon, max(lon) AS max_lon, COUNT(*) FILTER (lat > -60) AS north_60, COUNT(*) FILTER (lat > -55) AS north_55, COUNT(*) FILTER (lat > -50) AS north_50,
  COUNT(DISTINCT CASE WHEN lat > -60 THEN track_id END) AS tracks_north_60, COUNT(DISTINCT CASE WHEN lat > -55 THEN track_id END) AS tracks_north_55 FROM v_track_points""")
def drift_stats(spark, sf):
    return ingest.drift_stats(view(spark, sf, "v_track_points"))


@register("slim_tracks", "SELECT track_id AS id, COUNT(*) AS points, max(lat) > -60 AS open_ocean FROM v_track_points GROUP BY 1")
def slim_tracks(spark, sf):
    return ingest.track_summary(view(spark, sf, "v_track_points")).select(F.col("track_id").alias("id"), F.col("n").alias("points"), "open_ocean")


@register("hemisphere_filter", "SELECT port_id, lat + 60 AS lat FROM v_ports WHERE lat + 60 <= 0")
def hemisphere_filter(spark, sf):
    return ingest.southern(view(spark, sf, "v_ports").select("port_id", (F.col("lat") + 60).alias("lat")))


_LAYERS = "(SELECT 'PORT' AS kind, port_id AS id, lon, lat FROM v_ports UNION ALL SELECT source, berg_id, lon, lat FROM v_bergs)"


def layers(spark, sf):
    p, b = view(spark, sf, "v_ports"), view(spark, sf, "v_bergs")
    return p.select(F.lit("PORT").alias("kind"), F.col("port_id").alias("id"), "lon", "lat").unionByName(
        b.select(F.col("source").alias("kind"), F.col("berg_id").alias("id"), "lon", "lat"))


@register("layer_filter", f"SELECT 'MOVING' AS mode, * FROM {_LAYERS} WHERE kind IN ('DRIFTING', 'TRACKED') UNION ALL SELECT 'FIXED', * FROM {_LAYERS} WHERE kind = 'GROUNDED'"
          f" UNION ALL SELECT 'PORTS', * FROM {_LAYERS} WHERE kind = 'PORT'")
def layer_filter(spark, sf):
    x = layers(spark, sf)
    modes = F.array(*[F.when(classify.in_layer("kind", m), m) for m in ("MOVING", "FIXED", "PORTS")])
    return x.select(F.explode(F.array_compact(modes)).alias("mode"), "*")


_SECTOR = """CASE WHEN w < -150 THEN 'Ross Sea / New Zealand Sector' WHEN w < -70 THEN 'Pacific Southern Ocean' WHEN w < -50 THEN 'Drake Passage / Antarctic Peninsula'
  WHEN w < -20 THEN 'Weddell Sea Sector' WHEN w < 20 THEN 'Atlantic Southern Ocean' WHEN w < 115 THEN 'Indian Ocean Sector' WHEN w < 150 THEN 'Australian Sector'
  ELSE 'Ross Sea / New Zealand Sector' END"""


@register("port_labels", f"""SELECT port_id, {_SECTOR} AS sector, CASE WHEN lat <= -60 THEN 'POLAR' WHEN lat <= -50 THEN 'SUB_ANTARCTIC' ELSE 'OPEN_OCEAN' END AS zone,
  CASE WHEN harbor_type LIKE '%River%' THEN CASE WHEN channel_depth IS NOT NULL OR harbor_size = 'Large' THEN 12e0 ELSE 5e0 END
   WHEN harbor_type LIKE '%Ria%' THEN 4e0 WHEN harbor_type LIKE '%Coastal%' THEN 2.5e0 ELSE 1.5e0 END AS tolerance_km,
  lon BETWEEN -180 AND 180 AND lat BETWEEN -60 AND 90 AS in_band FROM (SELECT *, fmod(lon * 2 + 540, 360) - 180 AS w FROM v_ports)""")
def port_labels(spark, sf):
    return view(spark, sf, "v_ports").select(
        "port_id", classify.ocean_sector(F.col("lon") * 2).alias("sector"), classify.latitude_zone("lat").alias("zone"),
        classify.dock_tolerance_km("harbor_type", "harbor_size", "channel_depth").alias("tolerance_km"),
        F.col("lat").between(-60.0, 90.0).alias("in_band"))


@register("risk_tier", """SELECT event_id, CASE WHEN value < 5 THEN 'CRITICAL' WHEN value < 15 THEN 'HIGH' WHEN value < 30 THEN 'MODERATE' WHEN value < 50 THEN 'LOW' END AS tier FROM events""")
def risk_tier(spark, sf):
    return table(spark, sf, "events").select("event_id", classify.risk_tier("value").alias("tier"))


@register("decimate", "SELECT track_id, seq, lon, lat FROM (SELECT *, COUNT(*) OVER (PARTITION BY track_id) AS n FROM v_track_points) WHERE (seq - 1) % greatest(1, CAST(floor(n / 20e0) AS BIGINT)) = 0")
def decimate(spark, sf):
    from seaway.operators.tracks import decimate as op

    return op(view(spark, sf, "v_track_points"), ["track_id"], "seq", 20).select("track_id", "seq", "lon", "lat")


@register("corridor", "SELECT node_id, lat FROM v_mesh_nodes WHERE lat BETWEEN -60.75 AND -59.25")
def corridor(spark, sf):
    from seaway.operators.tracks import corridor as op

    return op(view(spark, sf, "v_mesh_nodes"), -60.0, 0.75).select("node_id", "lat")


@register("open_ocean", "SELECT track_id, max(lat) > -60 AS open_ocean FROM v_track_points GROUP BY 1")
def open_ocean(spark, sf):
    return ingest.track_summary(view(spark, sf, "v_track_points")).select("track_id", "open_ocean")


@register("valid_coord", "SELECT event_id, coalesce(value - 60 BETWEEN -90 AND 90 AND value * 4 BETWEEN -180 AND 180, false) AS ok FROM events")
def valid_coord(spark, sf):
    from seaway.functions.geo import valid_coord as op

    return table(spark, sf, "events").select("event_id", op(F.col("value") * 4, F.col("value") - 60).alias("ok"))


@register("failure_category", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN 'No feasible water route' ELSE
  CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 'Terminal harbor approach failure' WHEN o_orderpriority LIKE '%LOW%' THEN 'Internal network failure'
  ELSE 'Land/ice validation failure' END END AS category FROM orders""")
def failure_category(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "SUCCESS").when(F.col("o_orderstatus") == "P", "NO_FEASIBLE_ROUTE").otherwise("REJECTED_LAND_INTERSECTION")
    reason = (F.when(F.col("o_orderpriority").contains("HIGH"), "Terminal harbor approach segment crosses land")
              .when(F.col("o_orderpriority").contains("LOW"), "Internal routing network edge failure").otherwise("Line segment crosses land"))
    return o.select("o_orderkey", classify.failure_category(status, reason).alias("category"))


@register("layer_status", """SELECT berg_id, CASE WHEN abs(b.lat - p.lat) > 0.05 OR abs(b.lon - p.lon) > 0.05 THEN 'Drifting' ELSE 'Grounded/Stationary' END AS status
  FROM v_bergs b JOIN v_bergs_prev p USING (berg_id)""")
def layer_status(spark, sf):
    b = view(spark, sf, "v_bergs")
    p = view(spark, sf, "v_bergs_prev").select("berg_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    return b.join(p, "berg_id").select("berg_id", classify.layer_status(F.col("lat") - F.col("plat"), F.col("lon") - F.col("plon")).alias("status"))
