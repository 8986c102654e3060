"""Readers for the input formats. Rows keep their file and position where an order is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seaway.functions import clean
from seaway.functions.geo import valid_coord
from seaway.session import cut

# fixed values: input header -> output column of the port table
PORT_COLUMNS = {
    "World Port Index Number": "wpiNumber", "Main Port Name": "portName", "Alternate Port Name": "alternatePortName",
    "UN/LOCODE": "unLocode", "Country Code": "countryCode", "Region Name": "regionName",
    "World Water Body": "worldWaterBody", "IHO S-130 Sea Area": "ihoSeaArea", "Latitude": "latitude",
    "Longitude": "longitude", "Harbor Size": "harborSize", "Harbor Type": "harborType", "Harbor Use": "harborUse",
    "Shelter Afforded": "shelter", "Entrance Restriction - Ice": "iceRestriction",
    "Entrance Restriction - Heavy Swell": "swellRestriction", "Facilities - Anchorage": "anchorage",
    "Facilities - Ice Mooring": "iceMooring", "Services - Ice Breaking": "iceBreaking",
    "Maximum Vessel Length (m)": "maxVesselLength", "Maximum Vessel Beam (m)": "maxVesselBeam",
    "Maximum Vessel Draft (m)": "maxVesselDraft", "Channel Depth (m)": "channelDepth",
    "Anchorage Depth (m)": "anchorageDepth", "Cargo Pier Depth (m)": "cargoPierDepth",
    "Sailing Direction or Publication": "sailingDirection", "Publication Link": "publicationLink",
}
_NUMERIC = ("maxVesselLength", "maxVesselBeam", "maxVesselDraft")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered text columns; a byte-order mark in front of the first header is removed."""
    df = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿").strip('"'))


def _file_order():
    """Position of a row: file, then split offset, then order inside the split."""
    return F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_ports_raw(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return df.select(*[F.col(f"`{src}`").alias(out) for src, out in PORT_COLUMNS.items()])


def clean_ports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed ports and rejected rows with reasons."""
    from seaway.operators.ingest import split_valid

    ok, bad = split_valid(raw, clean.port_rules("wpiNumber", "portName", "latitude", "longitude"))
    cols = []
    for name in PORT_COLUMNS.values():
        if name == "wpiNumber":
            col = clean.parse_int_via_float(name)
        elif name == "portName":
            col = F.trim(name)
        elif name in ("latitude", "longitude"):
            col = F.round(clean.to_double(name), 5)
        elif name in _NUMERIC:
            col = clean.clean_num_zero_null(name)
        else:
            col = clean.clean_str(name)
        cols.append(col.alias(name))
    return ok.select(*cols), bad


def read_ports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return clean_ports(read_ports_raw(spark, path))


def read_iceberg_snapshot(spark: SparkSession, path: str, key: str = "Iceberg") -> DataFrame:
    """Snapshot keyed by trimmed id, last row of the file wins, blank ids skipped."""
    from seaway.operators.ingest import last_row_wins

    df = _csv(spark, path)
    df = df.select("*", _file_order().alias("_pos"))
    df = df.withColumnsRenamed({c: c.replace(".", "_") for c in df.columns})
    return last_row_wins(df, F.col(key), F.col("_pos")).drop("_pos", key)


def _track_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of per-track files with the file's id and the header fields of the file, header line removed.

    The header is the first non-blank line of a file: one small row per file, joined back on the id.
    """
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", "")
    raw = spark.read.text(path).select(
        F.upper(name).alias("track_id"), F.trim("value").alias("line"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("pos"))
    raw = cut(raw.filter("line != ''"))  # positions are numbered in one scan that both sides below read
    head = raw.groupBy("track_id").agg(F.min_by("line", "pos").alias("header"), F.min("pos").alias("hpos"))
    return raw.join(head, "track_id").filter("pos != hpos").select(
        "track_id", "pos", F.transform(F.split("line", ","), lambda v: F.trim(v)).alias("parts"), F.split("header", ",").alias("header"))


def read_drift_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fixes of per-track CSV files whose headers differ, and rejected lines.

    Lines with another column count than the header, or without a usable fix, are rejected.
    """
    x = _track_lines(spark, path).withColumn("header", F.transform("header", lambda v: F.lower(v)))
    same = F.size("parts") == F.size("header")
    x = x.withColumn("row", F.when(same, F.map_from_arrays("header", "parts")))
    fix = lambda n: (clean.to_double(F.col("row").getItem(f"{n}_1")), clean.to_double(F.col("row").getItem(f"{n}_2")))
    x = x.withColumn("fix", F.when(same, clean.pick_sensor(fix)))
    ok = x.filter("fix is not null").select(
        "track_id", "pos", clean.parse_yyyyddd(F.coalesce(F.col("row").getItem("date"), F.lit("")), strict=False).alias("date"),
        F.round("fix.lat", 4).alias("lat"), F.round("fix.lon", 4).alias("lon"), F.col("fix.sensor").alias("sensor"),
        clean.size_or_null(F.col("row").getItem("size_1")).alias("length_nm"), clean.size_or_null(F.col("row").getItem("size_2")).alias("width_nm"))
    bad = x.filter("fix is null").select("track_id", "pos", F.array_join("parts", ",").alias("line"),
                                         F.when(same, "no usable fix").otherwise("column count").alias("reason"))
    return ok, bad


def read_fixes_positional(spark: SparkSession, path: str) -> DataFrame:
    """Fixes with latitude and longitude in the first two columns and a date column found by name or by value."""
    x = _track_lines(spark, path)
    named = F.array_position(F.transform("header", lambda h: F.lower(h).contains("date")), True)
    firsts = x.groupBy("track_id").agg(F.min_by("parts", "pos").alias("first"))
    valued = F.array_position(F.transform("first", lambda v: v.rlike("^[0-9]{7}$")), True)
    x = x.join(firsts, "track_id").withColumn("_d", F.when(named > 0, named).otherwise(valued)).filter("_d > 0 and size(parts) >= _d and size(parts) >= 2")
    lat, lon = clean.to_double(F.get("parts", F.lit(0))), clean.to_double(F.get("parts", F.lit(1)))
    x = x.select("track_id", "pos", clean.parse_yyyyddd(F.get("parts", (F.col("_d") - 1).cast("int"))).alias("date"), lat.alias("lat"), lon.alias("lon"))
    return x.filter("date is not null and lat between -90 and 0 and lon between -180 and 180 and (lat != 0 or lon != 0)")


_RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
_FEATURE = T.StructType([
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    T.StructField("properties", T.StringType())])


def rings_from_features(features: DataFrame) -> DataFrame:
    """Ring points ``(ring_id, idx, lon, lat)`` of Polygon and MultiPolygon rows ``(fid, type, coordinates)``."""
    one = F.array(F.from_json("coordinates", _RINGS))
    polys = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", T.ArrayType(_RINGS)))
    x = features.select("fid", F.posexplode(polys).alias("poly_no", "poly")).select("fid", "poly_no", F.posexplode("poly").alias("ring_no", "ring"))
    x = x.select(F.struct("fid", "poly_no", "ring_no").alias("ring_id"), F.posexplode("ring").alias("idx", "pt"))
    return x.select("ring_id", F.col("idx").cast("bigint").alias("idx"), F.get("pt", F.lit(0)).alias("lon"), F.get("pt", F.lit(1)).alias("lat"))


def read_polygons(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rings of a GeoJSON source: one feature per line, or one collection per file with ``multiline``.

    A single collection file is one JSON document and is parsed by one task; large sources should be
    newline-delimited features.
    """
    if multiline:
        f = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])).option("multiLine", True).json(path)
        f = f.select(F.explode("features").alias("f")).select("f.*")
    else:
        f = spark.read.schema(_FEATURE).json(path)
    f = f.filter("geometry is not null").select(F.monotonically_increasing_id().alias("fid"), "geometry.type", "geometry.coordinates")
    return rings_from_features(cut(f))  # numbered once, so that every later use sees the same ids


def ring_edges(points: DataFrame) -> DataFrame:
    """Closed ring points ``(ring_id, idx, lon, lat)`` as edges."""
    a = points.select("ring_id", F.col("idx").alias("edge_idx"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    b = points.select("ring_id", (F.col("idx") - 1).alias("edge_idx"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return a.join(b, ["ring_id", "edge_idx"])


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Ring points of rows ``{"bbox": [...], "ring": [[lon, lat], ...]}``."""
    sch = T.StructType([T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("ring", T.ArrayType(T.ArrayType(T.DoubleType())))])
    r = spark.read.schema(sch).json(path).select(F.monotonically_increasing_id().alias("ring_id"), "ring")
    r = cut(r).select("ring_id", F.posexplode("ring").alias("idx", "pt"))
    return r.select("ring_id", F.col("idx").cast("bigint").alias("idx"), F.get("pt", F.lit(0)).alias("lon"), F.get("pt", F.lit(1)).alias("lat"))


_GATEWAY = T.StructType([
    T.StructField("gatewayId", T.StringType()), T.StructField("polarNodeId", T.LongType()), T.StructField("polarCoords", T.ArrayType(T.DoubleType())),
    T.StructField("globalCoords", T.ArrayType(T.DoubleType())), T.StructField("transitionDistanceKm", T.DoubleType()), T.StructField("landClearanceKm", T.DoubleType()),
    T.StructField("polarDegree", T.LongType()), T.StructField("sector", T.StringType()), T.StructField("rankingScore", T.DoubleType())])


def read_gateways(spark: SparkSession, path: str) -> DataFrame:
    """Gateways of ``{"validatedGateways": [...]}`` documents."""
    sch = T.StructType([T.StructField("validatedGateways", T.ArrayType(_GATEWAY))])
    x = spark.read.schema(sch).option("multiLine", True).json(path).select(F.inline("validatedGateways"))
    at = lambda c, i: F.get(c, F.lit(i))
    return x.select(F.col("gatewayId").alias("gateway_id"), F.col("polarNodeId").alias("node_id"), at("polarCoords", 0).alias("polar_lon"), at("polarCoords", 1).alias("polar_lat"),
                    at("globalCoords", 0).alias("global_lon"), at("globalCoords", 1).alias("global_lat"), F.col("transitionDistanceKm").alias("gap_km"),
                    F.col("landClearanceKm").alias("clearance_km"), F.col("polarDegree").alias("degree"), "sector", F.col("rankingScore").alias("score"))


def read_graph_indexed(df: DataFrame) -> DataFrame:
    """Edges ``[u, v, km]`` in both directions."""
    from seaway.operators.graph import mirrored

    return mirrored(df)


def flatten_line_geometry(df: DataFrame) -> DataFrame:
    """Points ``(geom_id, seq, lon, lat)`` of LineString and MultiLineString rows ``(geom_id, type, coordinates)``.

    A geometry with any bad coordinate, an unexplained gap between parts, or under two points gives no rows.
    Parts join over at most 2 planar degrees or at the antimeridian; a repeated seam point is dropped.
    """
    line = T.ArrayType(T.ArrayType(T.DoubleType()))
    parts = F.when(F.col("type") == "LineString", F.array(F.from_json("coordinates", line))).when(
        F.col("type") == "MultiLineString", F.from_json("coordinates", T.ArrayType(line)))
    g = df.select("geom_id", parts.alias("parts")).filter("parts is not null and size(parts) > 0")
    p = g.select("geom_id", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "pts"))
    good = (F.coalesce(F.size("pts"), F.lit(0)) >= 1) & F.forall(
        "pts", lambda c: (F.size(c) >= 2) & valid_coord(F.get(c, F.lit(0)), F.get(c, F.lit(1))))
    ends_of = p.select("geom_id", "part", F.coalesce(good, F.lit(False)).alias("good"), F.get("pts", F.lit(0)).alias("a"),
                       F.get("pts", F.size("pts") - 1).alias("b"), F.size("pts").cast("bigint").alias("n"))
    prev = ends_of.select("geom_id", (F.col("part") + 1).alias("part"), F.col("b").alias("pb"))
    x, y = (lambda c: F.get(c, F.lit(0))), (lambda c: F.get(c, F.lit(1)))
    j = ends_of.join(prev, ["geom_id", "part"], "left")
    dx, dy = x("a") - x("pb"), y("a") - y("pb")
    seam = (F.abs(F.abs(x("pb")) - 180.0) <= 0.5) & (F.abs(F.abs(x("a")) - 180.0) <= 0.5) & (F.abs(dy) <= 5.0)
    j = j.withColumns({
        "joined": (F.col("part") == 0) | F.coalesce(seam | (F.sqrt(dx * dx + dy * dy) <= 2.0), F.lit(False)),
        "skip": F.when(F.coalesce((F.abs(dx) < 1e-6) & (F.abs(dy) < 1e-6), F.lit(False)), 1).otherwise(0).cast("bigint")})
    keep = j.groupBy("geom_id").agg(F.bool_and(F.col("good") & F.col("joined")).alias("ok"), F.sum(F.col("n") - F.col("skip")).alias("total"))
    keep = keep.filter("ok and total >= 2").select("geom_id")
    from seaway.operators.ordered import _prior_total

    off = _prior_total(j.withColumn("_n", F.col("n") - F.col("skip")).select("geom_id", "part", "_n"), ["geom_id"], "part", "_n", "_off")
    pts = p.join(keep, "geom_id", "left_semi").select("geom_id", "part", F.posexplode("pts").alias("i", "pt"))
    pts = pts.join(j.select("geom_id", "part", "skip"), ["geom_id", "part"]).join(off, ["geom_id", "part"]).filter("i >= skip")
    return pts.select("geom_id", (F.coalesce("_off", F.lit(0)) + F.col("i") - F.col("skip") + 1).cast("bigint").alias("seq"),
                      F.get("pt", F.lit(0)).alias("lon"), F.get("pt", F.lit(1)).alias("lat"))


def network_vertices(points: DataFrame, digits: int = 5) -> DataFrame:
    """Distinct vertices by rounded coordinates, the first in ``ord`` kept."""
    key = [F.round("lon", digits).alias("kx"), F.round("lat", digits).alias("ky")]
    v = points.groupBy(*key).agg(F.min_by(F.struct("ord", "lon", "lat"), "ord").alias("v"))
    return v.select("kx", "ky", "v.*")
