"""Writers and lineage documents. All outputs are directories of part files written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Records as JSON lines or parquet; ``partition_by`` lays out data set and version folders."""
    w = df.write.mode("errorifexists").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def features(df: DataFrame, props: Sequence[str], geometry: Column) -> DataFrame:
    """One GeoJSON Feature text per row; ``geometry`` is a struct(type, coordinates)."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(f, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, props: Sequence[str], geometry: Column) -> None:
    """Newline-delimited features."""
    features(df, props, geometry).write.mode("errorifexists").text(path)


def line_geometry(coords) -> Column:
    """LineString of an array of (lon, lat) structs."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(coords, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def polygon_geometry(ring) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))


def track_coords(points: DataFrame, keys: Sequence[str] = ("track_id",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Coordinates of each track as one array, the shape of the document output. A row holds a whole track, so
    this is for output of ordinary tracks; all other operators keep points in rows."""
    row = F.struct(*order, "lon", "lat")
    x = points.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_p"))
    return x.select(*keys, F.transform("_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


def flat_text(df: DataFrame) -> DataFrame:
    """Arrays and structs as text so that the table fits into CSV."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        cols.append(F.to_json(f.name).alias(f.name) if kind in ("struct", "map") or (kind == "array" and f.dataType.elementType.typeName() == "struct")
                    else F.concat(F.lit("["), F.array_join(F.col(f.name).cast("array<string>"), ", "), F.lit("]")).alias(f.name) if kind == "array" else F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    flat_text(df).write.mode("errorifexists").option("header", True).csv(path)


def passage_plan(waypoints: DataFrame, keys: Sequence[str] = ("route_id",), ends: DataFrame | None = None, generated: Column | None = None) -> DataFrame:
    """Text lines ``(key, line_no, line)`` of the passage plan of each route: comments, header, one line per waypoint.

    ``ends`` has a row per route with its keys, ``departure``, ``departure_id``, ``destination`` and ``destination_id``; what is
    null or has no row is N/A. ``generated`` is the time of the export, now if none is given, and written in UTC.
    Lines stay rows; a writer sorts by (key, line_no). Line numbers come from the waypoint index, so no route is collected.
    """
    line = F.format_string("%s,%.5f,%.5f,%.1f,%.1f,%.1f,%s,%.1f,%s", "name", "lat", "lon", "bearing", "leg_nm", "turn", "side", "cum_nm", "zone")
    body = waypoints.select(*keys, (F.col("wp_index") + 6).alias("line_no"), line.alias("line"))
    total = waypoints.groupBy(*keys).agg(F.max("cum_nm").alias("nm"), F.max("cum_km").alias("km"))
    names = ("departure", "departure_id", "destination", "destination_id")
    if ends is not None:
        total = total.join(ends.groupBy(*keys).agg(F.min(F.struct(*names)).alias("e")).select(*keys, "e.*"), list(keys), "left")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if ends is not None else F.lit("N/A")
    end = lambda title, c: F.concat(F.lit(f"# {title}: "), known(c), F.lit(" (WPI "), known(c + "_id"), F.lit(")"))
    dist = F.format_string("# Total Distance: %d NM (%d km)", F.floor(F.col("nm") + 0.5), F.floor(F.col("km") + 0.5))
    when = F.to_utc_timestamp(F.current_timestamp() if generated is None else generated, F.current_timezone())
    heads = [F.lit("# ECDIS PASSAGE PLAN VOYAGE EXPORT"), end("Departure", "departure"), end("Destination", "destination"), dist,
             F.concat(F.lit("# Generated: "), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
             F.lit("WP_NAME,LATITUDE,LONGITUDE,TRUE_BEARING_DEG,LEG_DIST_NM,TURN_DEG,TURN_DIR,CUMUL_DIST_NM,ZONE")]
    head = total.select(*keys, F.posexplode(F.array(*heads)).alias("i", "line")).select(*keys, (F.col("i") + 1).cast("bigint").alias("line_no"), "line")
    return head.unionByName(body)


def plan_texts(lines: DataFrame, keys: Sequence[str] = ("route_id",)) -> DataFrame:
    """(key, ``plan_text``): the lines of each passage plan as one text, in line order with line ends between them.

    A row holds one whole plan, as the export does; null lines are left out.
    """
    x = lines.filter("line is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return x.select(*keys, F.array_join(F.transform("_l", lambda p: p["line"]), "\n").alias("plan_text"))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every source file, hashed on the executors one file per row."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", "length", F.sha2("content", 256).alias("sha256"))


def lineage(n_in: DataFrame, n_ok: DataFrame, n_bad: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: counts in, accepted, rejected, and the source files."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    x = count(n_in, "raw_record_count").join(count(n_ok, "processed_record_count")).join(count(n_bad, "rejected_record_count"))
    if files is not None:
        x = x.join(files.agg(F.sum("length").alias("file_size_bytes"), F.sort_array(F.collect_list(F.struct("path", "length", "sha256"))).alias("files")))
    return x
