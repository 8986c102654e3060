"""Row checks, outlines and statistics of the data set builds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaway.functions.clean import first_reason
from seaway.operators.ordered import ends, over_blocks
from seaway.operators.ranks import percentiles


def split_valid(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the first failing rule in ``reason``."""
    tagged = df.withColumn("reason", first_reason(rules))
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def ingest_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    bad = first_reason(rules).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("raw"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("rejected"))


def reject_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.groupBy(F.coalesce(first_reason(rules), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def last_row_wins(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row per trimmed key, the latest in file order; blank keys are dropped. Partial aggregation, no window."""
    row = F.struct(*df.columns)
    picked = df.withColumn("_k", F.trim(key)).filter("_k != ''").groupBy("_k").agg(F.max_by(row, order).alias("r"))
    return picked.select("_k", "r.*").withColumnRenamed("_k", "id")


def largest_part(vertices: DataFrame) -> DataFrame:
    """Per geometry the part with the largest planar area.

    ``vertices(geom_id, part_no, idx, lon, lat)`` holds closed outlines. Parts under three vertices are
    dropped; coordinates come back at five decimals.
    """
    keys = ["geom_id", "part_no"]

    def cross(x, w):
        return x.withColumn("_c", F.col("lon") * F.lead("lat").over(w) - F.lead("lon").over(w) * F.col("lat"))

    area = (over_blocks(vertices, keys, "idx", cross, back=0).groupBy(*keys)
            .agg((F.abs(F.sum("_c")) / 2.0).alias("area"), F.count(F.lit(1)).alias("n")).filter("n >= 3"))
    best = area.groupBy("geom_id").agg(F.max_by(F.struct("part_no", "area"), F.struct("area", -F.col("part_no"))).alias("b"))
    best = best.select("geom_id", F.col("b.part_no").alias("part_no"), F.col("b.area").alias("area"))
    return vertices.join(best, keys).select(
        *keys, "idx", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "area")


def normalise_ring(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Round to four decimals, close open rings, drop rings under three points.

    ``points(ring_id, idx, lon, lat)``; returns the points and one box row per ring.
    """
    p = points.select("ring_id", "idx", (F.floor(F.col("lon") * 1e4 + 0.5) / 1e4).alias("lon"),
                      (F.floor(F.col("lat") * 1e4 + 0.5) / 1e4).alias("lat"))
    e = ends(p, ["ring_id"], "idx", ["idx", "lon", "lat"]).filter("n >= 3")
    closing = e.filter("first.lon != last.lon or first.lat != last.lat").select(
        "ring_id", (F.col("last.idx") + 1).alias("idx"), F.col("first.lon").alias("lon"), F.col("first.lat").alias("lat"))
    box = p.groupBy("ring_id").agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"),
        F.max("lat").alias("max_lat"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("n")
    return p.join(e.select("ring_id"), "ring_id", "left_semi").unionByName(closing), box


def target_stats(df: DataFrame) -> DataFrame:
    """Counts per fast-ice class and area statistics; the median is the exact interpolated one, found by ranges."""
    (median,) = percentiles(df, "area_km2", [0.5])
    st = F.col("fast_ice_status")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(st == "Outside").alias("outside"), F.count_if(st == "Inside").alias("inside"),
        F.count_if(st == "Partial").alias("partial"), F.min("area_km2").alias("min_area"), F.max("area_km2").alias("max_area"),
        F.lit(median).cast("double").alias("median_area"), F.avg("area_km2").alias("mean_area"),
        (F.count_if(F.col("area_km2") < 1.0) / F.count(F.lit(1)) * 100.0).alias("pct_under_1"))


def track_summary(points: DataFrame) -> DataFrame:
    """One row per track. ``points(track_id, seq, ts, lon, lat, sensor)``; order is (ts, seq)."""
    pos = F.struct("lat", "lon", "sensor", "ts")
    order = F.struct("ts", "seq")
    return points.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(pos, order).alias("first"), F.max_by(pos, order).alias("last"),
        F.round(F.max("lat"), 4).alias("max_lat"), F.round(F.min("lat"), 4).alias("min_lat"),
        (F.max("lat") > -60.0).alias("open_ocean"))


def drift_stats(points: DataFrame) -> DataFrame:
    """Totals over all fixes, from one pass per track and one over the track rows (no global distinct)."""
    per = points.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.count_if(F.col("lat") > -60.0).alias("n60"),
        F.count_if(F.col("lat") > -55.0).alias("n55"), F.count_if(F.col("lat") > -50.0).alias("n50"))
    return per.agg(
        F.sum("n").alias("observations"), F.count(F.lit(1)).alias("tracks"), F.min("t0").alias("earliest"), F.max("t1").alias("latest"),
        F.min("y0").alias("min_lat"), F.max("y1").alias("max_lat"), F.min("x0").alias("min_lon"), F.max("x1").alias("max_lon"),
        F.sum("n60").alias("north_60"), F.sum("n55").alias("north_55"), F.sum("n50").alias("north_50"),
        F.count_if(F.col("y1") > -60.0).alias("tracks_north_60"), F.count_if(F.col("y1") > -55.0).alias("tracks_north_55"))


def southern(rows: DataFrame, limit: float = 0.0, lat: str = "lat") -> DataFrame:
    """Rows at or south of a latitude; rows without one are left out."""
    return rows.filter(F.col(lat) <= limit)
