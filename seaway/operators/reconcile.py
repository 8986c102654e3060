"""Reconciliation of target registries across snapshots and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaway.functions import classify, geo
from seaway.operators import spatial as sp
from seaway.operators.ranks import percentiles

# names of the four sources in a match list
SOURCES = ("BASELINE", "PREVIOUS", "TRACKS", "GROUNDED")


def attach_attributes(polygons: DataFrame, attributes: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """Attribute by id, a default text where it is missing."""
    return polygons.join(attributes.select(key, column), key, "left").withColumn(column, F.coalesce(F.trim(column), F.lit(default)))


def compare_snapshots(base: DataFrame, prev: DataFrame) -> DataFrame:
    """Baseline rows with the previous values, shift in km and area change in percent (0 when absent)."""
    p = prev.select("berg_id", F.col("lon").alias("prev_lon"), F.col("lat").alias("prev_lat"), F.col("area_km2").alias("prev_area"), F.lit(True).alias("in_prev"))
    x = base.join(p, "berg_id", "left")
    shift = F.coalesce(geo.haversine_km("lon", "lat", "prev_lon", "prev_lat"), F.lit(0.0))
    area = F.when(F.col("prev_area") > 0.0, F.abs(F.col("area_km2") - F.col("prev_area")) / F.col("prev_area") * 100.0).otherwise(0.0)
    return x.withColumns({"in_prev": F.coalesce("in_prev", F.lit(False)), "shift_km": shift, "area_pct": area})


def attach_last_fix(base: DataFrame, fixes: DataFrame) -> DataFrame:
    """Last fix of the track with the same id: ``fixes(track_id, seq, ts, lon, lat)``."""
    last = fixes.groupBy(F.col("track_id").alias("berg_id")).agg(F.count(F.lit(1)).alias("fix_count"), F.max_by(F.struct("lon", "lat", "ts"), "seq").alias("last"))
    x = base.join(last, "berg_id", "left")
    return x.withColumn("track_km", geo.haversine_km("lon", "lat", "last.lon", "last.lat"))


def missing_from_baseline(fixes: DataFrame, base: DataFrame, since_year: int = 2024, reasons: DataFrame | None = None) -> DataFrame:
    """Tracks with a last fix since ``since_year`` that the baseline does not hold, with what is on record about them.

    ``reasons(berg_id, why_absent, relevance, disposition, action)`` is the caller's table of known cases; its row with a null
    ``berg_id`` holds for all others. Without the table the four columns are null.
    """
    last = fixes.groupBy(F.col("track_id").alias("berg_id")).agg(F.count(F.lit(1)).alias("fix_count"), F.max_by(F.struct("lon", "lat", "ts"), "seq").alias("last"))
    x = last.filter(F.year("last.ts") >= since_year).join(base.select("berg_id"), "berg_id", "left_anti")
    x = x.select("berg_id", "fix_count", F.col("last.lon").alias("lon"), F.col("last.lat").alias("lat"), F.col("last.ts").alias("last_ts"))
    text = ("why_absent", "relevance", "disposition", "action")
    if reasons is None:
        return x.withColumns({c: F.lit(None).cast("string") for c in text})
    known = reasons.filter("berg_id is not null").select(F.upper(F.col("berg_id").cast("string")).alias("_k"), F.struct(*text).alias("_r"))
    rest = reasons.filter("berg_id is null").select(F.struct(*text).alias("_d")).limit(1)
    x = x.withColumn("_k", F.upper(F.col("berg_id").cast("string"))).join(known, "_k", "left").join(rest, how="left")
    return x.select("berg_id", "fix_count", "lon", "lat", "last_ts", F.coalesce("_r", "_d").alias("_t")).select("*", "_t.*").drop("_t")


def reconcile(base: DataFrame, prev: DataFrame, fixes: DataFrame, grounded: DataFrame, ring: int = 2) -> DataFrame:
    """One wide row per baseline target across all sources.

    ``grounded(tid, tlon, tlat, status)`` are the grounded targets searched in the neighbour cells.
    """
    x = attach_last_fix(compare_snapshots(base, prev), fixes)
    near = sp.knn(base.select(F.col("berg_id").alias("pid"), "lon", "lat"), "pid", grounded.select("tid", "tlon", "tlat"), "tid", 1, [20.0], bins=ring)
    near = near.select(F.col("pid").alias("berg_id"), "tid", F.col("km").alias("grounded_km")).join(grounded.select("tid", "status"), "tid")
    x = x.join(near, "berg_id", "left")
    names = [F.lit(SOURCES[0]), F.when(F.col("in_prev"), SOURCES[1]),
             F.when(F.col("fix_count").isNotNull(), SOURCES[2]), F.when(F.col("grounded_km") <= 30.0, SOURCES[3])]
    x = x.withColumn("sources", F.array_compact(F.array(*names)))
    moved = F.col("shift_km") > 1.0
    return x.withColumns({
        "match_count": F.size("sources").cast("bigint"),
        "identity_status": F.when(F.size("sources") >= 2, "CONFIRMED_MATCH").otherwise("SOURCE_EXCLUSIVE"),
        "physical_class": classify.physical_class("shift_km", "grounded_km", "status"),
        "temporal_status": F.when(moved, "TEMPORAL_POSITION_UPDATE").otherwise("TEMPORAL_STABLE"),
        "decision": F.when(moved, "CONFIRMED CORRECTION").otherwise("NO CHANGE REQUIRED")})


def coordinate_discrepancies(x: DataFrame) -> DataFrame:
    return x.filter("shift_km > 1.0").select("berg_id", "lon", "lat", "prev_lon", "prev_lat", F.round("shift_km", 2).alias("shift_km"))


def size_discrepancies(x: DataFrame, min_pct: float = 0.1) -> DataFrame:
    return x.filter(F.col("area_pct") > min_pct).select("berg_id", "area_km2", "prev_area", F.round("area_pct", 2).alias("area_pct"))


def corrections(x: DataFrame, min_pct: float = 0.1) -> DataFrame:
    """One row per target and corrected attribute with old and new values."""
    val = lambda lon, lat, area: F.struct(lon.alias("lon"), lat.alias("lat"), area.alias("area_km2"))
    no = F.lit(None).cast("double")
    pos = F.when(F.col("shift_km") > 1.0, F.struct(
        F.lit("COORDINATES_AND_OBSERVATION_DATE").alias("attribute"), val(F.col("prev_lon"), F.col("prev_lat"), no).alias("old"),
        val(F.col("lon"), F.col("lat"), no).alias("new"), F.round("shift_km", 2).alias("amount")))
    area = F.when(F.col("area_pct") > min_pct, F.struct(
        F.lit("AREA_AND_DIMENSIONS").alias("attribute"), val(no, no, F.col("prev_area")).alias("old"),
        val(no, no, F.col("area_km2")).alias("new"), F.round("area_pct", 2).alias("amount")))
    return x.select("berg_id", F.explode(F.array_compact(F.array(pos, area))).alias("c")).select("berg_id", "c.*")


def cross_matches(x: DataFrame) -> DataFrame:
    return x.select(
        "berg_id", "sources", "match_count", F.when(F.col("shift_km") > 5.0, "YES (TEMPORAL_DRIFT_EXPLAINED)").otherwise("YES (STABLE)").alias("coordinate_agreement"),
        F.when(F.col("area_pct") < 10.0, "YES").otherwise("CALVING_ADJUSTED").alias("size_agreement"), F.col("fix_count").isNotNull().alias("track_available"),
        F.when(F.col("grounded_km") > 0.0, F.round("grounded_km", 2)).alias("grounded_km"))


def apply_update(base: DataFrame, prev: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New version of the registry and of the outlines, moved by the position change at six decimals.

    Both are returned for writing as a new version; the inputs are never overwritten.
    """
    p = prev.select("berg_id", F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    x = base.join(p, "berg_id", "left").withColumns({
        "d_lon": F.coalesce(F.col("lon") - F.col("_plon"), F.lit(0.0)), "d_lat": F.coalesce(F.col("lat") - F.col("_plat"), F.lit(0.0))}).drop("_plon", "_plat")
    x = x.withColumn("status", classify.layer_status("d_lat", "d_lon"))
    moved = outlines.join(x.select("berg_id", "d_lon", "d_lat"), "berg_id").select(
        "berg_id", "vidx", F.round(F.col("lon") + F.col("d_lon"), 6).alias("lon"), F.round(F.col("lat") + F.col("d_lat"), 6).alias("lat"))
    return x, moved


def translate_ring(ring, d_lon, d_lat):
    """An outline held as an array of structs, moved and rounded to six decimals."""
    return F.transform(ring, lambda p: F.struct(F.round(p["lon"] + d_lon, 6).alias("lon"), F.round(p["lat"] + d_lat, 6).alias("lat")))


def audit_trail(base: DataFrame, prev: DataFrame) -> DataFrame:
    """Previous and updated value per attribute, with the time of the run."""
    p = prev.select("berg_id", *[F.col(c).alias("_" + c) for c in ("lon", "lat", "area_km2")])
    x = base.join(p, "berg_id", "left")
    change = lambda c: F.struct(F.col("_" + c).alias("previous"), F.col(c).alias("updated")).alias(c)
    return x.select("berg_id", F.current_timestamp().alias("run_at"), F.lit("UPDATED_FROM_BASELINE").alias("action"), change("lat"), change("lon"), change("area_km2"))


def source_reports(x: DataFrame, corr: DataFrame) -> DataFrame:
    """Counts per comparison as rows (report, n)."""
    a = x.agg(F.count(F.lit(1)).alias("total_baseline"), F.count_if(F.col("fix_count").isNotNull()).alias("track_matched"),
              F.count_if(F.col("grounded_km") <= 30.0).alias("grounded_matched"), F.count_if(F.col("match_count") >= 2).alias("cross_source_matches"))
    a = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("report"), F.col(c).alias("n")) for c in a.columns])).alias("r")).select("r.*")
    return a.unionByName(corr.agg(F.count(F.lit(1)).alias("n")).select(F.lit("corrections").alias("report"), "n"))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Length change per request between two runs; null unless both have a length."""
    n = new.select("pair_id", F.col("km").alias("new_km"), F.col("status").alias("new_status"))
    x = old.join(n, "pair_id")
    both = (F.col("km") > 0.0) & (F.col("new_km") > 0.0)
    return x.select("pair_id", "status", "new_status", F.when(both, F.col("new_km") - F.col("km")).alias("delta_km"))


def latency_percentiles(runs: DataFrame) -> DataFrame:
    """The middle, 90th and 95th percentile and the maximum, exact; found by ranges, not by one sorted list."""
    named = zip(("p50", "p90", "p95"), percentiles(runs, "ms", [0.5, 0.9, 0.95]), strict=True)
    return runs.agg(*[F.lit(v).cast("double").alias(k) for k, v in named], F.max("ms").alias("max"))
