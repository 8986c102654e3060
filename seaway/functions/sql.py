"""Geometry as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

R = "6371008.8D"

FUNCTIONS = {
    "haversine_km": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        f"2D * {R} / 1000D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2D), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2D), 2))))"),
    "bearing_deg": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) "
        "- sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360D, 360D)"),
}

_DOT = "(cos(radians({1})) * cos(radians({3})) * cos(radians({0} - {2})) + sin(radians({1})) * sin(radians({3})))".format


def register(spark: SparkSession) -> list[str]:
    """Create ``haversine_km``, ``bearing_deg`` and ``point_segment_m`` as temporary SQL functions."""
    for name, (args, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    pa, pb, ab = _DOT("plon", "plat", "alon", "alat"), _DOT("plon", "plat", "blon", "blat"), _DOT("alon", "alat", "blon", "blat")
    # signed distance from the circle through a and b, by the bearing difference at a
    off = ("asin(sin(haversine_km(alon, alat, plon, plat) * 1000D / " + R + ") * sin(radians(bearing_deg(alon, alat, plon, plat) - bearing_deg(alon, alat, blon, blat))))")
    ends = "least(haversine_km(plon, plat, alon, alat), haversine_km(plon, plat, blon, blat)) * 1000D"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION point_segment_m(plon DOUBLE, plat DOUBLE, alon DOUBLE, alat DOUBLE, blon DOUBLE, blat DOUBLE) RETURNS DOUBLE RETURN "
        f"CASE WHEN haversine_km(alon, alat, blon, blat) < 1e-6 THEN haversine_km(plon, plat, alon, alat) * 1000D "
        f"WHEN {pb} - {pa} * {ab} >= 0D AND {pa} - {pb} * {ab} >= 0D THEN abs({off}) * {R} ELSE {ends} END")
    return [*FUNCTIONS, "point_segment_m"]
