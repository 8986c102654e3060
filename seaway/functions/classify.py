"""Class labels and business rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seaway.functions.geo import c, wrap_lon

# fixed values: longitude sectors as (from, to, name), half open
SECTORS = [
    (-180.0, -150.0, "Ross Sea / New Zealand Sector"),
    (-150.0, -70.0, "Pacific Southern Ocean"),
    (-70.0, -50.0, "Drake Passage / Antarctic Peninsula"),
    (-50.0, -20.0, "Weddell Sea Sector"),
    (-20.0, 20.0, "Atlantic Southern Ocean"),
    (20.0, 115.0, "Indian Ocean Sector"),
    (115.0, 150.0, "Australian Sector"),
    (150.0, 180.0, "Ross Sea / New Zealand Sector"),
]
SECTOR_NAMES = sorted({name for _, _, name in SECTORS})


def ocean_sector(lon) -> Column:
    w = wrap_lon(lon)
    out = F.when(F.lit(False), F.lit(""))
    for lo, hi, name in SECTORS:
        out = out.when((w >= lo) & (w < hi), name)
    return out.otherwise("Unknown")


def latitude_zone(lat) -> Column:
    return F.when(c(lat) <= -60.0, "POLAR").when(c(lat) <= -50.0, "SUB_ANTARCTIC").otherwise("OPEN_OCEAN")


# fixed values: cruising speed in knots per zone
ZONE_KNOTS = {"OPEN_OCEAN": 15.0, "SUB_ANTARCTIC": 12.0, "POLAR": 8.5}


def zone_knots(zone) -> Column:
    return (F.when(c(zone) == "POLAR", ZONE_KNOTS["POLAR"]).when(c(zone) == "SUB_ANTARCTIC", ZONE_KNOTS["SUB_ANTARCTIC"])
            .otherwise(ZONE_KNOTS["OPEN_OCEAN"]))


def risk_tier(km) -> Column:
    """Documented distance bands; null beyond 50 km."""
    d = c(km)
    return F.when(d < 5.0, "CRITICAL").when(d < 15.0, "HIGH").when(d < 30.0, "MODERATE").when(d < 50.0, "LOW")


def dock_tolerance_km(harbor_type, harbor_size, channel_depth) -> Column:
    t = F.lower(F.coalesce(c(harbor_type), F.lit("")))

    def has(*words):
        out = F.lit(False)
        for w in words:
            out = out | t.contains(w)
        return out

    deep = (F.coalesce(c(channel_depth), F.lit("")) != "") | (F.coalesce(c(harbor_size), F.lit("")) == "Large")
    return (F.when(has("river", "canal"), F.when(deep, 12.0).otherwise(5.0))
            .when(has("ria", "sound", "fjord"), 4.0)
            .when(has("natural", "coastal", "breakwater", "tide"), 2.5).otherwise(1.5))


# fixed values: ports known to lie in closed inland waters, and the box of those waters
ISOLATED_PORT_IDS = (14190, 14175, 14250)
ISOLATED_BOX = (-76.0, -56.0, -71.0, -41.0)


def isolated_port(port_id, lon, lat) -> Column:
    x0, y0, x1, y1 = ISOLATED_BOX
    return c(port_id).isin(*ISOLATED_PORT_IDS) | (c(lon).between(x0, x1) & c(lat).between(y0, y1))


def topology(o_id, o_lon, o_lat, o_primary, d_id, d_lon, d_lat, d_primary, connected) -> Column:
    """Six-way case of a port pair. ``*_primary``: true/false for a snapped end, null without a snap."""
    on, dn = c(o_primary).isNull(), c(d_primary).isNull()
    off = lambda p: ~F.coalesce(c(p), F.lit(True))
    isolated = isolated_port(o_id, o_lon, o_lat) | isolated_port(d_id, d_lon, d_lat) | off(o_primary) | off(d_primary)
    blind = ((c(o_lat) <= -60.0) & on) | ((c(d_lat) <= -60.0) & dn)
    op, dp = c(o_lat) <= -50.0, c(d_lat) <= -50.0
    return (F.when(isolated, 6).when(blind, 1).when(~op & ~dp, 2)
            .when(op & dp & ~on & ~dn, F.when(c(connected), 1).otherwise(5))
            .when(~on & (~dp | dn), 4).when(~dn & (~op | on), 3).otherwise(2))


def failure_category(status, reason) -> Column:
    """Taxonomy of failed routes from their status and reason text."""
    t = F.coalesce(c(reason), F.lit(""))
    s = c(status)
    return (F.when(s == "SUCCESS", F.lit(None).cast("string"))
            .when(s == "ERROR", "Calculation error")
            .when(s == "HYBRID_UNAVAILABLE", "Patagonian isolated fjord")
            .when(s == "NO_FEASIBLE_ROUTE", "No feasible water route")
            .when(t.contains("Terminal harbor approach"), "Terminal harbor approach failure")
            .when(t.contains("network edge failure") | t.contains("network topology failure"), "Internal network failure")
            .otherwise("Land/ice validation failure"))


def layer_status(d_lat, d_lon) -> Column:
    return F.when((F.abs(c(d_lat)) > 0.05) | (F.abs(c(d_lon)) > 0.05), "Drifting").otherwise("Grounded/Stationary")


def physical_class(shift_km, grounded_km, fast_ice) -> Column:
    near = F.coalesce((c(grounded_km) > 0.0) & (c(grounded_km) <= 25.0), F.lit(False))
    return (F.when(c(shift_km) > 5.0, "Drifting (Open Ocean)")
            .when(near, F.concat(F.lit("Grounded (Coastal / Fast-Ice: "), c(fast_ice), F.lit(")")))
            .otherwise("Stationary / Entrapped (Pack Ice)"))


# fixed values: layers shown per mode
LAYER_MODES = {"ALL": ("PORT", "DRIFTING", "TRACKED", "GROUNDED"), "PORTS": ("PORT",),
               "MOVING": ("DRIFTING", "TRACKED"), "FIXED": ("GROUNDED",)}


def in_layer(kind, mode: str) -> Column:
    return c(kind).isin(*LAYER_MODES[mode])
