"""Text cleaning and field parsing as Column expressions. Bad text gives null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seaway.functions.geo import c


def to_double(x) -> Column:
    return F.trim(c(x)).try_cast("double")


def clean_str(x) -> Column:
    """Trimmed text; empty and "unknown" become null."""
    t = F.trim(c(x))
    return F.when((t != "") & (F.lower(t) != "unknown"), t)


def clean_num_zero_null(x) -> Column:
    v = to_double(x)
    return F.when(v != 0.0, v)


def clean_num_default(x, default: float, finite: bool = False) -> Column:
    v = to_double(x)
    if finite:
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return F.coalesce(v, F.lit(float(default)))


def parse_int_via_float(x) -> Column:
    """"123.0" -> 123, truncated toward zero."""
    return to_double(x).try_cast("bigint")


def parse_nm(x) -> Column:
    """Number in front of a nautical-mile mark."""
    return to_double(F.regexp_replace(c(x), "NM|nm", ""))


def size_or_null(x) -> Column:
    return F.when(c(x) != "0", to_double(x))


def parse_yyyyddd(x, strict: bool = True) -> Column:
    """Year and day-of-year to an ISO date; days past the year end roll over.

    ``strict`` gives null for other text, otherwise the text is kept.
    """
    digits = parse_int_via_float(x).cast("string")
    ok = digits.rlike("^[0-9]{7}$")
    year = F.when(ok, F.substring(digits, 1, 4)).cast("int")
    day = F.when(ok, F.substring(digits, 5, 3)).cast("int")
    iso = F.date_format(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1), "yyyy-MM-dd")
    return iso if strict else F.coalesce(iso, c(x).cast("string"))


# sensors in the order they are tried (fixed values)
SENSORS = ("ascat", "qscat", "nscat", "sass", "nic")


def pick_sensor(fix_of, order: Sequence[str] = SENSORS) -> Column:
    """First sensor with a usable fix as struct(lat, lon, sensor); ``fix_of(name)`` gives its lat, lon Columns."""
    picks = []
    for name in order:
        lat, lon = fix_of(name)
        good = (lat != 0.0) & (lon != 0.0) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
        picks.append(F.when(good, F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(name.upper()).alias("sensor"))))
    return F.coalesce(*picks)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds, null when the row is good."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def port_rules(id_raw, name_raw, lat_raw, lon_raw) -> list[tuple[str, Column]]:
    """Reject rules of the port table, in order."""
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    lat, lon = to_double(lat_raw), to_double(lon_raw)
    return [
        ("missing id", blank(id_raw)),
        ("non-numeric id", to_double(id_raw).isNull()),
        ("missing name", blank(name_raw)),
        ("missing coordinates", blank(lat_raw) | blank(lon_raw)),
        ("non-numeric coordinates", lat.isNull() | lon.isNull()),
        ("latitude out of range", ~lat.between(-90.0, 90.0)),
        ("longitude out of range", ~lon.between(-180.0, 180.0)),
    ]
