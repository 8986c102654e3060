"""Legs, profiles, quality and positions of ordered point sequences.

Points carry a dense ``seq`` inside their key. Neighbour access and running sums go through
``operators.ordered``, so a sequence of any length is worked on in blocks by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaway.functions import classify, geo
from seaway.operators.ordered import ends, over_blocks, running_sum


def legs(points: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """One row per leg: both ends, length in km and bearing. ``seq`` is that of the start point."""

    def build(x, w):
        return x.select("*", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))

    x = over_blocks(points, keys, seq, build, back=0, ahead=1).filter("lon2 is not null")
    return x.withColumnsRenamed({"lon": "lon1", "lat": "lat1"}).withColumns({
        "leg_km": geo.haversine_km("lon1", "lat1", "lon2", "lat2"),
        "bearing": geo.bearing_deg("lon1", "lat1", "lon2", "lat2")})


def route_legs(points: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Legs with the outgoing bearing of the next leg, the course change at the end point and its side."""

    def build(x, w):
        return x.select("*", *[F.lead(c, k).over(w).alias(f"{c}{k + 1}") for k in (1, 2) for c in ("lon", "lat")])

    x = over_blocks(points, keys, seq, build, back=0, ahead=2).filter("lon2 is not null")
    x = x.withColumnsRenamed({"lon": "lon1", "lat": "lat1"}).withColumns({
        "leg_km": geo.haversine_km("lon1", "lat1", "lon2", "lat2"),
        "bearing_in": geo.bearing_deg("lon1", "lat1", "lon2", "lat2"),
        "bearing_out": geo.bearing_deg("lon2", "lat2", "lon3", "lat3")})
    return x.withColumns({"turn": geo.turn_deg("bearing_in", "bearing_out"),
                          "side": F.when(F.col("bearing_out").isNotNull(), geo.turn_direction("bearing_in", "bearing_out"))})


def route_length(points: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Length in km and nautical miles, leg and point counts."""

    def build(x, w):
        return x.withColumn("_km", geo.haversine_km("lon", "lat", F.lead("lon").over(w), F.lead("lat").over(w)))

    return over_blocks(points, keys, seq, build, back=0).groupBy(*keys).agg(
        F.coalesce(F.sum("_km"), F.lit(0.0)).alias("km"), geo.km_to_nm(F.coalesce(F.sum("_km"), F.lit(0.0))).alias("nm"),
        (F.count(F.lit(1)) - 1).alias("segments"), F.count(F.lit(1)).alias("points"))


def route_profile(points: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Length of the leg that ends at each point and distance from the start, in metres."""

    def build(x, w):
        m = geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat")
        return x.withColumn("seg_m", F.coalesce(m, F.lit(0.0)))

    x = over_blocks(points, keys, seq, build, back=1, ahead=0)
    return running_sum(x, keys, seq, "seg_m", "cum_m")


def quality_metrics(points: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Length, end-to-end distance, tortuosity, mean and largest course change.

    ``gap_km`` and ``terminal_km`` columns of the points, where present, are summed into the
    transition and terminal lengths.
    """

    def build(x, w):
        lon1, lat1, lon0, lat0 = (F.lag(c, k).over(w) for k in (1, 2) for c in ("lon", "lat"))
        x = x.withColumns({"_x1": lon1, "_y1": lat1, "_x0": lon0, "_y0": lat0})
        return x.withColumns({
            "_km": geo.haversine_km("_x1", "_y1", "lon", "lat"),
            "_turn": geo.course_change_deg(("_x0", "_y0"), ("_x1", "_y1"), ("lon", "lat"))})

    x = over_blocks(points, keys, seq, build, back=2, ahead=0)
    pos = F.struct("lon", "lat")
    extra = {k: F.sum(k).alias(k) for k in ("gap_km", "terminal_km") if k in points.columns}
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum("_km"), F.lit(0.0)).alias("length_km"),
        F.coalesce(F.sum("_turn"), F.lit(0.0)).alias("_turns"), F.coalesce(F.max("_turn"), F.lit(0.0)).alias("max_turn"),
        F.min_by(pos, F.col(seq)).alias("_a"), F.max_by(pos, F.col(seq)).alias("_b"), *extra.values())
    g = g.withColumn("direct_km", geo.haversine_km("_a.lon", "_a.lat", "_b.lon", "_b.lat"))
    g = g.withColumns({
        "tortuosity": F.when(F.col("direct_km") > 0.0, F.col("length_km") / F.col("direct_km")).otherwise(1.0),
        "mean_turn": F.when(F.col("n_points") > 2, F.col("_turns") / (F.col("n_points") - 2)).otherwise(0.0)})
    if "terminal_km" in extra:
        g = g.withColumn("terminal_ratio", F.when(F.col("length_km") > 0.0, F.col("terminal_km") / F.col("length_km")).otherwise(0.0))
    return g.drop("_turns", "_a", "_b")


def voyage_profile(points: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Distance per latitude zone of the leg middle, hours, and fuel, at one decimal."""
    x = legs(points, keys, seq).withColumn("zone", classify.latitude_zone((F.col("lat1") + F.col("lat2")) / 2.0))
    nm = {z: F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("leg_km"))), F.lit(0.0)) / geo.KM_PER_NM for z in classify.ZONE_KNOTS}
    g = x.groupBy(*keys).agg(F.sum("leg_km").alias("_km"), *[v.alias(f"_{z}") for z, v in nm.items()])
    hours = {z: F.col(f"_{z}") / k for z, k in classify.ZONE_KNOTS.items()}
    free = hours["OPEN_OCEAN"] + hours["SUB_ANTARCTIC"]
    one = {
        "total_km": F.col("_km"), "total_nm": F.col("_km") / geo.KM_PER_NM, "open_nm": F.col("_OPEN_OCEAN"),
        "sub_nm": F.col("_SUB_ANTARCTIC"), "polar_nm": F.col("_POLAR"),
        "nominal_h": F.col("_km") / geo.KM_PER_NM / classify.ZONE_KNOTS["OPEN_OCEAN"], "adjusted_h": free + hours["POLAR"],
        "fuel_t": free / 24.0 * 35.0 + hours["POLAR"] / 24.0 * 48.0}
    return g.select(*keys, *[geo.js_round(v, 1).alias(k) for k, v in one.items()])


def arrival_schedule(points: DataFrame, start_ts: Column, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Hours from the start at zone speed, and the clock time, at every point."""

    def build(x, w):
        x = x.withColumns({"_x": F.lag("lon").over(w), "_y": F.lag("lat").over(w)})
        speed = classify.zone_knots(classify.latitude_zone((F.col("_y") + F.col("lat")) / 2.0))
        h = geo.haversine_km("_x", "_y", "lon", "lat") / geo.KM_PER_NM / speed
        return x.withColumn("leg_h", F.coalesce(h, F.lit(0.0))).drop("_x", "_y")

    x = running_sum(over_blocks(points, keys, seq, build, back=1, ahead=0), keys, seq, "leg_h", "cum_h")
    secs = F.floor(F.col("cum_h") * 3600.0 + 0.5).cast("bigint")
    return x.withColumn("arrival", F.timestamp_seconds(F.unix_timestamp(start_ts) + secs))


def decimate(points: DataFrame, keys: Sequence[str], seq: str, target: int = 150) -> DataFrame:
    """Every ``max(1, floor(n / target))``-th point, from the first."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / float(target)))
    return points.join(n, list(keys)).filter((F.col(seq) - 1) % step == 0).drop("_n")


def corridor(df: DataFrame, lat: float, half: float) -> DataFrame:
    return df.filter(F.col("lat").between(lat - half, lat + half))


def densify(points: DataFrame, max_km: float, keys: Sequence[str] = ("route_id",), seq: str = "seq", polar_guard: bool = False) -> DataFrame:
    """Split long legs into equal great-circle steps of at most ``max_km``; new points get fractional order ``step``.

    With ``polar_guard`` only legs over 25 km that touch latitude -55 are split, never the first or last.
    """

    def build(x, w):
        return x.withColumns({"_x2": F.lead("lon").over(w), "_y2": F.lead("lat").over(w), "_more": F.lead("lon", 2).over(w)})

    x = over_blocks(points, keys, seq, build, back=0, ahead=2)
    x = geo.let(x, _km=geo.haversine_km("lon", "lat", "_x2", "_y2"))
    km = F.col("_km")
    split = km > max_km
    if polar_guard:
        split = (km > 25.0) & ((F.col("lat") <= -55.0) | (F.col("_y2") <= -55.0)) & (F.col(seq) > 1) & F.col("_more").isNotNull()
    x = x.withColumn("_steps", F.when(F.col("_x2").isNotNull() & split, F.ceil(km / max_km)).otherwise(1).cast("int"))
    # the great circle is worked out once a leg, its points in steps over columns
    x = geo.with_arc(x, "lon", "lat", "_x2", "_y2")
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)).alias("step"))
    x = geo.arc_points(x, "lon", "lat", "_x2", "_y2", _p=F.col("step") / F.col("_steps"))
    inner = F.col("step") > 0
    return x.select(*keys, seq, F.col("step").cast("bigint").alias("step"), F.when(inner, F.col("_p_lon")).otherwise(F.col("lon")).alias("lon"),
                    F.when(inner, F.col("_p_lat")).otherwise(F.col("lat")).alias("lat"))


def seam_gaps(points: DataFrame, max_km: float = 200.0, keys: Sequence[str] = ("route_id",), seq: str = "seq") -> DataFrame:
    """Keys whose parts do not join: a part start more than ``max_km`` from the point before it, the antimeridian seam excepted."""

    def build(x, w):
        x = x.withColumns({"_x": F.lag("lon").over(w), "_y": F.lag("lat").over(w), "_p": F.lag("part_no").over(w)})
        near = lambda c: F.abs(F.abs(F.col(c)) - 180.0) <= 1.0
        seam = near("_x") & near("lon") & (F.abs(F.col("_y") - F.col("lat")) <= 5.0)
        return x.withColumn("_gap", (F.col("_p") != F.col("part_no")) & ~seam & (geo.haversine_km("_x", "_y", "lon", "lat") > max_km))

    x = over_blocks(points, keys, seq, build, back=1, ahead=0)
    return x.groupBy(*keys).agg(F.coalesce(F.bool_or("_gap"), F.lit(False)).alias("broken"))


def first_last_fix(points: DataFrame, keys: Sequence[str] = ("track_id",), order: str = "seq") -> DataFrame:
    """First and last fix in file order."""
    return ends(points, keys, order, [order, "lon", "lat", "ts"])


def progress(profile: DataFrame, marks: DataFrame, bucket_m: float = 100_000.0) -> DataFrame:
    """Position, bearing and progress at given distances along routes.

    ``profile`` comes from ``route_profile``; ``marks(mark_id, route_id, at_m)`` holds the distances. Legs
    are spread over distance buckets, so a mark meets only the legs of its own bucket, not its whole route.
    """

    def build(x, w):
        return x.withColumns({"_x2": F.lead("lon").over(w), "_y2": F.lead("lat").over(w), "_c2": F.lead("cum_m").over(w)})

    seg = over_blocks(profile, ["route_id"], "seq", build, back=0, ahead=1).filter("_x2 is not null").select(
        "route_id", "seq", "lon", "lat", F.col("cum_m").alias("c1"), F.col("_c2").alias("c2"), F.col("_x2").alias("lon2"), F.col("_y2").alias("lat2"))
    total = seg.groupBy("route_id").agg(F.max("c2").alias("total_m"), F.max("seq").alias("last_seq"))
    m = marks.join(total, "route_id")
    m = m.withColumn("_d", F.greatest(F.lit(0.0), F.least(F.col("at_m"), F.col("total_m"))))
    m = m.withColumn("_b", F.floor(F.col("_d") / bucket_m))
    s = seg.select("*", F.explode(F.sequence(F.floor(F.col("c1") / bucket_m), F.floor(F.col("c2") / bucket_m))).alias("_b"))
    start, done = (F.col("at_m") <= 0.0) | (F.col("total_m") <= 0.0), F.col("at_m") >= F.col("total_m")
    hit = F.when(start, F.col("seq") == 1).when(done, F.col("seq") == F.col("last_seq")).otherwise(
        (F.col("_d") > F.col("c1")) & (F.col("_d") <= F.col("c2")))
    j = m.join(s, ["route_id", "_b"]).filter(hit)
    f = F.when(start, 0.0).when(done, 1.0).when(F.col("c2") > F.col("c1"), (F.col("_d") - F.col("c1")) / (F.col("c2") - F.col("c1"))).otherwise(0.0)
    j = j.withColumn("_f", geo.clamp(f, 0.0, 1.0))
    j = j.withColumns({"_done": ~start & done, "_d": F.when(start, 0.0).otherwise(F.col("_d"))})
    return j.select(
        "mark_id", "route_id", (F.col("seq") - 1).alias("segment"),
        (F.col("lon") + (F.col("lon2") - F.col("lon")) * F.col("_f")).alias("lon"),
        (F.col("lat") + (F.col("lat2") - F.col("lat")) * F.col("_f")).alias("lat"),
        geo.bearing_deg("lon", "lat", "lon2", "lat2").alias("heading"), F.col("_d").alias("traveled_m"),
        (F.col("total_m") - F.col("_d")).alias("remaining_m"),
        F.when(F.col("total_m") > 0.0, F.col("_d") / F.col("total_m") * 100.0).otherwise(0.0).alias("percent"),
        F.col("_done").alias("completed"))
