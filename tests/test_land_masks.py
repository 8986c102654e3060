"""Points and segments are looked up in masks of land cells where they are; only those on borders move."""

import random

from pyspark.sql import functions as F

from seaway.operators import cover, spatial, validate

RINGS = 60


def _land(spark):
    rnd = random.Random(5)
    rows = []
    for r in range(RINGS):
        x, y, a, b = rnd.uniform(-6, 6), rnd.uniform(-66, -60), rnd.uniform(0.2, 1.0), rnd.uniform(0.2, 1.0)
        v = [(x + 2 * a, y), (x + a, y + b), (x - a, y + b), (x - 2 * a, y), (x - a, y - b), (x + a, y - b)]
        rows += [(r, i, *v[i], *v[(i + 1) % 6]) for i in range(6)]
    return spark.createDataFrame(rows, "ring_id long, edge_idx long, x1 double, y1 double, x2 double, y2 double").cache()


def _brute(points, edges):
    """pids inside any ring, from all pairs."""
    from seaway.functions import geo

    hit = points.crossJoin(edges).filter(geo.ray_toggles("lon", "lat", "x1", "y1", "x2", "y2"))
    return {r.pid for r in hit.groupBy("pid", "ring_id").count().filter("count % 2 = 1").select("pid").distinct().collect()}


def _points(spark):
    rnd = random.Random(6)
    rows = [(i, round(rnd.uniform(-8, 8), 2), round(rnd.uniform(-67, -59), 2)) for i in range(600)]
    return spark.createDataFrame([*rows, (900, None, -60.0), (901, float("nan"), -62.0), (902, 1e9, -62.0)], "pid long, lon double, lat double")


def test_points_equal_all_pairs_with_and_without_broadcast(spark, monkeypatch):
    edges, p = _land(spark), _points(spark)
    want = _brute(p, edges)
    for rows in (500_000, 0):
        monkeypatch.setattr(cover, "MASK_ROWS", rows)
        got = [r.pid for r in cover.points_on_land(p, edges).collect()]
        assert sorted(got) == sorted(want) and 100 < len(want) < 600


def test_points_are_looked_up_without_a_shuffle(spark):
    plan = cover.with_land_state(_points(spark), _land(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_unsafe_segments_equal_their_parts(spark):
    """Middles and quarter points, crossings and clearance, each from all pairs; a sid may come twice."""
    edges, rnd = _land(spark), random.Random(7)
    rows = [(i // 2, x := rnd.uniform(-8, 8), y := rnd.uniform(-67, -59), x + rnd.uniform(-0.6, 0.6), y + rnd.uniform(-0.3, 0.3)) for i in range(120)]
    segs = spark.createDataFrame(rows, "sid long, x1 double, y1 double, x2 double, y2 double").selectExpr(
        "*", "if(sid % 2 = 0, x1, null) as dock_x", "if(sid % 2 = 0, y1, null) as dock_y", "if(sid % 2 = 0, 9.0D, 0.0D) as tol_km", "if(sid % 2 = 0, 0.0D, 5.0D) as clear_km").cache()
    from seaway.functions import geo

    s = segs.withColumn("t", F.explode(F.when(geo.haversine_km("x1", "y1", "x2", "y2") > 15.0, F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)])).otherwise(F.array(F.lit(0.5)))))
    lon, lat = geo.slerp("x1", "y1", "x2", "y2", "t")
    s = s.withColumns({"lon": F.when(F.col("t") == 0.5, (F.col("x1") + F.col("x2")) / 2.0).otherwise(lon), "lat": F.when(F.col("t") == 0.5, (F.col("y1") + F.col("y2")) / 2.0).otherwise(lat)})
    s = s.filter("dock_x is null").unionByName(s.filter("dock_x is not null").filter(geo.haversine_km("dock_x", "dock_y", "lon", "lat") > F.col("tol_km")))
    want = {p[0] for p in _brute(s.select(F.struct("sid", "lon", "lat").alias("pid"), "lon", "lat").distinct(), edges)}
    c = spatial.arc_crossings(segs, edges, with_t=True)
    at = geo.slerp("x1", "y1", "x2", "y2", "t")
    far = F.col("dock_x").isNull() | F.col("t").isNull() | (geo.haversine_km("dock_x", "dock_y", *at) > F.col("tol_km"))
    want |= {r.sid for r in c.filter(far).select("sid").collect()}
    want |= {r.sid for r in spatial.clearance_violations(segs.filter("dock_x is null"), edges).select("sid").collect()}
    got = [r.sid for r in validate.unsafe_segments(segs, edges).collect()]
    assert sorted(got) == sorted(want) and 5 < len(want) < 60
    arcs = segs.selectExpr("sid", "x1", "y1", "x2", "y2", "0.0D as clear_km").filter("sid % 2 = 1")
    plain = segs.filter("sid % 2 = 1").withColumn("clear_km", F.lit(0.0))
    short = {r.sid for r in segs.filter(geo.haversine_km("x1", "y1", "x2", "y2") <= 75.0).select("sid").collect()} - {r.sid for r in segs.filter(geo.haversine_km("x1", "y1", "x2", "y2") > 75.0).select("sid").collect()}
    assert {r.sid for r in validate.unsafe_arcs(arcs, edges).collect()} & short == {r.sid for r in validate.unsafe_segments(plain, edges).collect()} & short
