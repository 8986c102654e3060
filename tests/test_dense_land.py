"""Land that lies over itself many times: the same answers with bounded work."""

import random

from pyspark.sql import functions as F

from seaway.operators import spatial, validate
from seaway.operators.cover import points_on_land

EDGE = "ring_id long, edge_idx long, x1 double, y1 double, x2 double, y2 double"


def stacked(spark, n=40, seed=3, lon=(-20.0, 20.0)):
    rnd, out = random.Random(seed), []
    for r in range(n):
        cx, cy, w, h = rnd.uniform(*lon), rnd.uniform(-70, -62), rnd.uniform(0.4, 3), rnd.uniform(0.3, 2)
        ring = [(cx + w * a, cy + h * b) for a, b in ((2, 0), (1, 1), (-1, 1), (-2, 0), (-1, -1), (1, -1))]
        out += [(r, k, *ring[k], *ring[(k + 1) % 6]) for k in range(6)]
    return spark.createDataFrame(out, EDGE)


def scattered(spark, n=400, seed=5, reach=1.0):
    rnd, out = random.Random(seed), []
    for i in range(n):
        x, y, d = rnd.uniform(-25, 25), rnd.uniform(-73, -60), reach if i % 5 else 1e-5
        out.append((i, x, y, x + rnd.uniform(-d, d), y + rnd.uniform(-d, d)))
    return spark.createDataFrame(out, "sid long, x1 double, y1 double, x2 double, y2 double")


def test_points_on_land_is_one_row_a_point(spark):
    land = stacked(spark)
    p = scattered(spark).select(F.col("sid").alias("pid"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    for rule in ("closed_right", "half_open"):
        want = {r.pid for r in spatial.points_in_rings(p, land, rule).collect()}
        got = [r.pid for r in points_on_land(p, land, rule).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_steps_crossed_gives_the_pairs_of_arc_crossings(spark):
    land, s = stacked(spark), scattered(spark)
    s = s.unionByName(spark.createDataFrame([(1000, 179.8, -65.0, -179.9, -65.4), (1001, -179.95, -65.2, 179.7, -65.1)], s.schema))
    land = land.unionByName(stacked(spark, 6, 9, (176.0, 178.0)).withColumn("ring_id", F.col("ring_id") + 100))
    key = lambda df: sorted((r.sid, r.ring_id, r.edge_idx, round(r.t, 9)) for r in df.collect())
    want = key(spatial.arc_crossings(s, land, with_t=True))
    assert key(spatial.steps_crossed(s, land, 0.6)) == want and len(want) > 100


def test_legs_that_fail_at_once_take_no_further_steps(spark, monkeypatch):
    land = stacked(spark)
    pts = spark.createDataFrame([(r, k + 1, -20.0 + 0.9 * r + 3 * k, -66.0 + 0.4 * k) for r in range(30) for k in range(4)], "route_id long, seq long, lon double, lat double")
    ends = pts.select("route_id").distinct().select("route_id", F.lit(1.5).alias("dep_tol"), F.lit(2.5).alias("dest_tol"), F.lit(1).alias("dep_legs"), F.lit(1).alias("dest_legs"))
    row = lambda df: sorted((r.route_id, r.seq, r.reason) for r in df.collect())
    tested, step = [], validate._first_failing
    monkeypatch.setattr(validate, "_first_failing", lambda legs, *a: tested.append(legs.count()) or step(legs, *a))
    got = row(validate.failing_segments(pts, ends, land))
    assert tested[0] == 90 and tested[0] > tested[1] >= tested[2]
    monkeypatch.setattr(validate, "STEP_WAVES", ((1, None),))
    assert got == row(validate.failing_segments(pts, ends, land)) and len(got) > 30


def test_only_segments_with_a_free_middle_meet_edges(spark, monkeypatch):
    land, s = stacked(spark), scattered(spark, 120)
    mids = s.select(F.col("sid").alias("pid"), ((F.col("x1") + F.col("x2")) / 2).alias("lon"), ((F.col("y1") + F.col("y2")) / 2).alias("lat"))
    wet = {r.pid for r in spatial.points_in_rings(mids, land, "half_open").collect()}
    want = wet | {r.sid for r in spatial.planar_crossings(s, land).collect()}
    met, plain = [], spatial.planar_crossings
    monkeypatch.setattr(spatial, "planar_crossings", lambda segs, edges: met.append(segs.count()) or plain(segs, edges))
    got = [r.sid for r in spatial.blocked_sight(s, land).collect()]
    assert set(got) == want and len(got) == len(want) and met == [120 - len(wet)]
    assert {r.sid for r in spatial.blocked_connectors(s, land, 0.0).collect()} <= want and met[1] < 120


def test_clearance_meets_few_edge_starts(spark, monkeypatch):
    land = stacked(spark)
    s = scattered(spark, 100).withColumn("clear_km", F.lit(22.0))
    met, far = [], spatial.explode_cells
    monkeypatch.setattr(spatial, "explode_cells", lambda df, *a, **k: met.append("ring_id" in df.columns) or far(df, *a, **k))
    got = {(r.sid, r.ring_id, r.edge_idx): r.km for r in spatial.clearance_violations(s, land).collect()}
    assert met == [False]  # edge starts lie in one cell each and are not spread over the cells of their edges
    j = s.crossJoin(land.select("ring_id", "edge_idx", F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("x2").alias("qx"), F.col("y2").alias("qy")))
    # the rule of the query: the box of the edge comes within 1.1 times the clearance in plain degrees
    g = 22 * 1.1 / 111
    j = j.filter(f"greatest(px, qx) >= least(x1, x2) - {g} and least(px, qx) <= greatest(x1, x2) + {g} and greatest(py, qy) >= least(y1, y2) - {g} and least(py, qy) <= greatest(y1, y2) + {g}")
    near = j.withColumn("km", spatial.geo.point_segment_m("px", "py", "x1", "y1", "x2", "y2") / 1000).filter("km < 18")
    want = {(r.sid, r.ring_id, r.edge_idx): r.km for r in near.collect()}
    assert want and all(abs(got[k] - v) < 1e-6 for k, v in want.items()) and max(got.values()) < 22


def test_segments_on_land_by_a_point_meet_no_edges(spark, monkeypatch):
    land, none = stacked(spark), F.lit(None).cast("double")
    s = scattered(spark, 60).select("*", none.alias("dock_x"), none.alias("dock_y"), F.lit(0.0).alias("tol_km"), F.lit(0.0).alias("clear_km"))
    met, near = [], spatial.edges_near
    monkeypatch.setattr(spatial, "edges_near", lambda segs, *a: met.append(segs.count()) or near(segs, *a))
    got = [r.sid for r in validate.unsafe_segments(s, land).collect()]
    assert len(got) == len(set(got)) and 0 < 60 - met[0] <= len(got) and met[0] < 60
