"""Ring covers against plain ray casting."""

import math
import random

import pytest

from seaway.functions import geo
from seaway.operators import cover, spatial

POINT = "pid long, lon double, lat double"
EDGE = "ring_id long, edge_idx long, x1 double, y1 double, x2 double, y2 double"


def plain(points, edges, rule):
    out = set()
    for pid, x, y in points:
        if x is None or y is None:
            continue
        odd = {}
        for ring, _, x1, y1, x2, y2 in edges:
            if y1 == y2:
                continue
            xi = (y - y1) * (x2 - x1) / (y2 - y1) + x1
            if rule == "half_open":
                hit = (y1 > y) != (y2 > y) and x < xi
            else:
                hit = min(y1, y2) < y <= max(y1, y2) and x <= max(x1, x2) and (x1 == x2 or x <= xi)
            odd[ring] = odd.get(ring, 0) ^ hit
        out |= {(pid, r) for r, o in odd.items() if o}
    return out


def closed(ring, pts):
    return [(ring, i, *pts[i], *pts[(i + 1) % len(pts)]) for i in range(len(pts))]


def shapes(rnd):
    edges = closed(0, [(0.0, -60.0), (0.0, -59.0), (1.0, -59.0), (1.0, -60.0)])  # on whole degrees
    edges += closed(1, [(-30 + rnd.uniform(2, 20) * math.cos(a / 50 * math.pi), -60 + rnd.uniform(1, 8) * math.sin(a / 50 * math.pi)) for a in range(100)])  # jagged
    edges += closed(2, [(round(50 + 0.01 * math.cos(a), 4), round(-70 + 0.004 * math.sin(a), 4)) for a in range(6)])  # small
    edges += closed(3, [(-179.9, -80.0), (179.9, -80.0), (179.9, -85.0), (-179.9, -85.0)])  # wide
    edges += closed(3, [(-10.0, -82.0), (10.0, -82.0), (10.0, -83.0), (-10.0, -83.0)])  # with a hole
    comb = [(100.0, -50.0)]  # level steps
    for i in range(12):
        comb += [(100.0 + i, -49.0 + i % 3), (101.0 + i, -49.0 + i % 3), (101.0 + i, -49.5)]
    edges += closed(4, comb + [(113.0, -50.0)])
    edges += closed(5, [(20.0, -40.0), (25.0, -45.0), (25.0, -40.0), (20.0, -45.0)])  # crosses itself
    edges += closed(6, [(10.0, -20.0), (12.0, -20.0), (11.0, -20.0)])  # flat
    return edges


@pytest.mark.parametrize("rule", ["closed_right", "half_open"])
def test_cover_equals_ray_casting(spark, rule):
    rnd = random.Random(5)
    edges = shapes(rnd)
    pts = [(x, y) for x1, y1, x2, y2 in (e[2:] for e in edges) for x, y in ((x1, y1), ((x1 + x2) / 2, (y1 + y2) / 2), (x1, y2), (x1 + 1e-9, y1 - 1e-9))]
    pts += [(rnd.uniform(-55, 20), rnd.uniform(-72, -50)) for _ in range(600)] + [(rnd.uniform(-180, 180), rnd.uniform(-90, -38)) for _ in range(300)]
    pts += [(100 + rnd.randrange(0, 27) / 2, -50 + rnd.randrange(0, 9) / 2) for _ in range(150)]
    pts += [(rnd.uniform(49.98, 50.02), rnd.uniform(-70.01, -69.99)) for _ in range(150)]
    rows = [(i, *p) for i, p in enumerate(pts)] + [(10**6, None, -59.5), (10**6 + 1, 0.5, None)]
    table = cover.ring_cover(spark.createDataFrame(edges, EDGE))
    got = cover.points_in_cover(spark.createDataFrame(rows, POINT), table, rule).collect()
    assert len(got) == len({(r.pid, r.ring_id) for r in got})
    assert {(r.pid, r.ring_id) for r in got} == plain(rows, edges, rule)


def test_cover_is_small_and_answers_inside_without_edges(spark):
    ring = closed(1, [(20 * math.cos(a * math.pi / 500), -60 + 10 * math.sin(a * math.pi / 500)) for a in range(1000)])
    t = cover.ring_cover(spark.createDataFrame(ring, EDGE)).cache()
    assert t.filter("x1 is not null").count() < 8 * len(ring) and t.filter("x1 is null").count() > 200
    slanted = closed(1, [(0.0, 0.0), (60.0, 30.0), (0.0, 0.001)] + [(0.0, 0.001 * k) for k in range(2, 200)])
    assert cover.ring_cover(spark.createDataFrame(slanted, EDGE)).count() < 4 * len(slanted)  # along the edge, not its box


def test_cover_of_nothing(spark):
    none = cover.ring_cover(spark.createDataFrame([], EDGE))
    some = cover.ring_cover(spark.createDataFrame(closed(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]) + [(2, 0, None, 0.0, 1.0, 1.0)], EDGE))
    p = spark.createDataFrame([(1, 0.7, 0.2)], POINT)
    assert cover.points_in_cover(p, none).count() == 0 and cover.points_in_cover(p.filter("pid = 2"), some).count() == 0
    assert [tuple(r) for r in cover.points_in_cover(p, some).collect()] == [(1, 1)]


def test_stepwise_arcs_equal_the_plain_formulas(spark):
    rnd = random.Random(11)
    spot = lambda: (rnd.choice([0.0, 10.0, 179.0, rnd.uniform(-180, 180)]), rnd.choice([-60.0, 0.0, rnd.uniform(-89, 0)]))
    rows = [(*spot(), *spot(), *spot(), *spot(), rnd.choice([0.0, 0.5, 1.0, rnd.random()])) for _ in range(800)]
    for _ in range(400):  # short arcs that often cross, and arcs that share an end or a line
        x, y = spot()
        near = [(x + rnd.uniform(-1, 1), y - rnd.uniform(0, 1)) for _ in range(4)]
        rows += [(*near[0], *near[1], *near[2], *near[3], rnd.random()), (*near[0], *near[1], *near[1], *near[2], 0.3), (*near[0], *near[0], *near[0], *near[1], 0.3)]
    d = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, ex1 double, ey1 double, ex2 double, ey2 double, f double")
    lon, lat = geo.slerp("x1", "y1", "x2", "y2", "f")
    want = d.select("*", lon.alias("wlon"), lat.alias("wlat"))
    got = geo.arc_points(geo.with_arc(want, "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", p="f")
    assert got.columns == [*want.columns, "p_lon", "p_lat"]
    assert got.filter("not (p_lon <=> wlon and p_lat <=> wlat)").count() == 0
    v = spatial.edge_vectors(spatial.edge_vectors(d, "_s", "x1", "y1", "x2", "y2"), "_e", "ex1", "ey1", "ex2", "ey2")
    six = [geo.vec(p) for p in ("_sa", "_sb", "_sn", "_ea", "_eb", "_en")]
    both = geo.with_crossing(v.withColumn("want", geo.arc_param_vec(*six)), *six)
    assert both.filter("not (t <=> want)").count() == 0 and both.filter("t is not null").count() > 100
    assert geo.with_crossing(v, *six, only=True).count() == both.filter("t is not null").count()
