"""Ways over the overlay against plain searches, and invariants of whole route plans."""

import os
import random

import pytest
from pyspark.sql import functions as F

from seaway.functions import geo
from seaway.operators import graph as g
from seaway.operators import overlay as ov
from seaway.operators.validate import failing_segments
from seaway.plans import routing as rt
from seaway.registry import routing as queries
from seaway.session import settle

SF = "/root/testdata/sf0.001"


def lattice(spark, seed, side=10):
    """A lattice with holes, doubled edges and whole kilometres, so that sums are exact."""
    pick = random.Random(seed)
    gone = {n for n in range(side * side) if pick.random() < 0.15}
    nodes = [(n, -60.0 + 0.9 * (n % side), -70.0 + 0.9 * (n // side)) for n in range(side * side)]
    edges = []
    for n in range(side * side):
        for m in ([n + 1] if (n + 1) % side else []) + [n + side]:
            if m < side * side and not {n, m} & gone:
                edges += [(n, m, float(pick.randint(1, 9)))] * pick.choice([1, 1, 2])
    return spark.createDataFrame(nodes, "node_id long, lon double, lat double"), settle(spark.createDataFrame(edges, "src long, dst long, weight_km double"))


@pytest.mark.parametrize("cell", [9, 40])
def test_overlay_equals_plain_search(spark, cell):
    nodes, edges = lattice(spark, cell)
    pick = random.Random(1)
    pairs = {(pick.randrange(100), pick.randrange(100)) for _ in range(12)} | {(5, 5), (0, 1)}
    p = settle(spark.createDataFrame(sorted(pairs), "source long, target long"))
    dist, points = ov.pair_paths(ov.build_overlay(nodes, edges, cell), p)
    got = {(r.source, r.target): r.dist_km for r in dist.collect()}
    plain = g.shortest_paths(edges, p.select("source").distinct())
    want = {(r.source, r.node_id): r.dist_km for r in plain.join(p.withColumnRenamed("target", "node_id"), ["source", "node_id"]).collect()}
    assert got == want
    weight = {}
    for r in edges.collect():
        for e in ((r.src, r.dst), (r.dst, r.src)):
            weight[e] = min(weight.get(e, 99.0), r.weight_km)
    ways = {}
    for r in points.collect():
        ways.setdefault((r.source, r.target), {})[r.hop] = r.node_id
    assert ways.keys() == got.keys()
    for pair, way in ways.items():
        nodes_on = [way[i] for i in range(len(way))]
        assert (nodes_on[0], nodes_on[-1]) == pair and sum(weight[e] for e in zip(nodes_on, nodes_on[1:], strict=False)) == got[pair]


@pytest.mark.skipif(not os.environ.get("SEAWAY_SLOW_TESTS"), reason="about seven minutes; set SEAWAY_SLOW_TESTS=1")
def test_whole_plans_keep_their_promises(spark):
    req, water, we, lane, le, snaps = queries._setup(spark, SF)
    land = settle(queries.ring_edges(spark, SF))
    points, summary = rt.plan_routes(req, water, we, snaps, queries.view(spark, SF, "v_gateways"), lane, le, land)
    points, rows = settle(points), {r.pair_id: r for r in summary.collect()}
    ask = {r.pair_id: r for r in req.collect()}
    assert rows.keys() == ask.keys()
    ends = {r.route_id: r for r in points.groupBy("route_id").agg(
        F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"), F.count("*").alias("n"), F.max("seq").alias("m")).collect()}
    assert ends.keys() == {k for k, r in rows.items() if r.status == "SUCCESS"}  # failed routes have no points
    for k, r in rows.items():
        if ask[k].a_id is None or ask[k].b_id is None or ask[k].a_id == ask[k].b_id:
            assert r.status == "NO_FEASIBLE_ROUTE" and r.strategy is None
    metres = lambda x, y, u, v: geo.haversine_m(F.lit(x), F.lit(y), F.lit(u), F.lit(v))
    for k, e in ends.items():
        q = ask[k]
        d = spark.range(1).select(metres(q.a_lon, q.a_lat, e.a.lon, e.a.lat), metres(q.b_lon, q.b_lat, e.b.lon, e.b.lat), metres(q.a_lon, q.a_lat, q.b_lon, q.b_lat)).first()
        assert d[0] < 1.0 and d[1] < 1.0 and rows[k].length_km >= d[2] / 1000.0 - 1e-6 and e.n == e.m >= 2
    # a plan that passes has no leg over land outside the harbours
    own = req.select(F.col("pair_id").alias("route_id"), F.col("a_tol").alias("dep_tol"), F.col("b_tol").alias("dest_tol"), F.lit(4).cast("bigint").alias("dep_legs"), F.lit(4).cast("bigint").alias("dest_legs"))
    assert failing_segments(points, own, land).filter("reason not like 'Terminal%'").isEmpty()
