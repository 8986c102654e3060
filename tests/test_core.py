"""Hand-made cases and brute-force comparisons."""

import heapq
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seaway.functions import clean, geo
from seaway.operators import folds, gateways, ingest, ordered, ports, reconcile, smooth, spatial, tracks, validate
from seaway.operators import graph as g
from seaway.session import size_by_rows

R = 6371008.8


def hav(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    s = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(s)))


def brg(a, b):
    p1, p2, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    return math.degrees(math.atan2(math.sin(d) * math.cos(p2), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * math.cos(d))) % 360


def walk(n, seed=1, step=0.2, lon=0.0, lat=-58.0):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        lon, lat = lon + rnd.uniform(0, step), max(-80.0, min(-40.0, lat + rnd.uniform(-step, step)))
        out.append((round(lon, 6), round(lat, 6)))
    return out


SQUARE = [(1, k, *e) for k, e in enumerate([(0.0, -60.0, 1.0, -60.0), (1.0, -60.0, 1.0, -59.0), (1.0, -59.0, 0.0, -59.0), (0.0, -59.0, 0.0, -60.0)])]
EDGE = "ring_id long, edge_idx long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def island(spark):
    return spark.createDataFrame(SQUARE, EDGE)


def test_dates_roll_over(spark):
    d = spark.createDataFrame([("2020123",), ("2019366",), ("2019400",), ("20201",), ("",)], "t string")
    assert [r[0] for r in d.select(clean.parse_yyyyddd("t")).collect()] == ["2020-05-02", "2020-01-01", "2020-02-04", None, None]
    assert [r[0] for r in d.select(clean.parse_yyyyddd("t", strict=False)).collect()][3:] == ["20201", ""]


def test_reject_order(spark):
    rows = [("", "", "", ""), ("abc", "p", "1", "1"), ("1.0", " ", "", ""), ("1", "p", "", "2"), ("1", "p", "x", "2"), ("1", "p", "91", "2"), ("1", "p", "1", "181"), ("1", "p", "1", "2")]
    d = spark.createDataFrame(rows, "i string, n string, y string, x string")
    rules = clean.port_rules("i", "n", "y", "x")
    ok, bad = ingest.split_valid(d, rules)
    assert ok.count() == 1
    assert [r["reason"] for r in bad.collect()] == [
        "missing id", "non-numeric id", "missing name", "missing coordinates", "non-numeric coordinates", "latitude out of range", "longitude out of range"]


def test_duration_text(spark):
    d = spark.createDataFrame([(v,) for v in (0.0, 0.2, 14.0, 24.0, 47.9, 76.0)], "h double")
    assert [r[0] for r in d.select(geo.format_duration("h")).collect()] == ["0h", "1h", "14h", "1d", "1d 24h", "3d 4h"]


def test_point_segment_cases(spark):
    d = spark.createDataFrame([(0.5, 1.0, 0.0, 0.0, 1.0, 0.0), (-2.0, 0.0, 0.0, 0.0, 1.0, 0.0), (3.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 1.0, 0.0, 0.0, 0.0, 0.0)],
                              "p double, q double, a double, b double, c double, d double")
    got = [r[0] for r in d.select(geo.point_segment_m("p", "q", "a", "b", "c", "d")).collect()]
    deg = R * math.pi / 180
    for a, b in zip(got, [deg, 2 * deg, 2 * deg, 0.0, hav((1, 1), (0, 0))]):
        assert abs(a - b) < 1e-3


def test_blocks_equal_plain_windows(spark):
    d = spark.range(0, 500).select((F.col("id") % 3).alias("k"), (F.floor(F.col("id") / 3) + 1).alias("seq"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    w = Window.partitionBy("k").orderBy("seq")
    build = lambda x, w: x.withColumns({"a": F.lag("v", 2).over(w), "b": F.lead("v").over(w)})
    assert sorted(map(str, ordered.over_blocks(d, ["k"], "seq", build, back=2, ahead=1, block=7).collect())) == sorted(map(str, build(d, w).collect()))
    got = {(r.k, r.seq): r.s for r in ordered.running_sum(d, ["k"], "seq", "v", "s", block=7).collect()}
    assert got == {(r.k, r.seq): r.s for r in d.withColumn("s", F.sum("v").over(w)).collect()}
    num = ordered.number_rows(d.drop("seq").withColumn("o", F.col("v")), ["k"], ["o"], F.floor(F.col("o") / 4))
    assert num.groupBy("k").agg(F.max("seq").alias("m"), F.count_distinct("seq").alias("c")).filter("m != c").count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_dedupe_is_a_plain_scan(spark, block):
    pts = walk(60, 3, 0.00002)
    last, want = None, []
    for i, p in enumerate(pts, 1):
        if last is None or hav(last, p) >= 1.0:
            want.append(i)
            last = p
    d = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts, 1)], "route_id long, seq long, lon double, lat double")
    assert sorted(r.seq for r in folds.dedupe_consecutive(d, 1.0, block=block).collect()) == want


@pytest.mark.parametrize("block", [8, 1024])
def test_waypoints_are_a_plain_scan(spark, block):
    pts = walk(70, 5)
    prev, want, n = 0, [0], len(pts)
    for i in range(1, n - 1):
        leg = hav(pts[prev], pts[i]) / 1000
        if leg < 5.0 and i < n - 2:
            continue
        t = abs(brg(pts[i], pts[i + 1]) - brg(pts[prev], pts[i]))
        t = 360 - t if t > 180 else t
        border = (pts[prev][1] > -60 >= pts[i][1]) or (pts[prev][1] > -50 >= pts[i][1])
        if t >= 3 or border or i in (1, n - 2):
            want.append(i)
            prev = i
    want.append(n - 1)
    d = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts, 1)], "route_id long, seq long, lon double, lat double")
    got = folds.navigational_waypoints(d, block=block).orderBy("wp_index").collect()
    assert [(r.lon, r.lat) for r in got] == [pts[i] for i in want]
    assert got[0].name == "BERTH_DEP" and got[-1].name == "BERTH_ARR" and got[1].name == "FAIRWAY_DEP" and got[-2].name == "FAIRWAY_ARR"


def test_ring_rules(spark, island):
    p = spark.createDataFrame([(0, 0.5, -59.5), (1, 2.0, -59.5), (2, 0.0, -59.5), (3, 1.0, -59.5)], "pid long, lon double, lat double")
    assert {r.pid for r in spatial.points_in_rings(p, island).collect()} == {0, 3}
    assert {r.pid for r in spatial.points_in_rings(p, island, "half_open").collect()} == {0, 2}


def test_knn_equals_brute_force(spark):
    rnd = random.Random(7)
    a = [(i, rnd.uniform(-180, 180), rnd.uniform(-89, -40)) for i in range(60)]
    b = [(i, rnd.uniform(-180, 180), rnd.uniform(-89, -40)) for i in range(300)]
    got = spatial.knn(spark.createDataFrame(a, "pid long, lon double, lat double"), "pid", spark.createDataFrame(b, "tid long, tlon double, tlat double"), "tid", 3, [300.0, 20100.0])
    got = {(r.pid, r.rank): r.tid for r in got.collect()}
    for i, x, y in a:
        best = sorted((hav((x, y), (u, v)), t) for t, u, v in b)[:3]
        assert [got[(i, k)] for k in (1, 2, 3)] == [t for _, t in best]


def test_unsafe_segments_cases(spark, island):
    s = [(1, -1.0, -59.5, 2.0, -59.5), (2, -1.0, -58.0, 2.0, -58.0), (3, 179.5, -59.5, -179.5, -59.5), (4, -1.0, -59.5, 0.5, -59.5), (5, 5.0, -59.0, 5.0, -59.0)]
    d = spark.createDataFrame([(*r, None, None, 0.0, 0.0) for r in s], "sid long, x1 double, y1 double, x2 double, y2 double, dock_x double, dock_y double, tol_km double, clear_km double")
    assert {r.sid for r in validate.unsafe_segments(d, island).collect()} == {1, 4}
    near = spark.createDataFrame([(1, -1.0, -58.95, 2.0, -58.95, None, None, 0.0, c) for c in (20.0,)], d.schema)
    assert validate.unsafe_segments(near, island).count() == 1
    arcs = d.select("sid", "x1", "y1", "x2", "y2", "clear_km")
    assert {r.sid for r in validate.unsafe_arcs(arcs, island).collect()} == {1, 4}


def test_detour_goes_round(spark, island):
    s = spark.createDataFrame([(1, -1.0, -59.2, 2.0, -59.2)], "sid long, x1 double, y1 double, x2 double, y2 double")
    p = [(r.lon, r.lat) for r in smooth.detour_repair(s, island).orderBy("pos").collect()]
    assert p
    line = [(-1.0, -59.2), *p, (2.0, -59.2)]
    legs = spark.createDataFrame([(i, *a, *b, 0.0) for i, (a, b) in enumerate(zip(line, line[1:]))], "sid long, x1 double, y1 double, x2 double, y2 double, clear_km double")
    assert validate.unsafe_arcs(legs, island).count() == 0


def test_string_pull_keeps_ends_and_water(spark, island):
    pts = [(-1.0 + 0.3 * i, -58.6 + 0.02 * (i % 2)) for i in range(11)]
    d = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts, 1)], "route_id long, seq long, lon double, lat double")
    out = [(r.lon, r.lat) for r in smooth.string_pull(d, island).orderBy("seq").collect()]
    assert out[0] == pts[0] and out[-1] == pts[-1] and len(out) < len(pts)


def test_validation_pass_and_fail(spark, island):
    rows = [(1, 1, -1.0, -58.0), (1, 2, 2.0, -58.0), (2, 1, -1.0, -59.5), (2, 2, 2.0, -59.5), (3, 1, 5.0, -58.0)]
    p = spark.createDataFrame(rows, "route_id long, seq long, lon double, lat double")
    e = spark.createDataFrame([(1, -1.0, -58.0, 2.0, -58.0, 1.5, 1.5, 1, 1), (2, -1.0, -59.5, 2.0, -59.5, 1.5, 1.5, 1, 1), (3, 5.0, -58.0, 5.0, -58.0, 1.5, 1.5, 1, 1)],
                              "route_id long, dep_lon double, dep_lat double, dest_lon double, dest_lat double, dep_tol double, dest_tol double, dep_legs long, dest_legs long")
    rep = {r.route_id: r for r in validate.validate_routes(p, e, island).collect()}
    assert [rep[i].result for i in (1, 2, 3)] == ["PASS", "FAIL", "FAIL"]
    assert "1.5 km dock tolerance" in rep[2].first_reason
    assert {r.route_id for r in validate.suppress_invalid(p, validate.validate_routes(p, e, island)).collect()} == {1}


def test_paths_against_dijkstra(spark):
    import heapq

    rnd = random.Random(11)
    edges = [(i, rnd.randrange(40), rnd.randrange(1, 20)) for i in range(40) for _ in range(2)] + [(50, 51, 3)]
    adj = {}
    for u, v, w in edges:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    dist, heap = {0: 0}, [(0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in adj[u]:
            if d + w < dist.get(v, 1e9):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    e = spark.createDataFrame(edges, "src long, dst long, weight_km long")
    sp = g.shortest_paths(e, spark.createDataFrame([(0,)], "source long"))
    assert {r.node_id: r.dist_km for r in sp.collect()} == dist
    pairs = spark.createDataFrame([(0, 39), (0, 51)], "source long, target long")
    rows = g.path_points(sp, pairs).orderBy("hop").collect()
    nodes = [r.node_id for r in rows]
    assert nodes[0] == 0 and nodes[-1] == 39
    assert sum(min(w for v, w in adj[a] if v == b) for a, b in zip(nodes, nodes[1:])) == dist[39]
    n = spark.createDataFrame([(i,) for i in {u for u, _, _ in edges} | {v for _, v, _ in edges} | {99}], "node_id long")
    comp = {r.node_id: r.component_id for r in g.connected_components(n, e).collect()}
    assert comp[51] == 50 and comp[99] == 99 and all((comp[u] == 0) == (u in dist) for u in comp)


def test_chain_components(spark):
    e = spark.range(0, 300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    n = spark.range(0, 301).select(F.col("id").alias("node_id"))
    assert g.connected_components(n, e).filter("component_id != 0").count() == 0


def test_search_scores(spark):
    p = spark.createDataFrame([(63130, "Port Stanley", None, "Falklands", "America"), (631, "Bay", "Portside", "USA", "America"), (7, "Newport", None, "Peru", "port region")],
                              "port_id long, port_name string, alternate_name string, country string, region_name string")
    q = spark.createDataFrame([(0, "63130"), (1, "631"), (2, "port"), (3, "us"), (4, "  ")], "query_id long, text string")
    got = {}
    for r in ports.search_ports(q, p).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.port_id, r.score))
    assert got == {0: [(63130, 1000)], 1: [(631, 1000), (63130, 500)], 2: [(63130, 300), (631, 250), (7, 180)], 3: [(631, 40)]}


def test_search_of_many_queries(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    rows = [(i, word(), word() if i % 3 else None, word(), None if i % 7 == 0 else word()) for i in range(40)]
    p = spark.createDataFrame(rows, "port_id long, port_name string, alternate_name string, country string, region_name string")
    asked = [(i, rng.choice([word(), word().upper() + "\t", str(rng.randint(0, 40))])) for i in range(1500)] + [(5000, None), (5001, "\n "), (5002, "zzz"), (5003, "")]
    got = {}
    for r in ports.search_ports(spark.createDataFrame(asked, "query_id long, text string"), p).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.port_id, r.score))
    steps = lambda t, q, a, b, c: a if t == q else b if t.startswith(q) else c if q in t else 0
    for i, t in asked:
        q, found = (t or "").strip().lower(), []
        for pid, name, alt, country, region in rows if q else []:
            s = (1000 if str(pid) == q else 500 if str(pid).startswith(q) else 0) if q.isdigit() else 0
            s += steps(name, q, 500, 300, 150) + (steps(alt, q, 400, 250, 100) if alt else 0)
            s += 80 if country == q else 40 if country.startswith(q) else 30 if q in (region or "") else 0
            found += [(-s, pid)] if s else []
        assert sorted(got.get(i, [])) == [(n + 1, pid, -s) for n, (s, pid) in enumerate(sorted(found)[:6])], (i, t)


def test_progress_boundaries(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 3.0, 0.0)], "route_id long, seq long, lon double, lat double")
    m = spark.createDataFrame([(0, 1, -5.0), (1, 1, hav((0, 0), (1, 0)) * 2), (2, 1, 1e9)], "mark_id long, route_id long, at_m double")
    r = {x.mark_id: x for x in tracks.progress(tracks.route_profile(d), m).collect()}
    assert (r[0].percent, r[0].completed, r[2].percent, r[2].completed) == (0.0, False, 100.0, True)
    assert abs(r[1].lon - 2.0) < 1e-6 and r[1].segment == 1


def test_corrections_have_old_and_new(spark):
    b = spark.createDataFrame([(1, 0.0, -60.0, 10.0), (2, 1.0, -61.0, 5.0)], "berg_id long, lon double, lat double, area_km2 double")
    p = spark.createDataFrame([(1, 0.0, -60.1, 9.0)], "berg_id long, lon double, lat double, area_km2 double")
    x = reconcile.compare_snapshots(b, p)
    c = {(r.berg_id, r.attribute): r for r in reconcile.corrections(x).collect()}
    assert set(c) == {(1, "COORDINATES_AND_OBSERVATION_DATE"), (1, "AREA_AND_DIMENSIONS")}
    assert c[(1, "AREA_AND_DIMENSIONS")].old.area_km2 == 9.0


def test_seams_are_tested_on_the_parts_as_given(spark):
    from seaway.plans import routing as rt

    rows = [(1, 1, 1, 0.0, -60.0), (1, 1, 2, 1.0, -60.0), (1, 2, 1, 1.0, -60.0), (1, 2, 2, 10.0, -60.0), (1, 2, 3, 11.0, -60.0)]
    rows += [(2, 1, 1, 0.0, -60.0), (2, 2, 1, 9.0, -60.0)]  # a part that starts 500 km away
    rows += [(3, 1, 1, 0.0, -60.0), (3, 1, 2, 0.5, -95.0)]  # a bad coordinate
    got = rt.assemble_polyline(spark.createDataFrame(rows, "route_id long, part_no int, seq long, lon double, lat double"))
    assert sorted((r.route_id, r.seq, r.lon) for r in got.collect()) == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 10.0), (1, 4, 11.0)]


def test_shortest_paths_stop_behind_the_farthest_target(spark):
    from seaway.operators import graph as g

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)] + [(0, 5, 2.0)], "src long, dst long, weight_km double")
    src = spark.createDataFrame([(0,), (50,)], "source long")
    want = {(r.source, r.node_id): r.dist_km for r in g.shortest_paths(edges, src).collect()}
    targets = spark.createDataFrame([(0, 9), (0, 3), (50, 48)], "source long, node_id long")
    got = {(r.source, r.node_id): r.dist_km for r in g.shortest_paths(edges, src, targets=targets).collect()}
    assert got == {k: d for k, d in want.items() if d <= (6.0 if k[0] == 0 else 2.0)}
    none = spark.createDataFrame([(0, 99)], "source long, node_id long")
    assert g.shortest_paths(edges, src, targets=none).count() == len(want)


def test_absent_targets_with_reasons(spark):
    import datetime

    from seaway.operators import reconcile as rc

    day = datetime.datetime(2025, 1, 1)
    fixes = spark.createDataFrame([("a1", 1, day, 0.0, -60.0), ("b2", 1, day, 1.0, -61.0), ("c3", 1, day, 2.0, -62.0)], "track_id string, seq long, ts timestamp, lon double, lat double")
    base = spark.createDataFrame([("c3",)], "berg_id string")
    reasons = spark.createDataFrame([("A1", "melted", "high", "KEPT", "none"), (None, "unknown", "low", "KEPT", "none")], "berg_id string, why_absent string, relevance string, disposition string, action string")
    got = {r.berg_id: r.why_absent for r in rc.missing_from_baseline(fixes, base, reasons=reasons).collect()}
    assert got == {"a1": "melted", "b2": "unknown"}
    assert {r.why_absent for r in rc.missing_from_baseline(fixes, base).collect()} == {None}


def test_tables_that_pack_well_are_not_broadcast(spark, tmp_path):
    """A small file of many rows: its rows decide how the registry joins are planned, not its bytes."""
    from seaway.registry.safety import outlines
    from seaway.views import view

    n = 400_000
    spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 8).alias("p_brand"), F.lit("PROMO").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") % 9).cast("double").alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert sum(f.stat().st_size for f in (tmp_path / "part.parquet").iterdir()) < 10 << 20
    base, prev = view(spark, str(tmp_path), "v_bergs"), view(spark, str(tmp_path), "v_bergs_prev")
    x = reconcile.apply_update(base, prev, outlines(spark, str(tmp_path)))[1]
    assert "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()
    assert x.count() == 5 * n


@pytest.mark.parametrize("km", [5.0, 20.0, 37.0, 80.0])
def test_radius_join_sees_the_last_column_before_the_antimeridian(spark, km):
    pts = spark.createDataFrame([(1, -180.0, -75.0), (2, 179.99, -75.0), (3, -179.9, -75.0)], "pid long, lon double, lat double")
    tg = spark.createDataFrame([(k, lon, -75.0) for k, lon in enumerate([*[175.0 + i / 100.0 for i in range(500)], -179.9, -179.6])], "tid long, tlon double, tlat double")
    got = {(r.pid, r.tid) for r in spatial.radius_join(pts, tg, km).collect()}
    want = {(p.pid, t.tid) for p in pts.collect() for t in tg.collect() if hav((p.lon, p.lat), (t.tlon, t.tlat)) <= km * 1000}
    assert got == want


@pytest.mark.parametrize("before, after", [("10485760b", "1048576"), ("256k", "256k"), ("8m", "1048576"), ("-1", "-1")])
def test_broadcasts_by_the_planner_are_bounded(spark, before, after):
    name, factor = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.fileCompressionFactor"
    spark.conf.set(name, before)
    spark.conf.set(factor, "1.0")
    size_by_rows(spark)
    got = spark.conf.get(name)
    spark.conf.unset(name)
    spark.conf.unset(factor)
    assert got == after


def test_sector_top_equals_plain_choice_in_any_chunks(spark):
    """Leaders of the sectors, then the rest; chunks of the catalogue change nothing."""
    rnd = random.Random(5)
    gws = [(i, rnd.choice(["A", "B", "C", None]), rnd.uniform(-180, 180), -60.0, rnd.uniform(-180, 180), -55.0, float(i % 9)) for i in range(40)]
    cat = spark.createDataFrame(gws, "gateway_id long, sector string, polar_lon double, polar_lat double, global_lon double, global_lat double, gap_km double")
    pairs = [(i, rnd.uniform(-180, 180), rnd.uniform(-80, -40), rnd.uniform(-180, 180), rnd.uniform(-80, -40)) for i in range(30)]
    p = spark.createDataFrame(pairs, "pair_id long, a_lon double, a_lat double, b_lon double, b_lat double")
    want = set()
    for i, ax, ay, bx, by in pairs:
        est = sorted((round((hav((ax, ay), (g[2], g[3])) + hav((g[4], g[5]), (bx, by))) / 1000 + g[6] * (3 if g[6] > 5 else 1), 4), g[0], g[1] or "Other") for g in gws)
        lead = [e for e in est if [o for o in est if o[2] == e[2]].index(e) < 2][:6]
        chosen = (lead + [e for e in est if e not in lead])[:6]
        want |= {(i, e[1], n + 1) for n, e in enumerate(chosen)}
    for most in (100, 15):
        out = gateways.sector_top(p, cat, max_catalog=most)
        assert {(r.pair_id, r.gateway_id, r.pick) for r in out.collect()} == want


def test_shortest_paths_carry_distances_through_whole_cells(spark):
    """A round ends a cell of nodes: a long chain takes one round a cell and not one for a few nodes. Ways that come back into a cell count too."""
    n = 240
    edges = [(i, i + 1, 5) for i in range(n)] + [(i, i + 30, 20) for i in range(0, n - 30, 7)] + [(3, 200, 1), (50, 50, 4)]
    adj = {}
    for u, v, w in edges:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    want = {}
    for s in range(0, n, 20):
        dist, todo = {s: 0}, [(0, s)]
        while todo:
            d, u = heapq.heappop(todo)
            for v, w in adj[u]:
                if d == dist[u] and d + w < dist.get(v, math.inf):
                    dist[v] = d + w
                    heapq.heappush(todo, (d + w, v))
        want |= {(s, v): (d, min((u for u, w in adj[v] if dist[u] + w == d), default=None)) for v, d in dist.items()}
    e = spark.createDataFrame(edges, "src long, dst long, weight_km long")
    src = spark.createDataFrame([(s,) for s in range(0, n, 20)] + [(999,)], "source long")
    got = {(r.source, r.node_id): (r.dist_km, r.pred) for r in g.shortest_paths(e, src, cell_nodes=40, max_rounds=12).collect()}
    assert got == want | {(999, 999): (0, None)}
    near = {(r.source, r.node_id): r.dist_km for r in g.shortest_paths(e, src, max_km=60, cell_nodes=40).collect()}
    assert near == {k: d for k, (d, _) in got.items() if d <= 60}


def test_segment_distance_in_steps_equals_the_formula(spark):
    """The audit of hazards took most of its time in one formula too long to be compiled; its steps must give the same distances and lose no pair."""
    rnd = random.Random(5)
    rows = [(rnd.uniform(-180, 180), rnd.uniform(-85, -40)) for _ in range(400)]
    rows = [(x, y, x + rnd.uniform(-2, 2), y + rnd.uniform(-1, 1), x + rnd.uniform(-1, 1), y + rnd.uniform(-1, 1)) for x, y in rows]
    rows += [(x, y, x, y, x + d, y) for x, y, *_ in rows[:40] for d in (0.0, 1e-7, 0.1)] + [(x, y, x + 1e-9, y, x + 0.05, y) for x, y, *_ in rows[:40]]
    rows += [(x, y, u, v, x, y) for x, y, u, v, *_ in rows[:40]] + [(0.0, -60.0, 180.0, -60.0, 0.1, -60.0), (10.0, -60.0, 12.0, -60.0, None, -60.0)]
    s = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, tlon double, tlat double").withColumn("i", F.monotonically_increasing_id())
    s = spatial.edge_vectors(s, "_s", "x1", "y1", "x2", "y2").select("*", *geo.point_vec("_t", "tlon", "tlat"))
    four = [geo.vec(p) for p in ("_t", "_sa", "_sb", "_sn")]
    want = {r.i: r.m for r in s.select("i", geo.segment_distance_m(*four).alias("m")).collect()}
    assert {r.i: r.m for r in geo.with_segment_distance(s, "m", *four).collect()} == want
    for most in (0.0, 50.0, 25_000.0, 2e7):
        got = {r.i: r.m for r in geo.with_segment_distance(s, "m", *four, most).collect()}
        assert got == {k: m for k, m in want.items() if m is not None and m <= most}


def _angles(df):
    """How often a plan works out the angle of an arc."""
    return df._jdf.queryExecution().optimizedPlan().toString().upper().count("ACOS(")


def test_densify_works_out_each_great_circle_once(spark):
    rows = [(k, i + 1, x, y) for k in range(4) for i, (x, y) in enumerate(walk(30, seed=k, step=4.0, lon=150.0))] + [(9, 1, 5.0, -60.0), (10, 1, 5.0, -60.0), (10, 2, 5.0, -60.0)]
    p = spark.createDataFrame(rows, "route_id long, seq long, lon double, lat double")
    got = tracks.densify(p, 40.0)
    assert _angles(got) == 1
    ends = spark.createDataFrame([(*a, b[2], b[3]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]], "route_id long, seq long, x1 double, y1 double, x2 double, y2 double")
    ends = ends.withColumn("n", F.greatest(F.lit(1), F.ceil(geo.haversine_km("x1", "y1", "x2", "y2") / 40.0)).cast("int"))
    x = ends.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    lon, lat = geo.slerp("x1", "y1", "x2", "y2", F.col("step") / F.col("n"))
    want = {(r.route_id, r.seq, r.step): (r.lon, r.lat) for r in x.select("route_id", "seq", "step", lon.alias("lon"), lat.alias("lat")).collect()}
    last = {k: (s, x, y) for k, s, x, y in rows}
    want |= {(k, s, 0): (x, y) for k, (s, x, y) in last.items()}
    assert {(r.route_id, r.seq, r.step): (r.lon, r.lat) for r in got.collect()} == want


def test_slerp_query_works_out_each_great_circle_once(spark):
    from seaway.registry.scalars import slerp

    assert _angles(slerp(spark, "/root/testdata/sf0.001")) == 1
