"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from seaway.sources import readers, writers


def test_ports_with_bom(spark, tmp_path):
    head = list(readers.PORT_COLUMNS)
    row = {h: "" for h in head} | {"World Port Index Number": "10.0", "Main Port Name": "A", "Latitude": "-60.123456", "Longitude": "1", "Harbor Size": "Unknown", "Maximum Vessel Draft (m)": "0.0"}
    f = tmp_path / "ports.csv"
    f.write_text("﻿" + ",".join(head) + "\n" + ",".join(row[h] for h in head) + "\n" + ",".join("" for _ in head[:-1]) + ",x\n", encoding="utf-8")
    ok, bad = readers.read_ports(spark, str(f))
    r = ok.first()
    assert (r.wpiNumber, r.latitude, r.harborSize, r.maxVesselDraft) == (10, -60.12346, None, None)
    assert bad.count() == 1


def test_last_row_wins(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text("Iceberg,Latitude\nA1 ,-60\n,-1\nA1,-61\nB2,-62\n")
    assert {r.id: r.Latitude for r in readers.read_iceberg_snapshot(spark, str(f)).collect()} == {"A1": "-61", "B2": "-62"}


def test_tracks_with_own_headers(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("date,ascat_1,ascat_2,qscat_1,qscat_2\n2020001,0,0,-60,10\n2020002,-61,11,0,0\n2020003,1\n2020004,0,0,0,0\n")
    (tmp_path / "b2.csv").write_text("NIC_1,NIC_2,Date\n-65,20,2019400\n")
    ok, bad = readers.read_drift_tracks(spark, str(tmp_path / "*.csv"))
    assert sorted((r.track_id, r.date, r.lat, r.sensor) for r in ok.collect()) == [("A1", "2020-01-01", -60.0, "QSCAT"), ("A1", "2020-01-02", -61.0, "ASCAT"), ("B2", "2020-02-04", -65.0, "NIC")]
    assert sorted(r.reason for r in bad.collect()) == ["column count", "no usable fix"]
    fx = readers.read_fixes_positional(spark, str(tmp_path / "b2.csv")).collect()
    assert [(r.lat, r.lon, r.date) for r in fx] == [(-65.0, 20.0, "2020-02-04")]


def test_line_geometry_rules(spark):
    t = [(1, "LineString", [[0, 0], [1, 1]]), (2, "LineString", [[0, 0]]), (3, "MultiLineString", [[[0, 0], [1, 1]], [[1, 1], [2, 2]]]), (4, "MultiLineString", [[[0, 0]], [[9, 9]]]),
         (5, "MultiLineString", [[[170, 0], [180, 1]], [[-180, 1.5], [-175, 2]]]), (6, "LineString", [[0, 0], [200, 1]]), (7, "Point", [0, 0])]
    d = spark.createDataFrame([(i, k, json.dumps(c)) for i, k, c in t], "geom_id long, type string, coordinates string")
    n = {}
    for r in readers.flatten_line_geometry(d).orderBy("geom_id", "seq").collect():
        n.setdefault(r.geom_id, []).append(r.seq)
    assert n == {1: [1, 2], 3: [1, 2, 3], 5: [1, 2, 3, 4]}


def test_polygons_and_gateways(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    f = tmp_path / "p.json"
    f.write_text("\n".join(json.dumps({"type": "Feature", "properties": {}, "geometry": gm}) for gm in
                           ({"type": "Polygon", "coordinates": [ring, ring]}, None, {"type": "MultiPolygon", "coordinates": [[ring]]})))
    p = readers.read_polygons(spark, str(f))
    assert p.select("ring_id").distinct().count() == 3 and p.count() == 12
    q = tmp_path / "g.json"
    q.write_text(json.dumps({"validatedGateways": [{"gatewayId": "G", "polarNodeId": 3, "polarCoords": [1.0, -50.0], "globalCoords": [2.0, -49.0], "transitionDistanceKm": 4.0}]}))
    assert readers.read_gateways(spark, str(q)).first().global_lat == -49.0


def test_features_keep_nulls(spark):
    d = spark.createDataFrame([(1, None, 2.0, 3.0)], "id long, name string, lon double, lat double")
    g = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    f = json.loads(writers.features(d, ["id", "name"], g).first().value)
    assert f["properties"] == {"id": 1, "name": None} and f["geometry"]["coordinates"] == [2.0, 3.0]


def test_lineage_counts_and_hash(spark, tmp_path):
    f = tmp_path / "x.bin"
    f.write_bytes(b"abc")
    d = spark.range(3)
    r = writers.lineage(d, d.filter("id > 0"), d.filter("id = 0"), writers.file_facts(spark, str(f))).first()
    assert (r.raw_record_count, r.processed_record_count, r.rejected_record_count, r.file_size_bytes) == (3, 2, 1, 3)
    assert r.files[0].sha256.startswith("ba7816bf")


def test_passage_plans_as_lines_and_texts(spark):
    w = spark.createDataFrame([(1, 1, "WP1", 59.123456, -3.0, 0.0, 0.0, 0.0, "-", 0.0, 0.0, "OCEAN"), (1, 2, "WP2", 60.0, -4.0, 330.04, 60.44, 12.0, "PORT", 60.44, 111.9, "ICE"), (2, 1, "WP1", 1.0, 2.0, 0.0, 0.0, 0.0, "-", 0.0, 0.0, "OCEAN")],
                              "route_id long, wp_index long, name string, lat double, lon double, bearing double, leg_nm double, turn double, side string, cum_nm double, cum_km double, zone string")
    ends = spark.createDataFrame([(1, "Kirkwall", 30600, None, None), (1, "Kirkwall", 30600, None, None)], "route_id long, departure string, departure_id long, destination string, destination_id long")
    lines = writers.passage_plan(w, ends=ends, generated=F.lit("2024-02-01 10:00:00").cast("timestamp"))
    got = {r.route_id: r.plan_text.split("\n") for r in writers.plan_texts(lines).collect()}
    assert got[1][:4] == ["# ECDIS PASSAGE PLAN VOYAGE EXPORT", "# Departure: Kirkwall (WPI 30600)", "# Destination: N/A (WPI N/A)", "# Total Distance: 60 NM (112 km)"]
    assert got[1][4].startswith("# Generated: 2024-") and got[1][4].endswith(":00:00.000Z")
    assert got[1][6:] == ["WP1,59.12346,-3.00000,0.0,0.0,0.0,-,0.0,OCEAN", "WP2,60.00000,-4.00000,330.0,60.4,12.0,PORT,60.4,ICE"]
    assert got[2][1] == "# Departure: N/A (WPI N/A)" and len(got[2]) == 7
    assert writers.passage_plan(w.limit(0)).count() == 0 and writers.plan_texts(lines.limit(0)).count() == 0
