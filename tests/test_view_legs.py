"""Routes, legs and tracks of the views move the table once; very long keys are cut into buckets and give the same rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seaway import views

LINES = [(k, 1 + i % 3, None if i == 5 else 7 * i % 11, None if i == 3 else i % 4, 10.0 * i) for k, n in ((1, 9), (2, 1), (3, 2), (4, 4), (None, 3)) for i in range(n)]
EVENTS = [(u, 100 * (u or 0) + i, None if i == 2 else f"2024-01-0{1 + i % 3} 0{i}:00:00", "a", 1.0) for u, n in ((1, 8), (2, 1), (3, 3), (None, 2)) for i in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("views"))
    spark.createDataFrame(LINES + LINES[:2], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    e = spark.createDataFrame(EVENTS, "user_id bigint, event_id bigint, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("most", [65536, 3])
@pytest.mark.parametrize("name, key", [("v_routes", "route_id"), ("v_legs", "route_id"), ("v_track_points", "track_id")])
def test_views_with_long_keys_equal_their_sql(spark, folder, monkeypatch, name, key, most):
    monkeypatch.setattr(views, "PLAIN_ROWS", most)
    cols = ["route_id", "seq", "lon1", "lat1", "lon2", "lat2"] if name == "v_legs" else [key, "seq", "lon", "lat"]
    got = [tuple(r) for r in views.view(spark, folder, name).select(*cols).collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET default_null_order='nulls_first'")
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rest = " AND ts IS NOT NULL" if name == "v_track_points" else ""
    want = con.execute(views.ctes(f"SELECT {', '.join(cols)} FROM {name} WHERE {key} IS NOT NULL{rest}")).fetchall()
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=order) == sorted(want, key=order) and got


def test_legs_shuffle_the_lines_once(spark, folder):
    plan = views.view(spark, folder, "v_legs")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
