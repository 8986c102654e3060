"""Paths: the plan does not double with every level; steps of legs move without their vectors."""

from seaway.operators import graph, spatial


def test_paths_of_a_long_chain_are_written_level_by_level(spark, monkeypatch):
    n = 70
    paths = spark.createDataFrame([(0, i, float(i), i - 1 if i else None) for i in range(n)], "source long, node_id long, dist_km double, pred long")
    pairs = spark.createDataFrame([(0, n - 1), (0, 5), (0, 0), (0, 500)], "source long, target long")
    longest, settle = [0], graph.settle

    def watched(df):
        longest[0] = max(longest[0], df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return settle(df)

    monkeypatch.setattr(graph, "settle", watched)
    rows = graph.path_points(paths, pairs).collect()
    assert sorted((r.target, r.hop, r.node_id) for r in rows) == sorted([(t, i, i) for t in (n - 1, 5, 0) for i in range(t + 1)])
    assert longest[0] < 40  # 7 levels, doubled at each, were several hundred lines


def test_steps_move_without_vectors(spark):
    rows = [(1, 0.0, -60.0, 0.1, -60.05)]
    s = spark.createDataFrame(rows, "sid long, x1 double, y1 double, x2 double, y2 double")
    e = spark.createDataFrame([(1, 0, 0.05, -61.0, 0.06, -59.0)], "ring_id long, edge_idx long, x1 double, y1 double, x2 double, y2 double")
    j = spatial.steps_crossed(s, e, 0.6)
    assert j.count() == 1
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner"):]
    kept = [line for line in below.splitlines() if "Project" in line][0]
    assert "_sax" not in kept and "_snz" not in kept
