"""Undirected weighted graphs as edge tables ``(src, dst, weight_km)``, each edge stored once.

Loops run until nothing changes; every round ends in a reliable checkpoint, so plans stay short and a
lost executor costs one round. The driver only sees counters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaway.functions import geo
from seaway.operators import spatial as sp
from seaway.session import cut, settle

# nodes of a cell and sources of a group in ``shortest_paths``: a group holds their product in distances
CELL_NODES = 1 << 15
GROUP_SOURCES = 8


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; each row is read once."""
    both = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(both).alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def resolve_edges(nodes: DataFrame, raw: DataFrame, digits: int = 3) -> DataFrame:
    """Edges given by end coordinates (x1, y1, x2, y2, weight_km) as node ids; unmatched edges are dropped."""
    key = lambda x, y: F.struct(geo.js_round(geo.c(x), digits).alias("x"), geo.js_round(geo.c(y), digits).alias("y"))
    n = nodes.groupBy(key("lon", "lat").alias("k")).agg(F.min("node_id").alias("id"))
    e = raw.withColumns({"k1": key("x1", "y1"), "k2": key("x2", "y2")})
    e = e.join(n.select(F.col("k").alias("k1"), F.col("id").alias("src")), "k1").join(n.select(F.col("k").alias("k2"), F.col("id").alias("dst")), "k2")
    return e.select("src", "dst", "weight_km")


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of edge ends per node, parallel edges counted."""
    d = mirrored(edges).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node_id").join(d, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node_id, component_id) with the smallest node id of the component as label.

    Alternating star contraction (Kiveris et al., SoCC 2014): each round hooks every node to the smallest
    label next to it, which needs a logarithmic number of rounds even on long chains. Minima are
    aggregated before the join, so a node with very many edges is not collected anywhere.
    """
    e = edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e, state = cut(e), None
    for _ in range(max_rounds):
        sym = e.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pull = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = cut(pull.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    lab = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select("node_id").join(lab, F.col("node_id") == F.col("u"), "left").select(
        "node_id", F.coalesce("v", "node_id").alias("component_id"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))


def primary_component(components: DataFrame) -> DataFrame:
    """One row: the largest component, ties to the lowest label."""
    return component_sizes(components).agg(F.max_by("component_id", F.struct("n", -F.col("component_id"))).alias("component_id"), F.max("n").alias("n"))


def primary_nodes(components: DataFrame) -> DataFrame:
    """Nodes of the largest component; the join side is one row."""
    return components.join(F.broadcast(primary_component(components).select("component_id")), "component_id", "left_semi").select("node_id")


def prune_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that carry at least one edge; every component of two or more nodes stays."""
    return nodes.join(mirrored(edges).select(F.col("src").alias("node_id")), "node_id", "left_semi")


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of ``gone(node_id)`` and without their edges."""
    e = edges
    for end in ("src", "dst"):
        e = e.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), e


def drop_long_edges_in_box(edges: DataFrame, nodes: DataFrame, box=(-71.5, -55.3, -66.4, -54.7), max_km: float = 20.0) -> DataFrame:
    """Edges over ``max_km`` with an end inside the box are removed."""
    inside = nodes.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).select("node_id")
    long = edges.filter(F.col("weight_km") > max_km)
    for end in ("src", "dst"):
        long = long.join(inside.select(F.col("node_id").alias(end)), end, "left_anti")
    return edges.filter(F.col("weight_km") <= max_km).unionByName(long.select(*edges.columns))


def stitch_antimeridian(nodes: DataFrame, ring_edges: DataFrame, row: Column, east: float = 179.0, west: float = -180.0) -> DataFrame:
    """New edges across +/-180 between nodes on the two border meridians whose ``row`` differs by at most one."""
    e = nodes.filter(F.col("lon") == east).select(F.col("node_id").alias("src"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), row.alias("_r"))
    e = e.select("*", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("_k")).withColumn("_r", F.col("_r") + F.col("_k"))
    w = nodes.filter(F.col("lon") == west).select(F.col("node_id").alias("dst"), (F.col("lon") + 360.0).alias("x2"), F.col("lat").alias("y2"), row.alias("_r"))
    segs = e.join(w, "_r").select(F.struct("src", "dst").alias("sid"), "src", "dst", "x1", "y1", "x2", "y2")
    up = lambda c: F.when(F.col(c) < 0.0, F.col(c) + 360.0).otherwise(F.col(c)).alias(c)
    shifted = ring_edges.filter("x1 < -170 or x2 < -170").select("ring_id", "edge_idx", up("x1"), "y1", up("x2"), "y2")
    land = ring_edges.select(*shifted.columns).unionByName(shifted)
    free = segs.join(sp.planar_crossings(segs, land).select("sid").distinct(), "sid", "left_anti")
    return free.select("src", "dst", F.round(geo.haversine_wrap_km("x1", "y1", F.col("x2") - 360.0, "y2"), 2).alias("weight_km"))


def check_graph(nodes: DataFrame, edges: DataFrame, components: DataFrame, expected: int | None = None) -> DataFrame:
    """Integrity counters as rows (issue, n): duplicate coordinates, bad weights, dangling edges, component count."""
    dup = nodes.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    w = F.col("weight_km").cast("double")
    bad = edges.agg(F.count_if(w.isNull() | F.isnan(w) | (w <= 0.0) | (w == float("inf"))).alias("n"))
    ids = nodes.select("node_id")
    known = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    loose = edges.select(F.lit(1).alias("k")).unionByName(known.select(F.lit(-1).alias("k"))).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    comps = components.select("component_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    if expected is not None:
        comps = comps.select(F.abs(F.col("n") - expected).alias("n"))
    out = None
    for name, df in (("duplicate_coordinates", dup), ("bad_weights", bad), ("dangling_edges", loose), ("components", comps)):
        row = df.select(F.lit(name).alias("issue"), F.col("n").cast("bigint").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def reachable(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Whether both ends ``a, b`` of each pair lie in one component. No search."""
    c = lambda end: components.select(F.col("node_id").alias(end), F.col("component_id").alias("_c" + end))
    x = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left")
    return x.withColumn("reachable", F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).drop("_ca", "_cb")


def _marks(rows: pd.DataFrame, max_km: float | None) -> tuple[np.ndarray, ...]:
    """Distances inside one cell: (node ids, sources, distances before, after, ends and lengths of the edges, ordered by their end).

    Edges are rows of kind 0 (a, b, km), known distances rows of kind 1 (source a, node b, km), of which fresh ones are carried on.
    """
    e, known = rows[rows.kind == 0], rows[rows.kind == 1]
    ids = np.unique(np.concatenate([e.a, e.b, known.b]).astype(np.int64))
    sources = np.unique(known.a.to_numpy(np.int64))
    u, v, w = np.searchsorted(ids, e.a.to_numpy(np.int64)), np.searchsorted(ids, e.b.to_numpy(np.int64)), e.km.to_numpy(float)
    order = np.argsort(v, kind="stable")
    u, v, w = u[order], v[order], w[order]
    d = np.full((len(ids), len(sources)), np.inf)
    at = np.searchsorted(ids, known.b.to_numpy(np.int64))
    np.minimum.at(d, (at, np.searchsorted(sources, known.a.to_numpy(np.int64))), known.km.to_numpy(float))
    before, moved = d.copy(), np.zeros(len(ids), bool)
    moved[at[known.flag.to_numpy(bool)]] = True
    while moved.any():
        on = moved[u]
        if not on.any():
            break
        ends = v[on]
        first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        new = np.minimum.reduceat(d[u[on]] + w[on, None], first, axis=0)
        if max_km is not None:
            new[new > max_km] = np.inf
        to = ends[first]
        less = (new < d[to]).any(axis=1)
        d[to] = np.minimum(d[to], new)
        moved = np.zeros(len(ids), bool)
        moved[to[less]] = True
    return ids, sources, before, d, u, v, w


def _cell_of_ids(both: DataFrame, cell_nodes: int) -> DataFrame:
    """(node_id, cell): ranges of about ``cell_nodes`` neighbouring ids."""
    nodes = settle(both.select(F.col("src").alias("node_id")).distinct())
    ranges = max(1, -(-nodes.count() // cell_nodes))
    return settle(nodes.repartitionByRange(ranges, "node_id").select("node_id", F.spark_partition_id().alias("cell")))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_km: float | None = None, cell_nodes: int = CELL_NODES, max_rounds: int = 10_000, targets: DataFrame | None = None) -> DataFrame:
    """Exact distances from many sources at once: (source, node_id, dist_km, pred).

    The graph is cut into cells of neighbouring ids. A round carries the improved distances through all of their cell, for a few
    sources a group, and over the edges that leave it, and keeps only improvements at the ends of such edges; it ends when there is none, so rounds grow
    with the cells on a way and not with its nodes. All other nodes are filled in once, at the end. ``pred`` is the lowest neighbour id on a shortest path. With
    ``targets(source, node_id)`` a source stops growing past its farthest target once all of them are reached, and nodes beyond
    that distance are left out.
    """
    both = settle(mirrored(edges).filter("src is not null and dst is not null and weight_km is not null").groupBy("src", "dst").agg(F.min("weight_km").alias("weight_km")))
    km = both.schema["weight_km"].dataType
    cells = _cell_of_ids(both, cell_nodes)
    side = lambda end: cells.select(F.col("node_id").alias(end), F.col("cell").alias(f"_{end}"))
    e = settle(both.select("src", "dst", F.col("weight_km").cast("double").alias("weight_km")).join(side("src"), "src").join(side("dst"), "dst"))
    cross = e.filter("_src != _dst")
    wanted = None if targets is None else settle(targets.select("source", "node_id").distinct())
    kept = cross.select(F.col("dst").alias("b"))
    kept = (kept if wanted is None else kept.unionByName(wanted.select(F.col("node_id").alias("b")))).distinct().withColumn("flag", F.lit(True))
    inner = e.filter("_src = _dst").select(F.col("_src").alias("cell"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight_km").alias("km"))
    inner = settle(inner.join(kept, "b", "left").select("cell", F.lit(0).alias("kind"), "a", "b", "km", F.coalesce("flag", F.lit(False)).alias("flag")))

    starts = settle(sources.select("source").distinct())
    groups = max(1, -(-starts.count() // GROUP_SOURCES))
    state = starts.join(cells, F.col("source") == F.col("node_id")).select(
        "cell", F.pmod(F.xxhash64("source"), F.lit(groups)).alias("part"), "source", "node_id", F.lit(0.0).alias("dist_km"), F.lit(True).alias("fresh"))
    state = settle(state)
    here, place = ["cell", "part"], ["cell", "part", "source", "node_id"]

    def in_cells(state: DataFrame, own: DataFrame) -> DataFrame:
        """The edges and known distances of the groups of ``own(cell, part)``."""
        known = state.join(own, here, "left_semi").select(*here, F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("node_id").alias("b"), F.col("dist_km").alias("km"), F.col("fresh").alias("flag"))
        return inner.join(own, "cell").select(*known.columns).unionByName(known).groupBy(*here)

    def improved(rows: pd.DataFrame) -> pd.DataFrame:
        ids, srcs, before, d, *_ = _marks(rows, max_km)
        mark = np.isin(ids, rows.b[(rows.kind == 0) & rows.flag].to_numpy(np.int64))
        i, j = np.nonzero((d < before) & mark[:, None])
        return pd.DataFrame({"cell": rows.cell.iloc[0], "part": rows.part.iloc[0], "source": srcs[j], "node_id": ids[i], "dist_km": d[i, j]})

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        via = rows[rows.kind == 2]
        ids, srcs, _, d, u, v, w = _marks(rows[rows.kind != 2].assign(flag=True), max_km)
        none = np.iinfo(np.int64).max
        pred = np.full(d.shape, none)
        if len(v):
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            on = np.isfinite(d[u]) & (d[u] + w[:, None] == d[v])
            pred[v[first]] = np.minimum.reduceat(np.where(on, ids[u][:, None], none), first, axis=0)
        # a neighbour in another cell; its row carries the node it leads to in place of a known one
        i, j = np.searchsorted(ids, via.b.to_numpy(np.int64)), np.searchsorted(srcs, via.a.to_numpy(np.int64))
        on = d[i, j] == via.km.to_numpy(float)
        np.minimum.at(pred, (i[on], j[on]), via.via.to_numpy()[on].astype(np.int64))
        i, j = np.nonzero(np.isfinite(d))
        p = pd.array(pred[i, j], dtype="Int64")
        p[pred[i, j] == none] = pd.NA
        return pd.DataFrame({"source": srcs[j], "node_id": ids[i], "dist_km": d[i, j], "pred": p})

    over = lambda x: x.join(cross.select(F.col("src").alias("node_id"), "dst", "weight_km", "_dst"), "node_id").select(
        F.col("_dst").alias("cell"), "part", "source", F.col("dst").alias("node_id"), (F.col("dist_km") + F.col("weight_km")).alias("dist_km"), F.col("node_id").alias("via"))
    for _ in range(max_rounds):
        inside = in_cells(state, state.filter("fresh").select(*here).distinct()).applyInPandas(improved, "cell int, part bigint, source bigint, node_id bigint, dist_km double")
        inside = settle(inside)
        across = over(state.filter("fresh").select(*place, "dist_km").unionByName(inside)).drop("via")
        if max_km is not None:
            across = across.filter(F.col("dist_km") <= max_km)
        old = state.select(*place, "dist_km").unionByName(inside).withColumn("_new", F.lit(False)).unionByName(across.withColumn("_new", F.lit(True)))
        old = old.groupBy(*place).agg(F.min("dist_km").alias("dist_km"), F.min(F.when(~F.col("_new"), F.col("dist_km"))).alias("_old"))
        state = old.select(*place, "dist_km", (F.col("_old").isNull() | (F.col("dist_km") < F.col("_old"))).alias("fresh"))
        if wanted is not None:
            state = settle(state)
            state = state.join(_limits(state, wanted), "source", "left").withColumn("fresh", F.col("fresh") & (F.col("_limit").isNull() | (F.col("dist_km") < F.col("_limit")))).drop("_limit")
        state = settle(state)
        if state.filter("fresh").isEmpty():
            break
    else:
        raise RuntimeError("distances did not settle")
    lead = over(state).groupBy(*place).agg(F.min(F.struct("dist_km", "via")).alias("v"))
    lead = lead.join(state.select(*place), place, "left_semi").select(*here, F.lit(2).alias("kind"), F.col("source").alias("a"), F.col("node_id").alias("b"), F.col("v.dist_km").alias("km"), F.lit(True).alias("flag"), F.col("v.via").alias("via"))
    known = state.select(*here, F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("node_id").alias("b"), F.col("dist_km").alias("km"), F.lit(True).alias("flag"), F.lit(None).cast("bigint").alias("via"))
    rows = inner.join(state.select(*here).distinct(), "cell").withColumn("via", F.lit(None).cast("bigint")).select(*known.columns).unionByName(known).unionByName(lead)
    best = rows.groupBy(*here).applyInPandas(filled, "source bigint, node_id bigint, dist_km double, pred bigint")
    if wanted is not None:
        best = best.join(settle(_limits(state, wanted)), "source", "left").filter(F.col("_limit").isNull() | (F.col("dist_km") <= F.col("_limit"))).drop("_limit")
    lone = starts.join(cells, F.col("source") == F.col("node_id"), "left_anti").select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("dist_km"), F.lit(None).cast("bigint").alias("pred"))
    return best.unionByName(lone).withColumn("dist_km", F.col("dist_km").cast(km))


def _limits(best: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distance of the farthest target of each source whose targets are all reached."""
    x = wanted.join(best, ["source", "node_id"], "left").groupBy("source").agg(F.max("dist_km").alias("_limit"), F.bool_or(F.col("dist_km").isNull()).alias("_open"))
    return x.filter("not _open").select("source", "_limit")


def path_points(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordered nodes of the shortest path of each pair ``(source, target)``: (source, target, hop, node_id).

    Predecessor pointers are doubled, so a path of n nodes takes log2(n) joins instead of n.
    """
    jump = settle(paths.filter("pred is not null").select("source", "node_id", F.col("pred").alias("up"), F.lit(1).cast("bigint").alias("steps")))
    levels = [jump]
    while True:
        nxt = jump.select("source", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"))
        jump = settle(jump.join(nxt, ["source", "up"]).select("source", "node_id", F.col("up2").alias("up"), (F.col("steps") + F.col("s2")).alias("steps")))
        if jump.isEmpty():
            break
        levels.append(jump)
    known = paths.select("source", F.col("node_id").alias("target"))
    walk = pairs.select("source", "target").distinct().join(known, ["source", "target"], "left_semi")
    walk = walk.select("source", "target", F.col("target").alias("node_id"), F.lit(0).cast("bigint").alias("back"))
    for lv in reversed(levels):
        hop = walk.join(lv, ["source", "node_id"]).select("source", "target", F.col("up").alias("node_id"), (F.col("back") + F.col("steps")).alias("back"))
        # written at every level: each would double the plan else, and with it the memory of the driver
        walk = settle(walk.unionByName(hop))
    total = walk.groupBy("source", "target").agg(F.max("back").alias("_n"))
    return walk.join(total, ["source", "target"]).select("source", "target", (F.col("_n") - F.col("back")).alias("hop"), "node_id")


def restrict_edges(edges: DataFrame, blocked: Sequence[str]) -> DataFrame:
    """Lane edges without those whose ``tag`` names a blocked passage."""
    return edges.filter(~F.coalesce(F.col("tag").isin(*blocked), F.lit(False))) if blocked else edges
