"""Nearest neighbours by inner product with vantage-point trees per shard (operator 7).

Vectors are lengthened by one component so that the nearest in distance is the largest inner product. They are dealt to cells
around sampled pivots and each cell to shards of bounded size; a shard is one row with a vantage-point tree over its distinct
vectors. A query first searches the shards of its nearest cells, which gives it a radius, and then every shard whose cell can
come within that radius. In the trees as among the cells a part is left out by the triangle inequality with the radius
divided by ``relax``: 1 is exact, larger values prune more. Scores decide which points stay, and among equal scores the
smaller id, however many are equal: a list of ``k + 1`` entries, ordered so, is all that ``k`` neighbours can need.

Records: gateways and graph nodes of the engine as positions on the sphere are such vectors (``node_id``, ``position``), where
the largest inner product is the shortest great circle; any table of an id and an array of numbers fits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seaway.session import cut

SHARD = 4096  # distinct vectors of a shard, about
CELLS = 1024  # cells at most; larger cells have more shards
LEAF = 128
MARGIN = 1e-7  # distances come from matrix products: what is within this much of a radius is looked at, and exact scores decide
QUERIES = 256  # queries that search a shard together


class VantageTree:
    """Ball tree over points by the distance to vantage points: node i parts its points at the median distance to its own point."""

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (vantage point, its inner radii, outer radii, inner child, outer child) or (None, rows)
        self._build(order)

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[at] = (None, rows)
            return at
        centre = self.points[rows].mean(axis=0)
        vantage = rows[int(((self.points[rows] - centre) ** 2).sum(axis=1).argmax())]  # far out, so that distances spread
        d = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(axis=1))
        half = len(rows) // 2
        order = np.argpartition(d, half)
        inner, outer = order[:half], order[half:]
        self.nodes[at] = (vantage, d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max(), self._build(rows[inner]), self._build(rows[outer]))
        return at

    def search(self, queries: np.ndarray, k: int, radius: np.ndarray, relax: float, score: Callable[[np.ndarray, np.ndarray], np.ndarray], tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances, scores, rows) of the ``k`` best points within ``radius`` of each query, best first; -1 fills up.

        Distances find and prune; ``score(rows, queries)``, given two lists of positions, orders what was found, and among equal scores ``tie`` does.
        """
        dist = np.full((len(queries), k), np.inf)
        high = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1)
        bound = radius.astype(np.float64).copy()

        def keep(who: np.ndarray, d: np.ndarray, found: np.ndarray) -> None:
            """Merge the points ``found`` at distances ``d`` into the lists of the queries ``who``."""
            i, j = np.nonzero(d <= bound[who, None] * (1 + 1e-9) + MARGIN)
            if not len(i):
                return
            hit = np.unique(i)
            own, slot = np.nonzero(rows[who[hit]] >= 0)
            old = who[hit][own]
            at = np.concatenate([hit[own], i])
            r = np.concatenate([rows[old, slot], found[j]])
            sc = np.concatenate([high[old, slot], score(found[j], who[i])])
            ds = np.concatenate([dist[old, slot], d[i, j]])
            order = np.lexsort((tie[r], -sc, at))
            at, r, sc, ds = at[order], r[order], sc[order], ds[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            top = rank < k
            q, n = who[at[top]], rank[top]
            rows[q, n], high[q, n], dist[q, n] = r[top], sc[top], ds[top]
            bound[who] = np.minimum(bound[who], dist[who].max(axis=1))

        def visit(node: int, who: np.ndarray) -> None:
            part = self.nodes[node]
            if part[0] is None:
                keep(who, _distances(queries[who], self.points[part[1]]), part[1])
                return
            vantage, lo_in, hi_in, lo_out, hi_out, inner, outer = part
            d = np.sqrt(np.maximum(((queries[who] - self.points[vantage]) ** 2).sum(axis=1), 0))
            gap_in = np.maximum(np.maximum(d - hi_in, lo_in - d), 0)
            gap_out = np.maximum(np.maximum(d - hi_out, lo_out - d), 0)
            first_in = gap_in <= gap_out
            for near, far, gap_n, gap_f, some in ((inner, outer, gap_in, gap_out, first_in), (outer, inner, gap_out, gap_in, ~first_in)):
                for child, gap in ((near, gap_n), (far, gap_f)):
                    go = who[some & (gap * relax <= bound[who] * (1 + 1e-9) + MARGIN)]
                    if len(go):
                        visit(child, go)

        if len(queries):
            visit(0, np.arange(len(queries)))
        return dist, high, rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def valid_vectors(nodes: DataFrame, node_id: str, position: str) -> DataFrame:
    """(id, v) of the vectors that take part: an id, no null, zero or non-finite vector, and of the most common length."""
    v = F.col(position).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    x = nodes.select(F.col(node_id).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    size = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.filter(F.size("v") == (size[0] if size else 0))


def build_index(vectors: DataFrame, k: int, sample: int = 20_000) -> tuple[DataFrame, dict]:
    """The index table (cell, shard, tree, ids) and its frame (largest norm, pivots, radii, shards per cell).

    ``vectors(id, v)`` as ``valid_vectors`` gives them. Equal vectors are one entry with their ``k + 1`` smallest ids, which is all
    that ``k`` neighbours can need. Pivots come from at most ``sample`` vectors chosen by a hash (the documented bound);
    every vector is indexed.
    """
    kept = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1)
    groups = cut(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    head = groups.agg(F.max(square).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not head["n"]:
        return groups.sparkSession.createDataFrame([], "cell int, shard int, tree binary, ids array<array<long>>"), {}
    top, n = float(head["m"]), int(head["n"])
    number = max(1, min(CELLS, -(-n // SHARD)))
    some = groups.orderBy(F.xxhash64("v")).limit(min(sample, 16 * number)).toPandas()
    pivots = _spread(lengthened(_matrix(some["v"]), top), number)

    def celled(batches):
        for pdf in batches:
            x = lengthened(_matrix(pdf["v"]), top) if len(pdf) else np.zeros((0, pivots.shape[1]))
            d = _distances(x, pivots)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "far": d[np.arange(len(d)), cell], "v": pdf["v"], "ids": pdf["ids"]})

    kind = vectors.schema["id"].dataType.simpleString()
    dealt = cut(groups.mapInPandas(celled, f"cell int, far double, v array<double>, ids array<{kind}>"))
    stats = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()  # one row per cell
    shards = np.zeros(len(pivots), np.int64)
    shards[stats["cell"]] = -(-stats["n"] // SHARD)
    radii = np.zeros(len(pivots))
    radii[stats["cell"]] = stats["radius"]
    parts = F.element_at(F.array(*[F.lit(int(s)) for s in shards]), F.col("cell") + 1)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("v"), F.greatest(parts, F.lit(1))).cast("int"))

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"])
        tree = VantageTree(lengthened(x, top))
        data = pickle.dumps((x.astype(np.float32) if (x.astype(np.float32) == x).all() else x, tree.nodes))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [data], "ids": [[list(e) for e in pdf["ids"]]]})

    index = cut(dealt.groupBy("cell", "shard").applyInPandas(grown, f"cell int, shard int, tree binary, ids array<array<{kind}>>"))
    return index, {"top": top, "pivots": pivots, "radii": radii, "shards": shards}


def lengthened(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives all of them the same norm."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def aimed(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with 0 added: distances to lengthened vectors fall as inner products rise, whatever the norm."""
    return np.concatenate([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _products(x: np.ndarray, q: np.ndarray, rows: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``x`` and of ``q``, added up in component order."""
    total = np.zeros(len(rows))
    for j in range(x.shape[1]):
        total += x[rows, j] * q[who, j]
    return total


def _spread(x: np.ndarray, number: int) -> np.ndarray:
    """Pivots: some rounds of k-means from the first rows."""
    c = x[:number].copy()
    for _ in range(8):
        own = _distances(x, c).argmin(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def nearest(nodes: DataFrame, queries: DataFrame, k: int = 20, relax: float = 1.0, node_id: str = "node_id", position: str = "position", first_cells: int = 2) -> DataFrame:
    """(query_id, rank, node_id, score) of each query's ``k`` nearest found, nearest first, ties to the smaller id.

    ``nodes(node_id, position)`` are all candidates but the query's own id; ``queries`` has the same columns. Nearness is the inner
    product in double precision, added up in component order; ``score`` is that of the original vectors. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of another than the
    most common length; with fewer than ``k`` candidates all are returned. Equal queries are searched once.

    A cell's shards are visited if its pivot's distance less its radius, times ``relax``, is within the k-th distance found so far.
    """
    vectors = valid_vectors(nodes, node_id, position)
    index, frame = build_index(vectors, k)
    kind = nodes.schema[node_id].dataType.simpleString()
    out = f"query_id {kind}, rank int, {node_id} {kind}, score double"
    if not frame:
        return nodes.sparkSession.createDataFrame([], out)
    asked = valid_vectors(queries, node_id, position)
    asked = asked.filter(F.size("v") == frame["pivots"].shape[1] - 1)
    asks = cut(asked.groupBy("v").agg(F.min("id").alias("q")))
    salts = max(1, -(-asks.count() // 65_536))  # so many queries of a shard, about, are numbered in one task
    pivots, radii, shards = frame["pivots"], frame["radii"], frame["shards"]
    full = np.flatnonzero(shards > 0)

    def plan(first: bool):
        def made(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                d = _distances(aimed(_matrix(pdf["v"])), pivots)[:, full]
                near = np.argsort(d, axis=1, kind="stable")[:, :first_cells]
                home = np.zeros(d.shape, bool)
                np.put_along_axis(home, near, True, 1)
                go = home if first else ~home & ((d - radii[full]) * relax <= pdf["bound"].to_numpy()[:, None] * (1 + 1e-9) + MARGIN)
                rows, cells = np.nonzero(go)
                cells = full[cells]
                each = shards[cells]
                rows, cells = np.repeat(rows, each), np.repeat(cells, each)
                number = np.concatenate([np.arange(e) for e in each]) if len(each) else np.zeros(0, int)
                bound = np.full(len(pdf), np.inf) if first else pdf["bound"].to_numpy()
                yield pd.DataFrame({"cell": cells.astype(np.int32), "shard": number.astype(np.int32), "q": pdf["q"].to_numpy()[rows], "v": pd.Series([pdf["v"].iloc[i] for i in rows], dtype=object), "bound": bound[rows]})

        return made

    visit = f"cell int, shard int, q {kind}, v array<double>, bound double"

    def searched(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, ids, qs in zip(pdf["tree"], pdf["ids"], pdf["qs"], strict=True):
                x, shape = pickle.loads(tree)
                x = x.astype(np.float64)
                t = VantageTree.__new__(VantageTree)
                t.points, t.nodes = lengthened(x, frame["top"]), shape
                q = np.array([np.asarray(e["v"], np.float64) for e in qs])
                tie = np.empty(len(ids), np.int64)
                tie[sorted(range(len(ids)), key=lambda i: ids[i][0])] = np.arange(len(ids))  # noqa: B023
                dist, high, rows = t.search(aimed(q), k + 1, np.array([e["bound"] for e in qs]), relax, partial(_products, x, q), tie)
                a, b = np.nonzero(rows >= 0)
                yield pd.DataFrame({"q": [qs[i]["q"] for i in a], "dist": dist[a, b], "score": high[a, b], "ids": pd.Series([ids[i] for i in rows[a, b]], dtype=object)})

    def search(visits: DataFrame) -> DataFrame:
        """Queries of a shard in groups of bounded size, each group with the shard's tree."""
        block = F.floor((F.row_number().over(Window.partitionBy("cell", "shard", "_salt").orderBy("q")) - 1) / QUERIES)
        x = visits.withColumn("_salt", F.pmod(F.xxhash64("q"), F.lit(salts))).withColumn("_b", block)
        x = x.groupBy("cell", "shard", "_salt", "_b").agg(F.collect_list(F.struct("q", "v", "bound")).alias("qs"))
        return x.join(index, ["cell", "shard"]).select("tree", "ids", "qs").mapInPandas(searched, f"q {kind}, dist double, score double, ids array<{kind}>")

    def best(found: DataFrame) -> DataFrame:
        """The ``k + 1`` best entries of each query by score and least id; one of them may hold only the query itself."""
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
        return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).drop("_r")

    one = cut(best(search(asks.mapInPandas(plan(True), visit))))
    reach = one.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("dist"))).filter(F.col("_r") == k + 1).select("q", F.col("dist").alias("bound"))
    again = asks.join(reach, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    two = best(one.unionByName(search(again.select("q", "v", "bound").mapInPandas(plan(False), visit))))
    # every id of an entry is a candidate; queries with equal vectors share what was found
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ids = two.select("q", "score", F.explode("ids").alias("id")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
    hits = asked.join(asks.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q").join(ids.drop("_r"), "q").filter("id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    x = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return x.select("query_id", "rank", F.col("id").alias(node_id), "score")
