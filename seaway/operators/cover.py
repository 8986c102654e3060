"""Cell cover of closed rings: cells inside a ring answer without its edges, border cells with the few edges in them.

Each ring is covered by square cells of one of a few sizes (powers of four of a degree), chosen so that a ring has about as many border
cells as edges. A border cell knows for one of its corners whether it lies inside; a point of the cell goes from that corner upwards and
then sideways and counts what it crosses, which only edges of the cell can do. The grid is shifted by ``OFF``, so that no
rounded position lies on a cell border.
"""

from __future__ import annotations

import math
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seaway.functions import geo
from seaway.functions.geo import c, remembered
from seaway.session import cut, settle

OFF = math.pi * 1e-3
LEVELS = (-5, 3)  # cell sizes from 4^-5 (0.001) to 4^3 (64) degrees
EPS = 1e-9

# rows of masks (64 cells each) that are broadcast; more are joined by shuffle
MASK_ROWS = 500_000

_COVERS: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()
_MASKS: WeakKeyDictionary[DataFrame, tuple[DataFrame, list[int], int]] = WeakKeyDictionary()


@remembered
def _size(level) -> Column:
    return F.pow(F.lit(4.0), c(level))


def _at(x, size) -> Column:
    return F.floor((c(x) - OFF) / c(size))


def ring_levels(edges: DataFrame, finer: int = 0) -> DataFrame:
    """(ring_id, level): the cell size of each ring, from its box and its number of edges, ``finer`` powers of four below that."""
    box = edges.groupBy("ring_id").agg(
        (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"), (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"),
        F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.sqrt(F.col("w") * F.col("h") / F.col("n")), F.greatest("w", "h") / F.col("n"), F.lit(1e-9))
    return box.select("ring_id", geo.clamp(F.round(F.log(size) / math.log(4.0)) - finer, *LEVELS).cast("int").alias("level"))


def edge_cells(edges: DataFrame, finer: int = 0) -> DataFrame:
    """Edges in every cell that they touch: row by row, so that a long slanted edge has cells along itself and not in its whole box."""
    e = edges.join(ring_levels(edges, finer), "ring_id").select("ring_id", "x1", "y1", "x2", "y2", "level", _size("level").alias("_s"))
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.select("*", F.explode(F.sequence(_at(lo - EPS, "_s"), _at(hi + EPS, "_s"))).alias("_cy"))
    y0 = F.col("_cy") * F.col("_s") + OFF
    dy, dx = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    on = lambda y: F.col("x1") + (F.least(F.greatest(y, lo), hi) - F.col("y1")) / F.when(dy == 0, 1.0).otherwise(dy) * dx
    e = geo.let(e, _a=F.when(dy == 0, F.col("x1")).otherwise(on(y0)), _b=F.when(dy == 0, F.col("x2")).otherwise(on(y0 + F.col("_s"))))
    slack = EPS + F.when(dy == 0, 0.0).otherwise(F.least(F.abs(dx), F.abs(dx / F.when(dy == 0, 1.0).otherwise(dy)) * 1e-13))
    cols = F.sequence(_at(F.least("_a", "_b") - slack, "_s"), _at(F.greatest("_a", "_b") + slack, "_s"))
    return e.select("ring_id", "level", "_cy", F.explode(cols).alias("_cx"), "x1", "y1", "x2", "y2")


def ring_cover(edges: DataFrame, finer: int = 0) -> DataFrame:
    """Cells of closed rings ``edges(ring_id, x1, y1, x2, y2)``: (ring_id, level, _cx, _cy, odd, x1, y1, x2, y2).

    A border cell has one row per edge that touches it, with ``odd`` telling whether its lower right corner lies inside; a cell wholly inside
    has one row without an edge. Rings may have several parts under one id. Edges with a null are left out. A ring that is not
    closed has no inside; give closed ones. Rows of a grid are numbered in windows per ring and row, which hold about the root of the ring's cells.
    """
    e = edges.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    ec = edge_cells(e, finer)
    s = _size("level")
    y0 = F.col("_cy") * s + OFF
    spans = (F.col("y1") > y0) != (F.col("y2") > y0)
    x0 = (y0 - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y1") == F.col("y2"), 1.0).otherwise(F.col("y2") - F.col("y1")) + F.col("x1")
    # the lower border of a cell row is crossed in one cell by each edge that spans it
    cells = ec.groupBy("ring_id", "level", "_cx", "_cy").agg(F.count_if(spans & (_at(x0, s) == F.col("_cx"))).alias("_n"))
    row = Window.partitionBy("ring_id", "level", "_cy").orderBy(F.desc("_cx"))
    cells = cells.withColumns({"_right": F.sum("_n").over(row), "_next": F.lag("_cx").over(row)})
    cells = cells.select("ring_id", "level", "_cx", "_cy", "_next", ((F.col("_right") - F.col("_n")) % 2 == 1).alias("odd"))
    border = ec.join(cells.drop("_next"), ["ring_id", "level", "_cx", "_cy"])
    gap = cells.filter((F.col("_next") > F.col("_cx") + 1) & F.col("odd"))
    none = [F.lit(None).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")]
    within = gap.select("ring_id", "level", F.explode(F.expr("sequence(_cx + 1, _next - 1)")).alias("_cx"), "_cy", F.lit(True).alias("odd"), *none)
    return border.select(*within.columns).unionByName(within)


@remembered
def _flips(rule: str) -> Column:
    """How often an edge parts a point (lon, lat) of a border cell from the cell's lower right corner: 0 to 3."""
    size = _size("level")
    xr, y0 = (F.col("_cx") + 1) * size + OFF, F.col("_cy") * size + OFF
    count = lambda b: F.when(b, 1).otherwise(0)
    beside = [geo.ray_toggles(x, "lat", "x1", "y1", "x2", "y2", rule) for x in ("lon", xr)]
    dy = F.when(F.col("y1") == F.col("y2"), 1.0).otherwise(F.col("y2") - F.col("y1"))
    left = lambda y: xr <= (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / dy + F.col("x1")
    over = (lambda y: F.col("y1") > y) if rule == "half_open" else (lambda y: F.col("y1") >= y)
    level = F.when(F.col("y1") == F.col("y2"), over(F.col("lat")) != over(y0)).otherwise(left(F.col("lat")) != left(y0))
    return count(beside[0]) + count(beside[1]) + count(((F.col("x1") > xr) != (F.col("x2") > xr)) & level)


def points_in_cover(points: DataFrame, cover: DataFrame, rule: str = "closed_right") -> DataFrame:
    """(pid, ring_id) pairs with the point inside the ring, from ``ring_cover``. ``points`` has pid, lon, lat; null and
    non-finite positions are nowhere inside.

    A point is looked up once per cell size that the cover holds. The rows that meet in a crowded cell are those of its own edges only,
    and the join key is the cell, so a crowded one is split by AQE.
    """
    levels = cover.agg(F.collect_set("level").alias("_levels"))  # one row of at most nine sizes
    p = points.select("pid", "lon", "lat").filter("abs(lon) < 1e6 and abs(lat) < 1e6").crossJoin(F.broadcast(levels))
    p = p.select("pid", "lon", "lat", F.explode("_levels").alias("level"))
    p = p.withColumns({"_cx": _at("lon", _size("level")), "_cy": _at("lat", _size("level"))})
    j = p.join(cover, ["level", "_cx", "_cy"])
    n = F.when(F.col("x1").isNull(), 0).otherwise(_flips(rule))
    x = j.select("pid", "ring_id", "odd", n.alias("_n")).groupBy("pid", "ring_id").agg(F.sum("_n").alias("_n"), F.first("odd").alias("odd"))
    return x.filter((F.col("_n") % 2 == 1) != F.col("odd")).select("pid", "ring_id")


def fine_cover(edges: DataFrame) -> DataFrame:
    """The cover of ``edges`` with cells small enough that many lie inside a ring, made once for a frame of edges."""
    if edges not in _COVERS:
        _COVERS[edges] = settle(ring_cover(edges, finer=1))
    return _COVERS[edges]


def _masks(cells: DataFrame, name: str) -> DataFrame:
    """Cells (level, _cx, _cy) as bits: one row holds 64 neighbours of a grid row."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_cx", F.lit(64)).cast("int"))
    return cells.groupBy("level", F.floor(F.col("_cx") / 64).alias("_tx"), "_cy").agg(F.bit_or(bit).alias(name))


def land_masks(edges: DataFrame) -> tuple[DataFrame, list[int], int]:
    """((level, _tx, _cy, _in, _on), its levels, its rows): which cells lie inside a ring and which hold edges, 64 cells of a grid row as the bits of one row. Made once for a frame of edges.

    The rows are bounded by the grid and not by the rings: where rings lie over one another they share them.
    """
    if edges not in _MASKS:
        cover = fine_cover(edges)
        m = _masks(cover.filter("x1 is null"), "_in").join(_masks(cover.filter("x1 is not null"), "_on"), ["level", "_tx", "_cy"], "full")
        m = cut(m.select("level", "_tx", "_cy", F.coalesce("_in", F.lit(0)).alias("_in"), F.coalesce("_on", F.lit(0)).alias("_on")))
        sizes = m.groupBy("level").count().collect()  # one row of at most nine sizes
        _MASKS[edges] = m, sorted(r["level"] for r in sizes), sum(r["count"] for r in sizes)
    return _MASKS[edges]


def with_land_state(points: DataFrame, edges: DataFrame, lon: str = "lon", lat: str = "lat", out: str = "_land") -> DataFrame:
    """All rows with ``out``: 2 for a point (lon, lat) in a cell inside a ring, 1 in a cell that holds edges, else 0.

    Up to ``MASK_ROWS`` rows of masks are broadcast, so the points are not moved.
    """
    masks, levels, count = land_masks(edges)
    keep, x = points.columns, points
    ok, state = (F.abs(F.col(lon)) < 1e6) & (F.abs(F.col(lat)) < 1e6), []
    for v in levels:
        m = masks.filter(F.col("level") == v).select(F.col("_tx").alias("_mx"), F.col("_cy").alias("_my"), "_in", "_on")
        x = x.withColumns({"_bx": F.when(ok, _at(lon, 4.0 ** v)), "_my": F.when(ok, _at(lat, 4.0 ** v))}).withColumn("_mx", F.floor(F.col("_bx") / 64))
        x = x.join(F.broadcast(m) if count <= MASK_ROWS else m, ["_mx", "_my"], "left")
        bit = lambda name: F.call_function("getbit", F.col(name), F.pmod("_bx", F.lit(64)).cast("int")) == 1
        x = x.select(*keep, *state, F.when(bit("_in"), 2).when(bit("_on"), 1).otherwise(0).alias(f"_state{len(state)}"))
        state.append(f"_state{len(state)}")
    return x.select(*keep, F.greatest(F.lit(0), F.lit(0), *state).alias(out))


def land_points(points: DataFrame, edges: DataFrame, rule: str = "closed_right") -> DataFrame:
    """Pids of the points inside any ring, some more than once. ``points`` has pid, lon, lat and is read twice.

    Cells inside a ring are kept once however many rings hold them, and points are looked up in them where they are; only points in cells with
    edges, and in none inside a ring, move and meet edges.
    """
    p = with_land_state(points.select("pid", "lon", "lat"), edges)
    border = border_points(p.filter("_land = 1"), edges, rule)
    return p.filter("_land = 2").select("pid").unionByName(border)


def border_points(points: DataFrame, edges: DataFrame, rule: str = "closed_right") -> DataFrame:
    """Pids of those points, all in cells that hold edges and none in a cell inside a ring, that lie inside a ring; one row for each ring."""
    return points_in_cover(points, fine_cover(edges).filter("x1 is not null"), rule).select("pid")


def points_on_land(points: DataFrame, edges: DataFrame, rule: str = "closed_right") -> DataFrame:
    """Distinct pids of ``land_points``."""
    return land_points(points, edges, rule).distinct()
