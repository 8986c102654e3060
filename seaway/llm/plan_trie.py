"""Prefix tree of voyage plans: which first waypoints do routes share, and what would be saved by storing them once.

Records are the lines of passage plans: ``route_id``, ``wp_index``, ``name`` and ``line`` (the text of a waypoint). Two routes share a
node of depth d when their first d steps agree in name and line. The tree comes from whole sequences: routes with the same steps are
collapsed into one weighted sequence with its list of routes, sequences that are proper prefixes of others are found by anti-join
(what remains are the leaves), and only the prefixes of distinct sequences are aggregated, with their weights.

Texts never move: steps travel as 128-bit MD5 marks and byte counts, and a prefix is known by a chained mark. A route is worked in blocks
of 64 steps; only one mark a block is chained per route, so a route with very many steps is spread over many tasks.

Defined cases: a null name or line counts as empty; a null ``wp_index`` comes first; steps of equal index are ordered by name and then by
the mark of their line; repeated rows are steps of their own; rows without ``route_id`` belong to no route and are left out; an empty
table gives no node; columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaway.operators.ordered import number_rows
from seaway.session import cut

BLOCK = 64
BUCKET = 4096
LOWEST = -(2**63)
EMPTY = ""  # mark of the root


class Trie(NamedTuple):
    """``nodes`` has one row per node; ``ends`` lists, in pieces of at most 4,096 ids, the routes that end at a node."""

    nodes: DataFrame
    ends: DataFrame


def plan_steps(lines: DataFrame) -> DataFrame:
    """(route_id, step_no from 1, mark, n_bytes) of plan lines (route_id, wp_index, name, line)."""
    name, line = F.coalesce("name", F.lit("")), F.coalesce("line", F.lit(""))
    x = lines.filter("route_id is not null").select(
        "route_id", "wp_index", name.alias("_name"), F.md5(line.cast("binary")).alias("_line"), F.octet_length(line).cast("long").alias("n_bytes"))
    bucket = F.coalesce(F.floor(F.col("wp_index") / BUCKET), F.lit(LOWEST))
    x = number_rows(x, ["route_id"], ["wp_index", "_name", "_line"], bucket, "step_no")
    return x.select("route_id", "step_no", F.md5(F.concat(F.md5(F.col("_name").cast("binary")), "_line").cast("binary")).alias("mark"), "n_bytes")


def graft_steps(steps: DataFrame, grafts: DataFrame) -> DataFrame:
    """Steps of diverted routes: the first ``n_steps`` steps of ``donor_id``, then the route's own steps after its first ``n_steps``.

    ``grafts`` has one row (route_id, donor_id, n_steps) per route; a donor with fewer steps gives all, an absent one none. Routes that
    ``grafts`` does not name are left out.
    """
    g = grafts.select("route_id", "donor_id", F.col("n_steps").cast("long").alias("n_steps"))
    head = steps.join(g.agg(F.max("n_steps").alias("_most")), F.col("step_no") <= F.col("_most")).drop("_most")
    given = g.join(head.withColumnRenamed("route_id", "donor_id"), "donor_id").filter("step_no <= n_steps")
    length = steps.groupBy("route_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("route_id", "donor_id")
    moved = g.join(length, "donor_id", "left").select("route_id", "n_steps", F.least("n_steps", F.coalesce("_n", F.lit(0))).alias("_at"))
    own = steps.join(moved, "route_id").filter("step_no > n_steps")
    own = own.select("route_id", (F.col("step_no") - F.col("n_steps") + F.col("_at")).alias("step_no"), "mark", "n_bytes")
    return given.select("route_id", "step_no", "mark", "n_bytes").unionByName(own)


def _entries(blocks: DataFrame) -> DataFrame:
    """(route_id, _blk, _enter, _before) of all blocks but the first: the mark and the bytes of the steps before the block."""
    later = blocks.filter("_blk > 0").select("route_id").distinct()
    rows = blocks.join(later, "route_id", "left_semi").groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("_blk", "_whole", "_size"))).alias("_b"))

    @F.pandas_udf("array<struct<_blk:bigint,_enter:string,_before:bigint>>")
    def chain(lists: pd.Series) -> pd.Series:
        out = []
        for blocks_of in lists:
            mark, size, row = EMPTY, 0, []
            for b in blocks_of:
                if b["_blk"]:
                    row.append({"_blk": b["_blk"], "_enter": mark, "_before": size})
                mark = hashlib.md5((mark + b["_whole"]).encode()).hexdigest()
                size += int(b["_size"])
            out.append(row)
        return pd.Series(out)

    return rows.select("route_id", F.inline(chain("_b")))


def _prefixes(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row per step of a block: depth, mark of the prefix, of its parent, bytes of the step and before it."""
    part = lambda d: F.md5(F.concat("_enter", F.md5(F.array_join(F.slice("_marks", F.lit(1), d), "").cast("binary"))).cast("binary"))
    rows = F.transform(F.sequence(F.lit(1), F.size("_marks")), lambda d: F.struct(
        (F.col("_blk") * BLOCK + d).alias("depth"), part(d).alias("node"), F.when(d == 1, F.col("_enter")).otherwise(part(d - 1)).alias("parent"),
        F.element_at("_sizes", d).alias("n_bytes"),
        (F.col("_before") + F.aggregate(F.slice("_sizes", F.lit(1), d - 1), F.lit(0).cast("long"), lambda a, b: a + b)).alias("before")))
    return blocks.select("route_id", *keep, F.inline(rows))


def plan_trie(steps: DataFrame, routes: DataFrame) -> Trie:
    """The prefix tree of the routes in ``routes`` (route_id, one row each; those without steps end at the root).

    Nodes: ``node`` and ``parent`` (marks), ``route_id`` (smallest member), ``depth``, ``parent_route_id`` (null at the root),
    ``n_routes``, ``n_children``, ``n_leaves`` (childless nodes of the subtree) and ``saved_bytes`` (over the subtree, (n_routes - 1)
    times the bytes of a node's line). Ends: ``node``, ``bucket``, ``route_ids`` (ascending, as are the buckets).
    """
    all_routes = routes.filter("route_id is not null").select("route_id").distinct()
    b = steps.withColumn("_blk", F.floor((F.col("step_no") - 1) / BLOCK)).groupBy("route_id", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("step_no", "mark", "n_bytes"))).alias("_s"))
    b = b.select("route_id", "_blk", F.col("_s.mark").alias("_marks"), F.col("_s.n_bytes").alias("_sizes"))
    whole = F.md5(F.array_join("_marks", "").cast("binary"))
    b = cut(b.withColumns({"_whole": whole, "_size": F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, v: a + v)}))
    first = b.filter("_blk = 0").withColumns({"_enter": F.lit(EMPTY), "_before": F.lit(0).cast("long")})
    blocks = cut(first.unionByName(b.filter("_blk > 0").join(_entries(b), ["route_id", "_blk"])))

    # whole sequences: routes with equal steps, their weight and the routes that end there
    at_end = blocks.groupBy("route_id").agg(
        F.max_by(F.struct(F.md5(F.concat("_enter", "_whole").cast("binary")).alias("node"), (F.col("_before") + F.col("_size")).alias("total")), "_blk").alias("_e"))
    at_end = cut(all_routes.join(at_end, "route_id", "left").select(
        "route_id", F.coalesce("_e.node", F.lit(EMPTY)).alias("node"), F.coalesce("_e.total", F.lit(0)).cast("long").alias("total")))
    sequences = cut(at_end.groupBy("node").agg(F.min("route_id").alias("route_id"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total")))
    ends = at_end.groupBy("node", F.floor(F.col("route_id") / BUCKET).alias("bucket")).agg(F.array_sort(F.collect_list("route_id")).alias("route_ids"))

    # prefixes of distinct sequences; the root is a prefix of each
    kept = cut(blocks.join(sequences.select("route_id", "weight", "total"), "route_id"))
    root = lambda s, *keep: s.select("route_id", *keep, F.lit(0).cast("long").alias("depth"), F.lit(EMPTY).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("before"))
    paths = _prefixes(kept)
    names = cut(paths.groupBy("node").agg(F.min("route_id").alias("route_id"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes")))
    # a sequence owns the nodes that bear its smallest route, so that each node's bytes count in one sequence
    owned = names.groupBy("route_id").agg(F.sum("n_bytes").alias("owned"))
    leaves = sequences.join(names.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("route_id", F.lit(1).cast("long").alias("leaf"))
    facts = cut(sequences.join(owned, "route_id", "left").join(leaves, "route_id", "left").select(
        "route_id", "weight", "total", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    keep = ("weight", "total", "owned", "leaf")
    paths = _prefixes(kept.drop("weight", "total").join(facts, "route_id"), *keep).unionByName(root(facts, *keep))
    n = paths.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("before").alias("before"), F.sum("weight").alias("n_routes"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("total")).alias("_all"), F.sum("owned").alias("_owned"),
        F.min(F.struct("route_id", "owned", "total")).alias("_o"))
    every = F.col("_all") - F.col("n_routes") * F.col("before")
    once = F.col("_owned") - F.col("_o.owned") + F.col("_o.total") - F.col("before")
    n = cut(n.select("node", "parent", F.col("_o.route_id").alias("route_id"), "depth", "n_routes", "n_leaves", (every - once).alias("saved_bytes")))

    children = n.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    top = n.filter("depth = 0").select(F.col("route_id").alias("parent_route_id"))  # one row
    above = n.select(F.col("node").alias("parent"), F.col("route_id").alias("parent_route_id"))
    upper = n.filter("depth = 1").crossJoin(F.broadcast(top)).unionByName(n.filter("depth = 0").withColumn("parent_route_id", F.lit(None).cast(n.schema["route_id"].dataType)))
    nodes = n.filter("depth > 1").join(above, "parent").select(*upper.columns).unionByName(upper).join(children, "node", "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return Trie(nodes.select("node", "parent", "route_id", "depth", "parent_route_id", "n_routes", "n_children", "n_leaves", "saved_bytes"), ends)
