"""Repair of plans whose lines do not follow each other as a plan must: weighted CYK parsing over spans of lines.

Records are the lines of passage plans: ``route_id``, ``wp_index``, ``name`` and ``line``. The first letter of a name is what the grammar
reads; ``VOYAGE`` is the order of navigational waypoints (berth, fairway, waypoints and convergences, fairway, berth; short routes lack
what lies between), other orders are given as another ``Grammar``.

The repair grammar is in Chomsky normal form. Its nonterminals are pairs of states [p, r] of the order; rules are [p, r] -> [p, q] [q, r] for
spans, and a line gives [p, q] when it is kept (or renamed) on a step from p to q, or [p, p] when it is deleted. Inserted lines give
steps that read nothing; their closure stands on both sides of every line. A cell of the chart holds, per nonterminal, the least (cost, audit,
letters). Spans are combined bottom-up by length: all spans and all splits within blocks of ``CHART`` lines, then blocks in pairs, pairs of
pairs and so on. The latter is enough because the nonterminals are closed under every split: cells of equal cost never have one audit as
the start of another (it would hold fewer edits), so least parts make a least whole, wherever a span is split.

A chart depends only on letters and faults, so it is remembered per worker. Lines move once with their texts; all else moves as letters,
hashes and counts. Lines of a route come together in blocks of ``BUCKET`` indexes, and the texts of a route are streamed, so that a route with
very many lines needs no more memory than its audit.

Defined cases: null names and lines are one blank; a null ``wp_index`` comes first; lines of equal index are ordered by name and then
by the hash of their text; rows without ``route_id`` are one route of their own; an empty table gives no route; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaway.session import cut

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
CHART = 10
BUCKET = 1024
OTHER = "-"
SOUND, CUT_SHORT, REPEATED, BLANK = "0123"
Cell = dict[int, dict[int, tuple[int, str, str]]]


@dataclass(frozen=True)
class Grammar:
    """Allowed orders of line letters as steps between states, from state 0 to one of ``accept``.

    ``names`` maps the letters that a line may be renamed to, or that may be inserted, to the names such lines get. ``adjacent`` has the
    pairs of letters that may stand side by side. ``closing`` holds the signs that may end a line (empty: no line is cut short).
    """

    steps: Mapping[tuple[int, str], int]
    accept: frozenset[int]
    names: Mapping[str, str]
    adjacent: frozenset[str]
    closing: str = ""
    keep: int = 0
    rename: int = 2
    delete: int = 3
    insert: int = 2
    short: int = 1
    states: int = field(init=False, default=0)

    def __post_init__(self):
        object.__setattr__(self, "states", 1 + max([*self.accept, *(s for s, _ in self.steps), *self.steps.values()]))
        object.__setattr__(self, "steps", dict(self.steps))

    @property
    def letters(self) -> str:
        return "".join(sorted({c for _, c in self.steps}))


VOYAGE = Grammar(
    steps={(0, "B"): 1, (1, "B"): 5, (1, "F"): 2, (2, "B"): 5, (2, "F"): 4, (2, "W"): 3, (2, "C"): 3, (3, "W"): 3, (3, "C"): 3, (3, "F"): 4, (4, "B"): 5},
    accept=frozenset({0, 5}), names={"B": "BERTH", "F": "FAIRWAY"},
    adjacent=frozenset({"BB", "BF", "FW", "FC", "FF", "WW", "WC", "CW", "CC", "WF", "CF", "FB"}))


def _better(cell: dict, q: int, way: tuple[int, str, str]) -> None:
    if q not in cell or way < cell[q]:
        cell[q] = way


def join_cells(left: Cell, right: Cell) -> Cell:
    """[p, r] -> [p, q] [q, r]: the least way of each pair of states over a span and the one after it."""
    out: Cell = {}
    for p, row in left.items():
        best: dict[int, tuple[int, str, str]] = {}
        for q, (c, a, s) in row.items():
            for r, (d, b, t) in right.get(q, {}).items():
                if r not in best or c + d <= best[r][0]:
                    _better(best, r, (c + d, a + b, s + t))
        out[p] = best
    return out


class Parser:
    """Charts of one grammar over sequences of (letter, fault) pairs."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        idle: Cell = {p: {p: (0, "", "")} for p in range(grammar.states)}
        one: Cell = {p: dict(row) for p, row in idle.items()}
        for (p, c), q in sorted(grammar.steps.items()):
            if c in grammar.names:
                _better(one[p], q, (grammar.insert, "I", c))
        self.gap, before = one, None
        while self.gap != before:  # insertion closure: costs are positive, so this ends
            before, self.gap = self.gap, join_cells(self.gap, one)
        self.leaf = lru_cache(maxsize=4096)(self._leaf)
        self.parse = lru_cache(maxsize=1 << 16)(self._parse)

    def _leaf(self, letter: str, fault: str) -> Cell:
        g, cell = self.g, {}
        extra = g.short if fault == CUT_SHORT else 0
        for p in range(g.states):
            row = {p: (g.delete, "D", "")}
            if fault in (SOUND, CUT_SHORT):
                for (s, c), q in g.steps.items():
                    if s == p and c == letter:
                        _better(row, q, (g.keep + extra, "K", c))
                    if s == p and c in g.names:
                        _better(row, q, (g.rename + extra, "R", c))
            cell[p] = row
        return join_cells(join_cells(self.gap, cell), self.gap)

    def _chart(self, leaves: list[Cell]) -> Cell:
        """The cell of all leaves, from every span and every split of it."""
        spans = {(i, i + 1): leaf for i, leaf in enumerate(leaves)}
        for length in range(2, len(leaves) + 1):
            for i in range(len(leaves) - length + 1):
                cell: Cell = {p: {} for p in range(self.g.states)}
                for k in range(i + 1, i + length):
                    for p, row in join_cells(spans[i, k], spans[k, i + length]).items():
                        for q, way in row.items():
                            _better(cell[p], q, way)
                spans[i, i + length] = cell
        return spans[0, len(leaves)]

    def _parse(self, signature: str) -> tuple[int, str, str]:
        """(cost, audit, letters after repair) of a signature, two characters a line."""
        leaves = [self.leaf(signature[i], signature[i + 1]) for i in range(0, len(signature), 2)]
        if not leaves:
            return 0, "", ""
        level = [self._chart(leaves[i : i + CHART]) for i in range(0, len(leaves), CHART)]
        while len(level) > 1:
            level = [join_cells(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return min(way for q, way in level[0][0].items() if q in self.g.accept)


@lru_cache(maxsize=8)
def _parser(key: tuple) -> Parser:
    steps, accept, names, adjacent, closing, costs = key
    return Parser(Grammar(dict(steps), accept, dict(names), adjacent, closing, *costs))


def _key(g: Grammar) -> tuple:
    return tuple(g.steps.items()), g.accept, tuple(g.names.items()), g.adjacent, g.closing, (g.keep, g.rename, g.delete, g.insert, g.short)


class Repair(NamedTuple):
    """``reports``: one row per route. ``lines``: the repaired lines, those of a route in order within one partition."""

    reports: DataFrame
    lines: DataFrame


def _signatures(x: DataFrame, grammar: Grammar) -> DataFrame:
    """(route_id, signature, gaps) from narrow rows (route_id, wp_index, name, _h, _blank, _short)."""
    key = ["route_id", "name", "_h"]
    alike = x.groupBy(*key, "wp_index").agg(F.count(F.lit(1)).alias("_n"), F.first("_blank").alias("_blank"), F.first("_short").alias("_short"))
    first = alike.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.min(F.struct("wp_index")).alias("_first"))
    same = F.col("route_id").eqNullSafe(F.col("_route_id")) & (F.col("name") == F.col("_name")) & (F.col("_h") == F.col("__h"))
    alike = alike.join(first, same)
    letter = F.substring("name", 1, 1)
    letter = F.when(letter.isin(*grammar.letters), letter).otherwise(F.lit(OTHER))
    once = F.when(F.col("_blank"), F.lit(BLANK)).when(~F.struct("wp_index").eqNullSafe(F.col("_first")), F.lit(REPEATED)).when(F.col("_short"), F.lit(CUT_SHORT)).otherwise(F.lit(SOUND))
    again = F.when(F.col("_blank"), F.lit(BLANK)).otherwise(F.lit(REPEATED))
    signs = F.concat(letter, once, F.repeat(F.concat(letter, again), F.col("_n").cast("int") - 1))
    blk = F.floor(F.col("wp_index") / BUCKET)
    b = alike.withColumns({"_blk": blk, "_signs": signs}).groupBy("route_id", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("wp_index", "name", "_h", "_signs"))).alias("_s"), F.min("wp_index").alias("_lo"), F.max("wp_index").alias("_hi"))
    b = b.select("route_id", "_blk", F.array_join("_s._signs", "").alias("_signs"), "_lo", "_hi",
                 F.size(F.array_distinct("_s.wp_index")).cast("long").alias("_d"))
    r = b.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_blk").isNotNull().alias("has"), "_blk", "_signs"))).alias("_s"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum(F.when(F.col("_blk").isNotNull(), F.col("_d"))).alias("_d"))
    gaps = F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_d"), F.lit(0))
    return r.select("route_id", F.array_join("_s._signs", "").alias("signature"), gaps.cast("long").alias("gaps"))


PARSED = "blank bigint, repeated bigint, cut_short bigint, illegal bigint, cost bigint, audit string, letters string"


def _mend(names: Mapping[str, str], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines after repair, from the reports and lines of each route in order (its report first)."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    at, audit, letters, a, n, idle = None, "", "", 0, 0, True

    def put(name, line):
        nonlocal n
        n += 1
        for column, value in zip(out, (at, n, name, line), strict=True):
            column.append(value)

    def inserts():
        nonlocal a
        while a < len(audit) and audit[a] == "I":
            put(names[letters[n]], "")
            a += 1

    kind = None
    for batch in rows:
        kind = kind or batch.schema.field(0).type
        for route, name, line, report, after in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if report is not None:
                if not idle:
                    inserts()
                at, audit, letters, a, n, idle = route, report, after, 0, 0, False
                continue
            inserts()
            edit, a = audit[a], a + 1
            if edit != "D":
                put(name if edit == "K" else names[letters[n]], line)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["route_id", "line_no", "name", "line"])
            for column in out:
                column.clear()
    if not idle:
        inserts()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["route_id", "line_no", "name", "line"])


def repair_plans(plan_lines: DataFrame, grammar: Grammar = VOYAGE, routes: DataFrame | None = None) -> Repair:
    """The cheapest repair of every route's lines (route_id, wp_index, name, line).

    Faults of a line, the first that holds: blank (nothing but blanks), repeated (name and line came before), cut short (its last
    sign is not one of ``grammar.closing``). Edits: K keep (0), R rename (2), D delete (3, required for blank and repeated lines), I insert an
    empty line (2); a cut line that stays adds 1. Reports: ``route_id``, ``gaps`` (indexes missing between the first and last), ``blank``,
    ``repeated``, ``cut_short``, ``illegal`` (neighbours whose letters may not meet), ``cost``, ``audit`` (the edits in order; of
    equal cost the least in ASCII order) and ``letters`` (the order after repair). ``routes`` (route_id) adds routes that have no lines.
    """
    space = F.lit(" ")
    x = plan_lines.select("route_id", "wp_index", F.coalesce("name", space).alias("name"), F.coalesce("line", space).alias("line"))
    trimmed = F.rtrim("line", F.lit(BLANKS))
    short = ~F.right(trimmed, F.lit(1)).isin(*grammar.closing) if grammar.closing else F.lit(False)
    x = x.withColumns({"_h": F.md5(F.col("line").cast("binary")), "_blank": trimmed == "", "_short": short})
    key, adjacent = _key(grammar), grammar.adjacent

    @F.pandas_udf(PARSED)
    def parsed(signatures: pd.Series) -> pd.DataFrame:
        parser, rows = _parser(key), []
        for s in signatures:
            cost, audit, letters = parser.parse(s)
            marks = s[::2]
            rows.append((s[1::2].count(BLANK), s[1::2].count(REPEATED), s[1::2].count(CUT_SHORT),
                         sum(marks[i : i + 2] not in adjacent for i in range(len(marks) - 1)), cost, audit, letters))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    narrow = _signatures(x.drop("line"), grammar)
    if routes is not None:
        ids = routes.select(F.col("route_id").alias("_id")).distinct()
        narrow = ids.join(narrow, F.col("_id").eqNullSafe(F.col("route_id")), "left").select(
            F.col("_id").alias("route_id"), F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    reports = cut(narrow.withColumn("_p", parsed("signature")).select("route_id", "gaps", "_p.*"))
    none = F.lit(None).cast("string")
    rows = x.select("route_id", F.lit(1).alias("_k"), F.col("wp_index").cast("long").alias("wp_index"), "name", "_h", "line", none.alias("audit"), none.alias("letters")).unionByName(
        reports.select("route_id", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("wp_index"), none.alias("name"), none.alias("_h"), none.alias("line"), "audit", "letters"))
    rows = rows.repartition("route_id").sortWithinPartitions("route_id", "_k", "wp_index", "name", "_h")
    names = dict(grammar.names)
    lines = rows.select("route_id", "name", "line", "audit", "letters").mapInArrow(
        lambda batches: _mend(names, batches), f"route_id {x.schema['route_id'].dataType.simpleString()}, line_no bigint, name string, line string")
    return Repair(reports, lines)
