"""Prefix trees, repairs and repetition of plans against plain references, also on waypoints of routes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seaway.llm import plan_repair, plan_trie, queries, repetition
from seaway.operators.folds import navigational_waypoints

CONVERSATION = "conv_id long, turn long, role string, text string, route_id string, mark int"
BLANKS = " \t\n\x0b\x0c\r"
DELTA = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def in_order(rows):
    d = defaultdict(list)
    for c, t, r, x in rows:
        d[c].append((t, r, x))
    for v in d.values():
        v.sort(key=lambda w: (w[0] is not None, w[0] or 0, w[1], hashlib.md5(w[2].encode()).hexdigest()))
    return d


def plain_trie(rows):
    own = in_order([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None])
    built = {}
    for c, v in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = [w[1:] for w in own.get(donor, [])[:h]] + [w[1:] for w in v[h:]]
    members, children = defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out, below = set(), {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(below[k][1] for k in children[p])
        below[p] = (sum(below[k][0] for k in children[p]) if children[p] else 1, saved)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(built[c]) == len(p)))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def damage(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else x.translate({46: None, 33: None, 63: None}) if k == 2 else x
        yield from [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)


def keep_least(ways, q, way):
    if q not in ways or way[:2] < ways[q][:2]:
        ways[q] = way


def with_inserts(ways):
    """Left-to-right shortest edits, one state at a time."""
    for _ in range(4):
        for q, (k, a, s) in list(ways.items()):
            for letter, name in (("u", "user"), ("a", "assistant")):
                if (q, letter) in DELTA:
                    keep_least(ways, DELTA[q, letter], (k + 2, a + "I", (*s, (name, ""))))
    return ways


def plain_repair(rows):
    ids, after, out = {r[0] for r in rows}, in_order(damage(rows)), set()
    for c in ids:
        v, seen, faults = after.get(c, []), set(), ""
        turns = {t for t, _, _ in v if t is not None}
        for _, r, x in v:
            body = x.strip(BLANKS)
            faults += "b" if not body else "d" if (r, x) in seen else "o" if body[-1] in ".!?" else "t"
            seen.add((r, x))
        ways = with_inserts({0: (0, "", ())})
        for (_, r, x), fault in zip(v, faults, strict=True):
            after_row = {}
            for q, (k, a, s) in ways.items():
                keep_least(after_row, q, (k + 3, a + "D", s))
                for letter, name, edit, cost in ((r[:1], r, "K", 0), ("u", "user", "R", 2), ("a", "assistant", "R", 2)):
                    if fault in "ot" and (q, letter) in DELTA:
                        keep_least(after_row, DELTA[q, letter], (k + cost + (fault == "t"), a + edit, (*s, (name, x))))
            ways = with_inserts(after_row)
        cost, audit, lines = min((ways[q] for q in (0, 3) if q in ways), key=lambda w: w[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False))
        text = "\n".join(f"{r}:{x}" for r, x in lines)
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_rows():
    """Nulls in every column, copies, prefixes of each other, gaps, ties, empty texts, negative ids and one very long conversation."""
    pick, rows = random.Random(7), []
    for c in [None, *range(-9, 0), *range(1, 40)]:
        for t in range(pick.randint(1, 7)):
            role = pick.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            rows.append((c, pick.choice([t, t, t, t + 3, None]), role, pick.choice(["Yes.", "No", "Perhaps?", "", None, " \t\n", "Ünder way.", "Stop!  "])))
    for c in (0, 50, 51, 52, 55):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Leg {t}.") for t in range(4)]
    rows += [(60, t, pick.choice(["user", "assistant", "system"]), f"{pick.choice('abc')} {t // 3}.") for t in range(1500)]
    rows += [(61, t, *r[2:]) for t, r in enumerate(rows[-1500:][:300])]
    return rows + rows[:3]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    home, rows = tmp_path_factory.mktemp("odd"), odd_rows()
    spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATION).repartition(5).write.parquet(f"{home}/conversations.parquet")
    return str(home), rows


def result(df, columns):
    assert df.columns[: len(columns)] == columns
    rows = [tuple(r)[: len(columns)] for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_trie_of_conversations_equals_plain_one(spark, odd):
    home, rows = odd
    df = queries.op11_conversation_trie(spark, home)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert result(df, TRIE) == plain_trie(rows)


def test_repair_of_conversations_equals_plain_one(spark, odd):
    home, rows = odd
    df = queries.op12_conversation_repair(spark, home)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert result(df, REPAIR) == plain_repair(rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], CONVERSATION).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_trie(spark, str(tmp_path)).count() == 0
    assert queries.op12_conversation_repair(spark, str(tmp_path)).count() == 0
    assert repetition.repetition(spark.createDataFrame([], "route_id long, plan_text string")).count() == 0


def test_charts_of_spans_equal_left_to_right(spark):
    parser, pick = plan_repair.Parser(queries.TURNS), random.Random(3)
    for _ in range(400):
        n = pick.choice([0, 1, 2, 5, 9, 10, 11, 20, 21, 45])
        rows = [(pick.choice("sua-"), pick.choice("000123")) for _ in range(n)]
        ways = with_inserts({0: (0, "", ())})
        for letter, fault in rows:
            after = {}
            for q, (k, a, s) in ways.items():
                keep_least(after, q, (k + 3, a + "D", s))
                for to, edit, cost in ((letter, "K", 0), ("u", "R", 2), ("a", "R", 2)):
                    if fault in "01" and (q, to) in DELTA:
                        keep_least(after, DELTA[q, to], (k + cost + (fault == "1"), a + edit, (*s, to)))
            ways = with_inserts(after)
        want = min((ways[q] for q in (0, 3) if q in ways), key=lambda w: w[:2])
        assert parser.parse("".join(a + b for a, b in rows))[:2] == want[:2]
    cost, audit, letters = parser.parse("u0a0" * 20_000)  # a very long conversation
    assert (cost, len(audit), letters[:4]) == (0, 40_000, "uaua")


@pytest.fixture(scope="module")
def plan_lines(spark):
    """Lines of the waypoints of three routes, two with the same beginning, with columns of other uses."""
    legs = {1: [(-70.0, -60.0), (-60.0, -60.5), (-50.0, -58.0), (-40.0, -60.0)], 2: [(-70.0, -60.0), (-60.0, -60.5), (-50.0, -58.0), (-40.0, -66.0)], 3: [(10.0, -40.0), (12.0, -52.0), (15.0, -61.0)]}
    points = spark.createDataFrame([(r, i + 1, x, y) for r, v in legs.items() for i, (x, y) in enumerate(v)], "route_id long, seq long, lon double, lat double")
    w = navigational_waypoints(points)
    return w.withColumn("line", F.format_string("%s,%.5f,%.5f,%s", "name", "lat", "lon", "zone")).withColumn("mark", F.lit(1))


def test_trie_of_waypoints(spark, plan_lines):
    trie = plan_trie.plan_trie(plan_trie.plan_steps(plan_lines), plan_lines.select("route_id"))
    nodes = {(r.route_id, r.depth): r for r in trie.nodes.collect()}
    rows = plan_lines.orderBy("route_id", "wp_index").collect()
    line = {(r.route_id, r.wp_index): r.line for r in rows}
    shared = 0
    while line[1, shared + 1] == line[2, shared + 1]:
        shared += 1
    assert shared >= 2
    assert nodes[1, 0].n_routes == 3 and nodes[1, 0].n_leaves == 3 and nodes[1, 0].n_children == 2
    assert nodes[1, 0].saved_bytes == sum(len(line[1, k].encode()) for k in range(1, shared + 1))
    assert nodes[1, shared].n_routes == 2 and nodes[1, shared].n_children == 2 and nodes[2, shared + 1].parent_route_id == 1
    assert sorted(i for r in trie.ends.collect() for i in r.route_ids) == [1, 2, 3]


def test_repair_of_waypoints(spark, plan_lines):
    rows = {(r.route_id, r.wp_index): r for r in plan_lines.collect()}
    whole = plan_repair.repair_plans(plan_lines)
    assert {r.cost for r in whole.reports.collect()} == {0}
    last = max(i for r, i in rows if r == 3)
    broken = plan_lines.filter("not (route_id = 3 and wp_index = 1)").unionByName(plan_lines.filter(f"route_id = 3 and wp_index = {last}"))
    found = plan_repair.repair_plans(broken)
    report = {r.route_id: r for r in found.reports.collect()}
    assert report[1].cost == 0 and report[3].cost == 5 and report[3].audit.startswith("I") and report[3].audit.endswith("D") and report[3].repeated == 1
    lines = sorted((r.line_no, r.name, r.line) for r in found.lines.filter("route_id = 3").collect())
    assert lines[0][1:] == ("BERTH", "") and [x[1] for x in lines[1:]] == [rows[3, i].name for i in range(2, last + 1)]


def plain_counts(text):
    words = repetition.WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if repetition.WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_repetition_counts_equal_plain_ones(spark, tmp_path):
    pick = random.Random(5)
    texts = [None, "", " \t\n", "one", "a " * 30_000, "x\u00a0y \x1c z " * 4, "Ö# $5 <b>\n" * 5, "\n".join(["same line of words here"] * 3 + ["other words"] * 2)]
    texts += ["".join(pick.choice(["ice ", "berg ", "port ", "sea\n", "a-b ", "|\r\n"][: pick.randint(1, 6)]) for _ in range(pick.randint(1, 80))) for _ in range(300)]
    texts += [" ".join(f"w{pick.randint(0, 400)}" for _ in range(3000)) for _ in range(4)]
    rows = [(None if i == 5 else i, x, "z") for i, x in enumerate(texts)] + [(7, texts[7], "z")]
    spark.createDataFrame(rows, "doc_id long, text string, route_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_repetition_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(not (r.base_failed and r.kept) for r in got)
    want = sorted(((i, *plain_counts(x)) for i, x, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want


def test_maximal_repeats_equal_plain_ones():
    import numpy as np

    pick = random.Random(11)
    for _ in range(200):
        s = [pick.randint(0, pick.choice([0, 1, 3, 8])) for _ in range(pick.randint(0, 30))]
        order, lcp = repetition.suffix_array(np.array(s, np.int64))
        assert list(order) == sorted(range(len(s)), key=lambda i: s[i:])
        want = set()
        for n in range(2, len(s)):
            at = defaultdict(list)
            for i in range(len(s) - n + 1):
                at[tuple(s[i : i + n])].append(i)
            want |= {(w, len(p)) for w, p in at.items() if len(p) > 1 and len({s[i - 1] if i else -1 for i in p}) > 1 and len({s[i + n] if i + n < len(s) else -1 for i in p}) > 1}
        assert {(tuple(s[i : i + n]), c) for i, n, c in repetition.maximal_repeats(np.array(s), order, lcp, 2)} == want


def test_repetition_of_plans(spark, plan_lines):
    text = plan_lines.groupBy("route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wp_index", "line"))), lambda x: x["line"]), "\n").alias("plan_text"))
    stuck = text.filter("route_id = 1").select(F.lit(9).cast("long").alias("route_id"), F.repeat(F.concat("plan_text", F.lit("\nhold at anchor until the pilot is on board and ice allows\n")), 4).alias("plan_text"))
    rows = {r.route_id: r for r in repetition.repetition(text.unionByName(stuck), repetition.Rules(least_words=1)).collect()}
    assert rows[1].kept and not rows[9].kept and rows[9].longest_repeat > 12 and rows[9].n_dup_lines > 0
    half = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(60)) + " mark " + " ".join(f"b{i}" for i in range(300)) + " " + " ".join(f"a{i}" for i in range(45)))], "route_id long, plan_text string")
    r = repetition.repetition(half, repetition.Rules(repeat_percent=100)).first()
    assert not r.base_failed and not r.kept and r.longest_repeat == 45 and [tuple(x) for x in r.repeat_spans] == [(0, 45), (361, 45)]
