"""Near copies, fingerprints, neighbours against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaway.llm import fingerprints as fp
from seaway.llm import near_copies as nc
from seaway.llm import neighbours
from seaway.llm.shingles import shingle_set, word_hashes

PLAN = "route_id long, plan_text string"


def plain_set(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    n = min(words, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def plain_groups(rows, words, percent):
    sets = {i: plain_set(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(90):  # one family whose members differ by 0 to 9 words: links, and strays
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(90, 140):
        rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))))
    rows += [(200 + i, rows[i][1].upper()) for i in range(0, 60, 7)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "x " * 50_000), (306, "x\n" * 50_001)]
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies_equal_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(nc, "TILE", 1500)  # several tiles a family
    rows = family_rows(words)
    got = nc.near_copies(spark.createDataFrame([(*r, "clash") for r in rows], PLAN + ", component_id string"), words, 80)
    assert got.columns == ["route_id", "n_shingles", "component_id", "kept"]
    got = {r.route_id: r for r in got.collect()}
    want = plain_groups(rows, words, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.route_id == r.component_id) for r in got.values())


def test_near_copies_without_broadcasts(spark, monkeypatch):
    for name in ("BROADCAST_IDS", "BROADCAST_KEYS", "BROADCAST_SHINGLES"):
        monkeypatch.setattr(nc, name, 0)
    rows = family_rows(8)
    got = nc.near_copies(spark.createDataFrame(rows, PLAN), 2, 80)
    assert {r.route_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain_groups(rows, 2, 80)


def test_near_copies_of_empty_null_and_repeated_ids(spark):
    assert nc.near_copies(spark.createDataFrame([], PLAN), 2, 80).count() == 0
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (None, None)]
    got = nc.near_copies(spark.createDataFrame(rows, PLAN), 2, 80).collect()
    assert sorted((str(r.route_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 2 + [("2", "1", False)] + [("None", "None", True)] * 2


def test_pigeonhole_of_chunk_keys():
    rng = np.random.default_rng(3)
    chunks, _ = nc.layout(80)
    most = chunks * (nc.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, nc.LENGTH).astype(nc.SYMBOL)
        b = a.copy()
        at = rng.choice(len(b), most, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, most).astype(nc.SYMBOL)
        keys = nc.chunk_keys(np.array([a, b]), chunks)
        assert set(keys[0]) & set(keys[1])


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    shares = [float((nc.signature(np.unique(x[:1000])) == nc.signature(np.unique(x[k : 1000 + k]))).mean()) for k in (0, 111, 500)]
    assert shares[0] == 1 and abs(shares[1] - 0.8) < 0.15 and abs(shares[2] - 1 / 3) < 0.17


def test_word_hashes_follow_the_rule(monkeypatch):
    from seaway.llm import shingles

    text = "Ab aB\tÄb äb\x0bx y z" + " long" * 50
    whole = word_hashes(text)
    assert whole[0] == whole[1] and whole[2] != whole[3] and len(whole) == 6 + 50
    monkeypatch.setattr(shingles, "SEGMENT", 16)
    assert (word_hashes(text) == whole).all()
    assert (word_hashes("y" * 100 + " b") == word_hashes("y" * 100 + "\nb")).all()
    assert len(shingle_set("a b a b a b", 2)) == 2 and len(shingle_set("a", 5)) == 1 and len(shingle_set(None, 2)) == 0


def plain_omh(text, k, picks, seeds):
    from seaway.llm.shingles import mix

    o = fp.OrderMinHash(k, picks, len(seeds))
    h, place = o.numbered(fp.code_points(text))
    out = []
    for s in o.seeds[:, 0]:
        x = (h ^ s) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        best = sorted(range(len(h)), key=lambda i: x[i])[: min(picks, len(h))]
        t = np.full(1, np.uint64(len(best)), np.uint64)
        for i in sorted(best, key=lambda i: place[i]):
            t = mix(t * np.uint64(0xD1342543DE82EF95) + h[i])
        out.append(int(t[0] >> np.uint64(32)))
    return out


def test_order_minhash_equals_plain_form(monkeypatch):
    monkeypatch.setattr(fp, "PIECE", 16)
    o = fp.OrderMinHash(3, 2, 8)
    for text in ("abcabcabcabc" * 5, "north by north-west", "ab", "a"):
        assert o.components(text).tolist() == plain_omh(text, 3, 2, range(8))
    assert o.components("").tolist() == [0] * 8


def test_occurrences_and_order_count():
    o = fp.OrderMinHash(4, 2, 64)
    h, place = o.numbered(fp.code_points("abcdabcdabcd"))
    assert len(set(h.tolist())) == len(h) and sorted(place.tolist()) == list(range(9))
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij") for _ in range(600))
    moved = base[300:] + base[:300]
    small = base[:250] + "XY" + base[252:]
    like = lambda t: fp.likeness(o.fingerprint(base), o.fingerprint(t))
    assert like(base) == 1 and like(small) > like(moved) > like("".join(reversed(base)))


def test_edited_fingerprints_in_id_order(spark):
    rng = random.Random(6)
    texts = {i * 3: "".join(rng.choice("abcä𝔘 ") for _ in range(rng.choice([0, 1, 3, 50, 200]))) for i in range(60)}
    texts[7] = None
    plans = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], PLAN + ", fingerprint string").repartition(5)
    got = {r.route_id: r for r in fp.edited_fingerprints(plans).collect()}
    order, o = sorted(texts), fp.OrderMinHash()
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[a] or "", texts[b] or ""
        m = len(t) // 4
        e = t[: len(t) - m] + n[:m]
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == o.fingerprint(t) and r.edited_fingerprint == o.fingerprint(e)
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fp.likeness(o.fingerprint(t), o.fingerprint(n))


def test_edited_fingerprints_of_small_tables(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], PLAN)).count() == 0
    one = fp.edited_fingerprints(spark.createDataFrame([(1, "abcdefgh")], PLAN)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    got = fp.edited_fingerprints(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], PLAN))
    assert got.count() == 3
    plain = fp.fingerprints(spark.createDataFrame([(1, None), (2, "")], PLAN)).select("fingerprint").distinct()
    assert plain.count() == 1


def brute_neighbours(rows, queries, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 3}
    out = []
    for q in queries:
        if q in ok:
            score = lambda i: sum(float(a) * float(b) for a, b in zip(ok[i], ok[q], strict=True))
            best = sorted((i for i in ok if i != q), key=lambda i: (-score(i), i))[:k]
            out += [(q, n + 1, i, score(i)) for n, i in enumerate(best)]
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 40)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 3)).astype(np.float32).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, v[5].tolist()) for i in range(40)]  # many copies of one vector
    rows += [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0, None, 0.0]), (2003, [float("nan"), 1.0, 1.0]), (2004, [1.0, 2.0]), (2005, [float("inf"), 0.0, 1.0]), (2006, []), (None, [1.0, 1.0, 1.0])]
    nodes = spark.createDataFrame([(*r, 0.5) for r in rows], "node_id long, position array<double>, score double")
    queries = nodes.filter("node_id % 20 = 0 or node_id in (5, 1003) or node_id >= 2000")
    got = neighbours.nearest(nodes, queries, k=7).orderBy("query_id", "rank").collect()
    want = brute_neighbours(rows, sorted(i for i, _ in rows if i is not None and (i % 20 == 0 or i in (5, 1003) or i >= 2000)), 7)
    assert [(r.query_id, r.rank, r.node_id) for r in got] == [w[:3] for w in want]
    assert [r.score for r in got] == [w[3] for w in want]


def test_neighbours_recall_when_relaxed_and_small_tables(spark):
    rng = np.random.default_rng(9)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 3)))]
    nodes = spark.createDataFrame(rows, "node_id long, position array<double>")
    want = {w[:3:2] for w in brute_neighbours(rows, range(0, 600, 20), 10)}
    got = {(r.query_id, r.node_id) for r in neighbours.nearest(nodes, nodes.filter("node_id % 20 = 0"), k=10, relax=1.4).collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert neighbours.nearest(nodes.limit(0), nodes, k=3).count() == 0
    assert neighbours.nearest(nodes.filter("node_id < 3"), nodes.filter("node_id = 0"), k=5).count() == 2
    assert neighbours.nearest(nodes, nodes.limit(0), k=3).count() == 0


@pytest.mark.parametrize("relax", [1.0, 1.4])
def test_neighbours_of_tied_vectors_go_to_the_smaller_id(spark, monkeypatch, relax):
    monkeypatch.setattr(neighbours, "SHARD", 200)
    rng = np.random.default_rng(5)
    ids = rng.permutation(np.arange(1, 1024))
    rows = [(int(i), [float(n >> b & 1) for b in range(10)]) for i, n in zip(ids, range(1, 1024), strict=True)]
    nodes = spark.createDataFrame(rows, "node_id long, position array<double>")
    asked = [20, 512]
    got = neighbours.nearest(nodes, nodes.filter(F.col("node_id").isin(asked)), k=20, relax=relax).orderBy("query_id", "rank").collect()
    v = dict(rows)
    want = []
    for q in asked:
        score = {i: sum(a * b for a, b in zip(v[i], v[q], strict=True)) for i in v if i != q}
        want += [(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:20])]
    if relax == 1.0:
        assert [tuple(r) for r in got] == want
    else:
        assert len({(r.query_id, r.node_id) for r in got} & {(w[0], w[2]) for w in want}) >= 36


@pytest.mark.parametrize("percent", [50, 60])
def test_links_of_other_similarities(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(150):  # pairs a little above and below the limit, by words that both texts or only one of them holds
        both = [f"w{i}x{j}" for j in range(percent + rng.randint(-3, 6))]
        own = 100 - len(both)
        cut = rng.randint(0, own)
        rows += [(2 * i, " ".join(both + [f"l{i}x{j}" for j in range(cut)])), (2 * i + 1, " ".join(both + [f"r{i}x{j}" for j in range(own - cut)]))]
    got = {r.route_id: (r.n_shingles, r.component_id) for r in nc.near_copies(spark.createDataFrame(rows, PLAN), words=1, percent=percent).collect()}
    assert got == plain_groups(rows, 1, percent)


def test_layouts_of_similarities():
    assert nc.layout(80) == (12, 34) and nc.layout(100) == (12, 0) and nc.layout(60)[0] == nc.layout(50)[0] == 24
    with pytest.raises(ValueError):
        nc.layout(10)
