"""Near copies of texts by MinHash and a multi-index Hamming join (operator 9).

A text's signature is a row of b-bit minima of its shingle set. Signatures are split into chunks; by the pigeonhole
principle two signatures with at most ``chunks * (errors + 1) - 1`` differing symbols have a chunk with at most ``errors``
differing ones. Every chunk is therefore indexed once for each choice of ``errors`` symbols left out, and all pairs within
that distance share a key. Pairs that share a key are confirmed on their full shingle sets.

Pairs within a group are not emitted: each member of a bucket is first compared with one leader, which joins nearly all of a
group of near copies. What shares a bucket but no component after that is compared in bounded tiles, so that no link between
different components is lost.

Records: the engine stores no free remarks, so the operator runs on any (id, text) table; its defaults are those of
passage plans (``route_id``, ``plan_text``).
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaway.llm.shingles import mix, shingle_set
from seaway.llm.texts import small_batches
from seaway.operators.graph import connected_components
from seaway.session import cut

LENGTH, ERRORS = 72, 1  # symbols of a signature; symbols of a chunk that may differ
MISSED, BEYOND = 3e-6, 1e-7  # of pairs at the similarity: chance to share no key, chance to differ in more symbols than are compared
SYMBOL = np.uint16
BROADCAST_IDS = 1_000_000  # ids of candidate texts that are broadcast; more are joined by shuffle
BROADCAST_KEYS = 2_000_000  # keys of larger buckets that are broadcast; more are joined by shuffle
BROADCAST_SHINGLES = 4_000_000  # shingles of candidate sets (32 MB) that are broadcast; more are joined by shuffle
TILE = 200_000  # shingles on each side of a tile of strays and family, about
_SEEDS = mix(np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def layout(percent: int) -> tuple[int, int]:
    """(chunks, most differing symbols) for a similarity: the fewest chunks that lose less than ``MISSED`` of the pairs at ``percent``.

    At 80 and more these are 12 chunks of 6 symbols, so that every pair with at most 23 different ones shares a key, at 60 and 50
    24 chunks of 3. Symbols of a pair at the similarity agree with its probability, each for itself; more similar
    pairs are lost less often. Below 17 percent no chunk holds the bound, which is an error.
    """
    same = percent / 100
    for size in (6, 4, 3, 2):
        held = sum(comb(size, e) * (1 - same) ** e * same ** (size - e) for e in range(ERRORS + 1))
        if (1 - held) ** (LENGTH // size) <= MISSED:
            break
    else:
        raise ValueError("percent must be 17 or more: less similar sets rarely share a key")
    chances = [comb(LENGTH, i) * (1 - same) ** i * same ** (LENGTH - i) for i in range(LENGTH + 1)]
    far = next(f for f in range(LENGTH + 1) if sum(chances[f + 1 :]) <= BEYOND)
    return LENGTH // size, far


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bits of the least hash of the set under each of the hash functions."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        h = (shingles[None, i : i + 1024] ^ _SEEDS) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = np.minimum(low, h.min(axis=1))
    return mix(low).astype(SYMBOL)


def chunk_keys(signatures: np.ndarray, chunks: int, errors: int = ERRORS) -> np.ndarray:
    """Keys of each signature: one for every chunk and every choice of ``errors`` symbols of it left out. Shape (rows, keys)."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), chunks, -1)
    keys = []
    for out in combinations(range(parts.shape[2]), errors):
        h = np.full(parts.shape[:2], np.uint64(len(keys) + 1), np.uint64)
        for j in range(parts.shape[2]):
            if j not in out:
                h = mix(h * np.uint64(0xD1342543DE82EF95) + parts[:, :, j] + np.uint64(1))
        keys.append(mix(h + np.arange(chunks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(keys, axis=1)


def shingle_signatures(plans: DataFrame, words: int, plan_id: str = "route_id", plan_text: str = "plan_text") -> DataFrame:
    """(id, n_shingles, set_key, signature) of every text; ``set_key`` is the same exactly for equal sets, and null for empty ones."""
    kind = plans.schema[plan_id].dataType.simpleString()

    def made(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(t, words)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                rows.append((i, len(s), key, signature(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["id", "n_shingles", "set_key", "signature"])

    x = small_batches(plans).select(F.col(plan_id).alias("id"), F.col(plan_text).alias("text"))
    x = x.filter("id is not null")
    return x.mapInPandas(made, f"id {kind}, n_shingles long, set_key binary, signature binary")


def _keys(classes: DataFrame, chunks: int) -> DataFrame:
    """(key, id) of every class under every key of its signature."""
    kind = classes.schema["id"].dataType.simpleString()

    def made(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf[i : i + 2000]
                sig = np.frombuffer(b"".join(part.signature), SYMBOL).reshape(len(part), -1)
                yield pd.DataFrame({"id": part["id"], "keys": list(chunk_keys(sig, chunks).view(np.int64))})

    x = classes.select("id", "signature").mapInPandas(made, f"id {kind}, keys array<long>")
    return x.select(F.explode("keys").alias("key"), "id")


def _small(x: DataFrame, most: int) -> DataFrame:
    """``x`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(x) if x.count() <= most else x


class _Search:
    """The links between classes of equal sets, found step by step. ``groups``: (id, component_id) so far."""

    def __init__(self, plans: DataFrame, classes: DataFrame, words: int, percent: int, plan_id: str, plan_text: str):
        self.plans = plans.select(F.col(plan_id).alias("id"), F.col(plan_text).alias("text"))
        self.classes, self.words, self.percent = classes, words, percent
        self.far = layout(percent)[1]
        self.kind = classes.schema["id"].dataType.simpleString()
        self.groups = classes.select("id", F.col("id").alias("component_id")).distinct()

    def fits(self, common, na, nb):
        """The similarity test for a given size of the intersection."""
        return F.lit(100) * common >= F.lit(self.percent) * (na + nb - common)

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, s): the full shingle sets of some texts."""
        words = self.words

        def made(batches):
            for pdf in batches:
                for i in range(0, len(pdf), 500):
                    part = pdf[i : i + 500]
                    yield pd.DataFrame({"id": part["id"], "s": [shingle_set(t, words).view(np.int64) for t in part["text"]]})

        x = self.plans.join(_small(ids, BROADCAST_IDS), "id", "left_semi")
        return x.mapInPandas(made, f"id {self.kind}, s array<long>")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that can still be links by their sizes and by the distance of their signatures."""
        c = self.classes.select("id", "n", "signature")
        x = pairs.join(c.withColumnsRenamed({"id": "a", "n": "na", "signature": "sa"}), "a").join(c.withColumnsRenamed({"id": "b", "n": "nb", "signature": "sb"}), "b")
        x = x.filter(self.fits(F.least("na", "nb"), F.col("na"), F.col("nb")))
        far = self.far

        def made(batches):
            for pdf in batches:
                if len(pdf):
                    one, two = (np.frombuffer(b"".join(pdf[c]), SYMBOL).reshape(len(pdf), -1) for c in ("sa", "sb"))
                    yield pdf.loc[(one != two).sum(axis=1) <= far, ["a", "b", "na", "nb"]]

        return x.mapInPandas(made, f"a {self.kind}, b {self.kind}, na long, nb long")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b) on their full sets and join the components of those that are links."""
        pairs = cut(self.near(pairs))
        ids = cut(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("na").alias("n")), F.struct(F.col("b").alias("id"), F.col("nb").alias("n")))).alias("e")).select("e.*").distinct())
        total = ids.agg(F.sum("n")).first()[0] or 0
        if not total:
            return
        sets = cut(self.sets(ids.select("id")))
        sets = F.broadcast(sets) if total <= BROADCAST_SHINGLES else sets
        x = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
        self.join(x.filter(self.fits(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b"))

    def join(self, links: DataFrame) -> None:
        """Join the components of linked classes; the graph that is walked is that of components, not of texts."""
        g = self.groups
        ends = links.join(g.withColumnsRenamed({"id": "a", "component_id": "src"}), "a").join(g.withColumnsRenamed({"id": "b", "component_id": "dst"}), "b")
        ends = cut(ends.filter("src <> dst").select("src", "dst").distinct())
        nodes = ends.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        named = connected_components(nodes, ends).select(F.col("component_id").alias("new"), F.col("node_id").alias("component_id"))
        self.groups = cut(g.join(named, "component_id", "left").select("id", F.coalesce("new", "component_id").alias("component_id")))

    def rest(self, members: DataFrame) -> DataFrame:
        """Links between texts that share a bucket but not yet a component; every such pair is compared on full sets.

        A text outside the largest component of its bucket is a stray of that component, its family. The strays of a family are
        compared with each other and with the members whose buckets hold strays, in tiles of about ``TILE`` shingles a side: a tile counts common
        shingles as a matrix product and hands on only links, one for each stray and component. A family of any size is many tiles.
        """
        x = members.join(self.groups, "id").select("key", "id", "component_id")
        size = x.groupBy("key", "component_id").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component_id")).alias("top"))
        tops = size.filter("parts > 1").select("key", F.col("top.component_id").alias("family"))
        strays = cut(x.join(tops, "key").filter("component_id <> family").select("family", "id", "component_id").distinct())
        own = x.join(tops, "key").filter("component_id = family").select("family", "id", "component_id").distinct()
        rows = strays.withColumn("stray", F.lit(True)).unionByName(own.withColumn("stray", F.lit(False)))
        rows = cut(rows.join(self.classes.groupBy("id").agg(F.max("n").alias("n")), "id"))
        blocks = lambda flag: F.ceil(F.sum(F.when(F.col("stray") == flag, F.col("n")).otherwise(0)) / float(TILE)).cast("int")
        rows = rows.join(rows.groupBy("family").agg(blocks(True).alias("bs"), blocks(False).alias("bm")), "family")
        rows = rows.join(self.sets(rows.select("id").distinct()), "id")
        block = F.pmod(F.xxhash64("id"), F.when(F.col("stray"), F.col("bs")).otherwise(F.col("bm"))).cast("int")
        count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        tile = lambda kind, left, right, on_left: F.struct(F.lit(kind).alias("kind"), left.alias("l"), right.alias("r"), on_left.alias("on_left"))
        b = F.col("_b")
        among = F.transform(count("bs"), lambda i: tile(0, F.least(b, i), F.greatest(b, i), b <= i))
        across = F.transform(count("bm"), lambda i: tile(1, b, i, F.lit(True)))
        against = F.transform(count("bs"), lambda i: tile(1, i, b, F.lit(False)))
        rows = rows.withColumn("_b", block).select("family", "id", "component_id", "s", F.explode(F.when(F.col("stray"), F.concat(among, across)).otherwise(against)).alias("t"))
        rows = rows.select("family", "t.*", "id", "component_id", "s")
        percent = self.percent

        def linked(pdf: pd.DataFrame) -> pd.DataFrame:
            alone = pdf["kind"].iloc[0] == 0 and pdf["l"].iloc[0] == pdf["r"].iloc[0]
            one, two = pdf[pdf["on_left"]], pdf if alone else pdf[~pdf["on_left"]]
            found = []
            for i in range(0, len(one), 256):
                for j in range(0, len(two), 256):
                    found += _tile(one[i : i + 256], two[j : j + 256], percent)
            return pd.DataFrame(found, columns=["a", "b"]) if found else pdf[:0].rename(columns={"id": "a"})[["a"]].assign(b=pdf["id"][:0])

        return rows.groupBy("family", "kind", "l", "r").applyInPandas(linked, f"a {self.kind}, b {self.kind}")


def _tile(one: pd.DataFrame, two: pd.DataFrame, percent: int) -> list[tuple]:
    """Links between two lists of texts of different components: for each text of the first, one per component of the second."""
    if not len(one) or not len(two):
        return []
    sets = [np.concatenate(list(x["s"])) for x in (one, two)]
    both = np.intersect1d(*sets)  # only shingles that both sides hold can be common
    if not len(both):
        return []
    held = []
    for x, flat in zip((one, two), sets, strict=True):
        n = x["s"].map(len).to_numpy()
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        inside = both[at] == flat
        m = np.zeros((len(x), len(both)), np.float32)
        m[np.repeat(np.arange(len(x)), n)[inside], at[inside]] = 1
        held.append((m, n))
    common = np.rint(held[0][0] @ held[1][0].T).astype(np.int64)
    union = held[0][1][:, None] + held[1][1][None, :] - common
    ca, cb = one["component_id"].to_numpy(), two["component_id"].to_numpy()
    i, j = np.nonzero((100 * common >= percent * union) & (ca[:, None] != cb[None, :]))
    got = {(int(a), cb[b]): (one["id"].iloc[a], two["id"].iloc[b]) for a, b in zip(i, j, strict=True)}
    return list(got.values())


def ordered(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).filter("a < b").distinct()


def near_copies(plans: DataFrame, words: int = 5, percent: int = 80, plan_id: str = "route_id", plan_text: str = "plan_text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every text: near copies share a component, named by its smallest id.

    Two texts are linked if ``100 * |intersection| >= percent * |union|`` of their sets of ``words``-word shingles. Texts with
    fewer words are one shingle; null texts and texts without words have none and link with nothing. ``kept`` marks the text
    that names its component. Rows with a null id get component null and are kept. Rows that
    repeat an id are linked if any of their texts are. Equal sets are one class (found by key), so copies make no pairs.
    Other columns of ``plans`` are not used.

    A link is lost only if two sets differ in two or more symbols of every chunk (less than three in a million at the
    similarity) or in more symbols than ``layout`` allows (less than one in ten million). Both follow ``percent``, which must
    be 17 to 100; below that a ``ValueError`` is raised.
    """
    chunks, _ = layout(percent)
    signed = cut(shingle_signatures(plans, words, plan_id, plan_text))
    classes = cut(signed.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    search = _Search(plans, classes, words, percent, plan_id, plan_text)
    shared = cut(_keys(classes, chunks).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    members = cut(_keys(classes, chunks).join(_small(shared.filter("m > 2").select("key", "lo"), BROADCAST_KEYS), "key"))
    pairs = shared.filter("m = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(members.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")))
    search.confirm(ordered(pairs, "a", "b"))
    search.join(search.rest(members.select("key", "id")))
    return _labelled(plans, signed, classes, search.groups, plan_id)


def _labelled(plans: DataFrame, signed: DataFrame, classes: DataFrame, groups: DataFrame, plan_id: str) -> DataFrame:
    named = classes.select("set_key", "id").join(groups, "id").select("set_key", "component_id")
    x = signed.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    x = x.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    x = x.withColumn("kept", F.col("id") == F.col("component_id"))
    lost = plans.filter(F.col(plan_id).isNull()).select(F.col(plan_id).alias("id"), F.lit(None).cast("long").alias("n_shingles"), F.col(plan_id).alias("component_id"), F.lit(True).alias("kept"))
    return x.unionByName(lost).withColumnRenamed("id", plan_id)
