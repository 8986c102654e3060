"""Fingerprints of texts by Order MinHash (operator 4).

For each of several hash functions the least occurrence-numbered k-mers of a text are selected, put back in text order and
hashed as a tuple (Marcais et al. 2019). The share of equal components of two fingerprints falls with the edit distance
of the texts, and unlike plain MinHash it notices moved passages and repeats.

Records: the engine stores no free remarks, so the operator runs on any (id, text) table; its defaults are those of
passage plans (``route_id``, ``plan_text``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from seaway.llm.shingles import mix
from seaway.llm.texts import code_points, small_batches
from seaway.session import cut

PLACE = np.uint64(24)  # bits for positions in the packed sort; longer texts take a plain stable sort
PIECE = 2048  # k-mers put through all hash functions at a time


class OrderMinHash:
    """``sketches`` tuples of ``picks`` k-mers of ``k`` code points each."""

    def __init__(self, k: int = 6, picks: int = 2, sketches: int = 32):
        self.k, self.picks, self.sketches = k, picks, sketches
        self.seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None]

    def numbered(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every (k-mer, occurrence number) and its position; texts shorter than k are one k-mer, empty ones none."""
        n = len(points)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k = min(self.k, n)
        p = points.astype(np.uint64)
        h = p[: n - k + 1] + np.uint64(1)
        for j in range(1, k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + p[j : n - k + 1 + j]
        h = mix(h + np.uint64(k))
        # hash in front, position behind: one sort brings equal k-mers together in text order
        gram, bits = h >> PLACE, np.uint64(1 << int(PLACE)) - np.uint64(1)
        if len(h) <= int(bits):
            packed = np.sort((gram << PLACE) | np.arange(len(h), dtype=np.uint64))
            gram, place = packed >> PLACE, (packed & bits).astype(np.int64)
        else:
            place = np.argsort(gram, kind="stable")
            gram = gram[place]
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        order = np.arange(len(gram))
        occurrence = order - np.maximum.accumulate(np.where(first, order, 0))
        return mix(gram * np.uint64(0xD6E8FEB86659FD93) + occurrence.astype(np.uint64)), place

    def components(self, text: str) -> np.ndarray:
        """One 32-bit number per sketch; zeros for a text without characters."""
        h, place = self.numbered(code_points(text))
        if not len(h):
            return np.zeros(self.sketches, np.uint32)
        m = min(self.picks, len(h))
        rows = np.arange(self.sketches)
        low = np.full((self.sketches, m), np.iinfo(np.uint64).max, np.uint64)
        at = np.zeros((self.sketches, m), np.int64)
        for i in range(0, len(h), PIECE):
            x = (h[None, i : i + PIECE] ^ self.seeds) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            part, where = [], []
            for _ in range(min(m, x.shape[1])):
                j = x.argmin(axis=1)
                part.append(x[rows, j])
                where.append(i + j)
                x[rows, j] = np.iinfo(np.uint64).max
            low, at = np.concatenate([low, np.array(part).T], axis=1), np.concatenate([at, np.array(where).T], axis=1)
            keep = np.argsort(low, axis=1, kind="stable")[:, :m]
            low, at = np.take_along_axis(low, keep, 1), np.take_along_axis(at, keep, 1)
        chosen, where = h[at], place[at]
        chosen = np.take_along_axis(chosen, np.argsort(where, axis=1, kind="stable"), 1)  # back in text order
        out = np.full(self.sketches, np.uint64(m), np.uint64)
        for j in range(m):
            out = mix(out * np.uint64(0xD1342543DE82EF95) + chosen[:, j])
        return (out >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self, text: str | None) -> str:
        """Hexadecimal form, eight digits per component."""
        return self.components(text or "").astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal components of two fingerprints."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    return float((np.frombuffer(x, ">u4") == np.frombuffer(y, ">u4")).mean()) if x and len(x) == len(y) else 0.0


def fingerprints(plans: DataFrame, plan_text: str = "plan_text", k: int = 6, picks: int = 2, sketches: int = 32) -> DataFrame:
    """``plans`` with ``fingerprint``. Null counts as empty; equal texts have equal fingerprints; a column of that name is replaced. One pass, no shuffle."""
    omh = OrderMinHash(k, picks, sketches)

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([omh.fingerprint(t) for t in texts], dtype=object)

    return small_batches(plans).withColumn("fingerprint", F.pandas_udf(made, StringType())(F.col(plan_text)))


def fingerprint_likeness(a: Column | str, b: Column | str) -> Column:
    """Column form of ``likeness``; null if either is null."""

    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(made, DoubleType())(a, b)


def _compared(omh: OrderMinHash, text: str, own: np.ndarray, after: str, next_parts: np.ndarray) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    parts = omh.components(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    same = lambda a, b: float((a == b).mean())
    return n, sha, own.astype(">u4").tobytes().hex(), parts.astype(">u4").tobytes().hex(), same(own, parts), same(own, next_parts)


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def edited_fingerprints(plans: DataFrame, plan_id: str = "route_id", plan_text: str = "plan_text", k: int = 6, picks: int = 2, sketches: int = 32) -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next text: how the signature follows edits.

    The edited text replaces the last ``floor(n_chars / 4)`` code points by the first as many of the next text in ascending
    order of id (the last one is followed by the first). Null counts as empty; ids that repeat are ordered by text; a null id
    comes first. Result: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts are shuffled once, into ranges of ids, and each range is read as a stream with one text of memory. The last text of
    a range meets the first of the next range in a small second step.
    """
    omh = OrderMinHash(k, picks, sketches)
    kind = plans.schema[plan_id].dataType.simpleString()
    x = small_batches(plans).select(F.col(plan_id).alias("id"), F.coalesce(F.col(plan_text), F.lit("")).alias("text"))
    x = x.repartitionByRange("id").sortWithinPartitions("id", "text")

    def stream(batches):
        part, last, first = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                own = omh.components(t)
                if last is None:
                    first = t
                else:
                    rows.append((part, None, None, last[0], *_compared(omh, last[1], last[2], t, own)))
                last = (i, t, own)
            yield pd.DataFrame(rows, columns=["part", "head", "tail", "id", *NAMES]).astype({"id": pdf["id"].dtype})
        if last is not None:
            yield pd.DataFrame([(part, first, last[1], last[0], *[None] * len(NAMES))], columns=["part", "head", "tail", "id", *NAMES])

    done = cut(x.mapInPandas(stream, f"part int, head string, tail string, id {kind}, {FIELDS}"))
    seams = done.filter("head is not null").select("part", "head", "tail", "id")
    parts = sorted(r[0] for r in seams.select("part").collect())  # one number per range
    if not parts:
        return done.select(F.col("id").alias(plan_id), *NAMES)
    follow = F.create_map(*[F.lit(v) for a, b in zip(parts, [*parts[1:], parts[0]], strict=True) for v in (a, b)])
    heads = seams.select(F.col("part").alias("follower"), F.col("head").alias("after"))
    met = seams.withColumn("follower", follow[F.col("part")]).join(heads, "follower").select("id", "tail", "after")

    def finish(batches):
        for pdf in batches:
            rows = [(i, *_compared(omh, t, omh.components(t), a, omh.components(a))) for i, t, a in zip(pdf["id"], pdf["tail"], pdf["after"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *NAMES])

    ends = met.mapInPandas(finish, f"id {kind}, {FIELDS}")
    return done.filter("head is null").select("id", *NAMES).unionByName(ends).withColumnRenamed("id", plan_id)
