"""Language of texts by nearest centroids (operator 3).

Letter n-grams (one to three, within words) are hashed, weighted by TF-IDF and normalised to length one. Spherical k-means gives several
centroids per language; a text takes the language of the centroid with the largest cosine and is marked as rejected when
it lies further from that centroid than nearly all texts the centroid was made of.

Records: the engine stores no free remarks, so the operator runs on any (id, text) table; its defaults are those of
passage plans (``route_id``, ``plan_text``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaway.llm.texts import code_points, letter_table, small_batches
from seaway.session import cut

BITS = 13  # n-grams are hashed into 2**BITS slots
SLOTS = 1 << BITS
SLICE = 1 << 20  # code points worked on at a time
BROADCAST_LANGS = 10_000  # more languages than these are joined by shuffle
GROUP = 128  # texts compared with the centroids at a time


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed letter n-grams of a whole text; None if it has no letter."""
    if not text:
        return None
    table, counts, some = letter_table(), np.zeros(SLOTS, np.int64), False
    for i in range(0, len(text), SLICE):
        x = table[code_points(text[max(0, i - 2) : i + SLICE])].astype(np.uint32)
        x = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]])
        letter = x != 32
        if not letter.any():
            continue
        some = True
        own = 1 + (2 if i else 0)  # grams that end in the overlap were counted before
        h = x * np.uint32(0x9E3779B1)
        pair = (h[:-1] ^ (x[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        triple = (pair[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        pair, triple = pair ^ (pair >> np.uint32(15)), triple ^ (triple >> np.uint32(15))
        two = letter[:-1] | letter[1:]
        three = letter[1:-1] & (letter[:-2] | letter[2:])
        ends = np.arange(len(x)) >= own
        found = np.concatenate([(h >> np.uint32(32 - BITS))[letter & ends], (pair * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))[two & ends[1:]], (triple * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))[three & ends[2:]]])
        counts += np.bincount(found, minlength=SLOTS)
    return counts if some else None


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """Inverse document frequencies, unit centroids with their languages, and the least cosine each centroid accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    floors: np.ndarray

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine, rejected) of every text; (``und``, 0, True) without letters."""
        rows: list[np.ndarray | None] = []
        for t in texts:
            rows.append(gram_counts(t))
            if len(rows) == GROUP:
                yield from self._of(rows)
                rows = []
        yield from self._of(rows)

    def _of(self, rows: list[np.ndarray | None]) -> Iterator[tuple[str, float, bool]]:
        full = [r for r in rows if r is not None]
        if full and self.langs:
            cos = _vectors(np.array(full), self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            top = np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)
        k = 0
        for r in rows:
            if r is None or not self.langs:
                yield "und", 0.0, True
            else:
                yield self.langs[best[k]], float(top[k]), bool(top[k] < self.floors[best[k]])
                k += 1


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from the mean direction and the rows least like the chosen ones, so no chance is involved."""
    mean = x.mean(axis=0)
    centre = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    near = x @ centre[0]
    while len(centre) < min(k, len(x)):
        centre.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centre[-1])
    c = np.array(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit_language(plans: DataFrame, plan_id: str = "route_id", plan_text: str = "plan_text", lang: str = "lang", per_lang: int = 400,
                 centroids: int = 4, tail: float = 0.002) -> LanguageModel:
    """Learn from plans with a language; plans without text or language take no part.

    Document frequencies cover all these plans (each task adds up its own and hands on one count per slot). The centroids
    of a language come from about ``per_lang`` of its plans, chosen by a hash of their id (the documented bound); each
    language is clustered in a task of its own. ``tail`` is the share of the sample that a centroid's floor may reject.
    """
    x = small_batches(plans).filter(F.col(lang).isNotNull() & F.col(plan_text).isNotNull()).select(F.col(plan_id).alias("_id"), F.col(plan_text).alias("_t"), F.col(lang).cast("string").alias("_l"))

    def frequencies(batches):
        df, n = np.zeros(SLOTS, np.int64), 0
        for pdf in batches:
            for t in pdf["_t"]:
                c = gram_counts(t)
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"slot": np.append(at, -1).astype(np.int32), "n": np.append(df[at], n)})

    freq = x.select("_t").mapInPandas(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total = int(freq.n[freq.slot == -1].sum())
    if not total:
        return LanguageModel(np.zeros(SLOTS, np.float32), np.zeros((0, SLOTS), np.float32), (), np.zeros(0))
    df = np.zeros(SLOTS)
    df[freq.slot[freq.slot >= 0]] = freq.n[freq.slot >= 0]
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)

    narrow = x.select("_id", "_l")
    # a handful of languages is broadcast, so that texts stay where they are; the count is checked
    share = narrow.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")).select("_l", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("_n")).alias("_share"))
    chance = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGS else share
    chosen = x.join(share, "_l").filter(chance < F.col("_share")).select("_t", "_l")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [c for c in (gram_counts(t) for t in pdf["_t"].sort_values()[: 4 * per_lang]) if c is not None]
        if not rows:
            return pd.DataFrame({"lang": [], "k": [], "floor": [], "vector": []}).astype({"k": "int32", "floor": "float64"})
        v = np.concatenate([_vectors(np.array(rows[i : i + GROUP]), idf) for i in range(0, len(rows), GROUP)])
        c = _spherical_kmeans(v, centroids)
        cos = v @ c.T
        own = cos.argmax(axis=1)
        floor = [float(np.quantile(cos[own == j, j], tail)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["_l"].iloc[0], "k": np.arange(len(c), dtype=np.int32), "floor": floor, "vector": [r.astype(np.float32).tobytes() for r in c]})

    got = cut(chosen).groupBy("_l").applyInPandas(cluster, "lang string, k int, floor double, vector binary").orderBy("lang", "k").toPandas()
    return LanguageModel(idf, np.array([np.frombuffer(v, np.float32) for v in got.vector]).reshape(-1, SLOTS), tuple(got.lang), got.floor.to_numpy())


def predict_language(plans: DataFrame, model: LanguageModel, plan_text: str = "plan_text") -> DataFrame:
    """``plans`` with ``lang_pred``, ``lang_score`` (cosine, 0..1) and ``lang_rejected``.

    Texts that are null, empty or without a letter get ``und``, 0 and true. Rejection leaves the nearest language in
    ``lang_pred``. All rows and columns stay; columns of these names are replaced. One pass, no shuffle.
    """

    @F.pandas_udf("lang string, score double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(model.predict(texts)), columns=["lang", "score", "rejected"]).astype({"lang": object, "score": "float64", "rejected": bool})

    x = small_batches(plans).withColumn("_seaway_guess", guess(F.col(plan_text)))
    return x.withColumns({"lang_pred": F.col("_seaway_guess.lang"), "lang_score": F.col("_seaway_guess.score"), "lang_rejected": F.col("_seaway_guess.rejected")}).drop("_seaway_guess")
