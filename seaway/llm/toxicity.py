"""Toxicity of texts by a weighted lexicon (operator 6).

Texts are folded (case, look-alike letters of other scripts, digits and signs used as letters), the lexicon and its
exception phrases are found in one pass of an Aho-Corasick automaton, the weights of the hits are summed, divided by
the length in words and mapped to 0..1 by a logistic curve. Lexicon and curve are learned from graded plans.

Records: the engine stores no free remarks, so the operator runs on any (id, text) table; its defaults are those of
passage plans (``route_id``, ``plan_text``).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seaway.llm.texts import as_text, code_points, graded_sample, letter_table, logistic_1d, sigmoid, small_batches
from seaway.session import cut

STEM = range(4, 9)  # lengths of word beginnings that may become lexicon entries
SLICE = 1 << 20  # code points folded at a time


@dataclass(frozen=True)
class ToxicityModel:
    """Entries ``(folded text, is_stem, weight)``, exception phrases, and slope and offset of the curve."""

    entries: tuple[tuple[str, bool, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -4.0
    damping: float = 50.0
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": {}}

    def automaton(self):
        """The automaton, built once in each worker; None without entries."""
        if "a" not in self._made:
            import ahocorasick

            a = ahocorasick.Automaton()
            by: dict[str, list] = {}
            for text, stem, weight in self.entries:
                by.setdefault(" " + text, []).append((weight, stem, False))
            for phrase in self.exceptions:
                by.setdefault(" " + fold(phrase).strip(), []).append((0.0, False, True))
            for key, kinds in by.items():
                a.add_word(key, (len(key), kinds))
            if by:
                a.make_automaton()
            self._made["a"] = a if by else None
        return self._made["a"]

    def density(self, text: str | None) -> float:
        """Weight of the hits per 1,000 words; ``damping`` words are added to the length so that one hit in a short text stays moderate."""
        folded, words = folded_words(text or "")
        mass = self.mass(folded)
        return 1000.0 * mass / (words + self.damping)

    def mass(self, folded: str) -> float:
        a = self.automaton()
        if a is None or not folded:
            return 0.0
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, kinds) in a.iter(folded):
            start = end - length + 1
            for weight, stem, exception in kinds:
                if not stem and folded[end + 1] != " ":
                    continue
                if exception:
                    excused.append((start, end))
                else:
                    hits[start] = max(hits.get(start, 0.0), weight)
        if not excused:
            return sum(hits.values())
        spans = np.array(sorted(excused))
        reach = np.maximum.accumulate(spans[:, 1])  # how far the spans that begin up to here go
        at = np.fromiter(hits, np.int64, len(hits))
        last = np.searchsorted(spans[:, 0], at, side="right") - 1
        free = (last < 0) | (reach[np.maximum(last, 0)] < at)
        return float(np.fromiter(hits.values(), np.float64, len(hits))[free].sum())

    def score(self, densities: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.log1p(densities) + self.offset)


def fold(text: str) -> str:
    """Folded text: lower-case letters, everything else single spaces, one space at either end."""
    return folded_words(text)[0]


def folded_words(text: str) -> tuple[str, int]:
    """The folded text and its number of words; long texts are folded slice by slice."""
    if not text:
        return "  ", 0
    table, parts = letter_table(True), []
    for i in range(0, len(text), SLICE):
        parts.append(table[code_points(text[i : i + SLICE])])
    x = np.concatenate([[np.uint32(32)], *parts, [np.uint32(32)]])
    space = x == 32
    keep = ~(space[1:] & space[:-1])
    x = np.concatenate([x[:1], x[1:][keep]])
    return as_text(x), max(0, int((x == 32).sum()) - 1)


@F.pandas_udf(LongType())
def _family(texts: pd.Series) -> pd.Series:
    """The least hash of a text's three-word shingles: near copies nearly always share it."""

    def least(text: str) -> int:
        w = fold(text).split()
        return min((zlib.crc32(" ".join(x).encode("utf-8", "surrogatepass")) for x in zip(w, w[1:], w[2:], strict=False)), default=zlib.crc32(" ".join(w).encode("utf-8", "surrogatepass")))

    return pd.Series([least(t) for t in texts], dtype="int64")


def _terms(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Plans of each class that hold a term, summed within the batch: whole words and word beginnings."""
    for pdf in batches:
        seen: dict[tuple[str, bool], list[int]] = {}
        for text, grade in zip(pdf.plan_text, pdf.grade, strict=True):
            words = set(fold(text).split())
            found = {(w, False) for w in words if 3 <= len(w) <= 40}
            found |= {(w[:n], True) for w in words for n in STEM if len(w) > n}
            for f in found:
                seen.setdefault(f, [0, 0])[grade] += 1
        if seen:
            yield pd.DataFrame({"term": [k[0] for k in seen], "stem": [k[1] for k in seen], "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]})


def _neighbours(entries: Sequence[tuple[str, bool, float]], batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two-word phrases around lexicon words, by class."""
    words = {e[0] for e in entries if not e[1]}
    for pdf in batches:
        got: Counter = Counter()
        for text, grade in zip(pdf.plan_text, pdf.grade, strict=True):
            t = fold(text).split()
            got.update((p, grade) for p in {f"{a} {b}" for a, b in zip(t, t[1:], strict=False) if a in words or b in words})
        yield pd.DataFrame({"phrase": [k[0] for k in got], "grade": [k[1] for k in got], "n": list(got.values())}).astype({"phrase": object, "grade": "int32", "n": "int64"})


def fit_toxicity(plans: DataFrame, grades: DataFrame, plan_id: str = "route_id", plan_text: str = "plan_text", grade: str = "toxic",
                 per_class: int = 4000, support: int = 4, least_weight: float = 4.0, chance: float = 0.05, exceptions: Sequence[str] = ()) -> ToxicityModel:
    """Learn the lexicon, the exception phrases and the curve from graded plans.

    ``grades(plan_id, grade)`` marks plans with 1 (toxic) or 0. The fit reads at most ``per_class`` plans of each class,
    chosen by a hash of their id (the documented bound), and of near copies only one, so that chance words of a copied
    plan gain no support. A word, or a word beginning of 4 to 8 letters, enters the lexicon if at least ``support`` toxic plans
    hold it, its log odds reach ``least_weight`` and the odds are no accident: Chernoff's bound of the chance that a term held alike
    by both classes falls so one-sidedly stays below ``chance`` divided by the number of terms with that support. The
    support does not grow with the sample and no number of entries is set. Of nested beginnings the shortest whose odds are
    about as good stays. A two-word phrase around a lexicon
    word becomes an exception if at least ``support`` clean plans and no toxic plan hold it. Without toxic or clean
    examples the model has no entries and scores every text alike, below one half.
    """
    sample = graded_sample(small_batches(plans), grades, grade, per_class, plan_id, plan_text).withColumn("family", _family("plan_text"))
    sample = cut(sample.groupBy("grade", "family").agg(F.min("plan_text").alias("plan_text")).select("plan_text", "grade"))
    sizes = {r[0]: r[1] for r in sample.groupBy("grade").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(exceptions=tuple(exceptions))
    least_weight = min(least_weight, 0.75 * math.log(2 * (n0 + 1)))  # what few clean plans can show at all
    terms = sample.mapInPandas(_terms, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    terms = cut(terms.filter(F.col("toxic") >= support))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    held, base = F.col("toxic") + F.col("clean"), n1 / (n0 + n1)
    part = lambda n, p: F.when(n == 0, 0.0).otherwise(n * F.log(n / (held * p)))
    surprise = part(F.col("toxic"), base) + part(F.col("clean"), 1 - base)  # the Chernoff exponent of toxic plans among those that hold the term
    least = math.log(max(1, terms.count()) / chance)
    # only the lexicon itself reaches the driver
    rows = terms.withColumn("weight", odds).filter((F.col("weight") >= least_weight) & (surprise >= least)).collect()
    kept: dict[str, tuple[str, bool, float]] = {}
    stems: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term), not r.stem)):
        better = max((w for p, w in stems.items() if r.term.startswith(p)), default=None)
        if better is not None and better >= r.weight - 1.0:
            continue
        if r.stem:
            stems[r.term] = r.weight
        kept[f"{r.term}|{r.stem}"] = (r.term, r.stem, float(r.weight))
    chosen = sorted(kept.values(), key=lambda e: (-e[2], e[0], e[1]))
    near = sample.mapInPandas(lambda b: _neighbours(chosen, b), "phrase string, grade int, n long")
    near = near.groupBy("phrase").agg(F.sum(F.when(F.col("grade") == 0, F.col("n"))).alias("c"), F.sum(F.when(F.col("grade") == 1, F.col("n"))).alias("t"))
    excused = [r[0] for r in near.filter((F.col("c") >= support) & F.col("t").isNull()).orderBy(F.desc("c"), "phrase").collect()]
    model = ToxicityModel(tuple(chosen), tuple(dict.fromkeys([*exceptions, *excused])))

    def densities(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [model.density(t) for t in pdf.plan_text], "y": pdf.grade.to_numpy()}).astype({"x": "float64", "y": "int32"})

    xy = sample.mapInPandas(densities, "x double, y int").toPandas()
    slope, offset = logistic_1d(np.log1p(xy.x.to_numpy()), xy.y.to_numpy())
    return ToxicityModel(model.entries, model.exceptions, max(slope, 1e-6), offset)


def score_toxicity(plans: DataFrame, model: ToxicityModel, plan_text: str = "plan_text", threshold: float = 0.7) -> DataFrame:
    """``plans`` with ``toxicity`` (0..1) and ``is_toxic`` (at or above ``threshold``).

    Null and empty texts have no hits and get the score of density 0. All rows and columns stay; columns of these two
    names are replaced. Equal texts get equal scores. One pass, no shuffle.
    """

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([model.density(t) for t in texts], dtype=np.float64)))

    x = small_batches(plans).withColumn("toxicity", toxicity(F.col(plan_text)))
    return x.withColumn("is_toxic", F.col("toxicity") >= threshold)
