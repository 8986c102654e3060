"""Quality of texts by naive Bayes support vectors (operator 1).

N-gram indicators are scaled by the log-count ratio of the two classes and a linear hinge-loss model is fitted to them by
dual coordinate descent (Wang & Manning 2012; Hsieh et al. 2008). N-grams are one to three characters, and one to three
words seen as shapes: case, end signs, and whether the word has just been used.

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

from seaway.llm.texts import code_points, graded_sample, logistic_1d, sigmoid, small_batches
from seaway.session import cut

BITS = 18  # indicators are hashed into 2**BITS slots
SLICE = 1 << 20  # code points worked on at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (values + np.uint64(kind << 58)) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


def _word_shapes(points: np.ndarray) -> np.ndarray:
    """One number per word: case of its first and last letters, its last sign, a length class, and whether it repeats one of the three words before."""
    space = points <= 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0] if not space[0] else [], edge, [len(points)] if not space[-1] else []]).astype(np.int64)
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    p = points.astype(np.uint64)
    upper = (p >= 65) & (p <= 90)
    letter = upper | ((p >= 97) & (p <= 122)) | (p >= 192)
    digit = (p >= 48) & (p <= 57)
    kind = np.where(letter, np.where(upper, 1, 2), np.where(digit, 3, np.where(space, 0, 4))).astype(np.uint64)
    second = np.minimum(start + 1, end - 1)
    last = p[end - 1]
    sign = np.where(letter[end - 1] | digit[end - 1], np.uint64(0), last)
    size = np.minimum(end - start, 15).astype(np.uint64) // np.uint64(4)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((p | np.uint64(32)) * _MIX + (p << np.uint64(17)))])
        word = (total[end] - total[start]) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)
    again = np.zeros(len(start), np.uint64)
    for back in (3, 2, 1):
        if len(word) > back:
            again[back:][word[back:] == word[:-back]] = back
    return kind[start] | kind[second] << np.uint64(3) | kind[end - 1] << np.uint64(6) | size << np.uint64(9) | again << np.uint64(12) | np.minimum(sign, np.uint64(0xFFFF)) << np.uint64(16)


def _grams(values: np.ndarray, kind: int, most: int = 3) -> Iterator[np.ndarray]:
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, most + 1):
            if n > 1:
                x = x[:-1] * np.uint64(0xD1342543DE82EF95) + values[n - 1 :].astype(np.uint64) + np.uint64(n)
            if not len(x):
                return
            yield _slots(x, kind + n)


def indicators(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """The distinct slots of a text's n-grams. ``scratch``: int32, one element for each slot; it needs no clearing."""
    points = code_points(text or "")
    found: list[np.ndarray] = []
    for i in range(0, len(points), SLICE):
        part = points[i : i + SLICE + 2]
        for h in (*_grams(part, 0), *_grams(_word_shapes(part), 8)):
            place = np.arange(len(h), dtype=np.int32)
            scratch[h] = place
            found.append(h[scratch[h] == place])
    if not found:
        return np.zeros(0, np.int32)
    h = np.concatenate(found)
    place = np.arange(len(h), dtype=np.int32)
    scratch[h] = place
    return h[scratch[h] == place]


@dataclass(frozen=True)
class QualityModel:
    """Weight of every slot (log-count ratio times hinge-loss weight), the bias, and the curve to 0..1."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, texts: Iterable[str | None]) -> np.ndarray:
        scratch = np.zeros(1 << BITS, np.int32)
        return np.array([self.bias + float(self.weights[indicators(t, scratch)].sum(dtype=np.float64)) for t in texts], dtype=np.float64)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.offset)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge-loss weights of rows with values ``scale[slot]`` at their slots, and the bias (a constant feature of 1).

    Every row is divided by its length, as long rows would otherwise fix the margin alone. Stops when an epoch moves no dual variable.
    """
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norms = [float(np.sqrt((v * v).sum())) or 1.0 for v in values]
    values = [v / n for v, n in zip(values, norms, strict=True)]
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (float(w[r] @ v) + b) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            d = (a - alpha[i]) * y[i]
            if d:
                alpha[i] = a
                w[r] += d * v
                b += d
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, b


def fit_quality(plans: DataFrame, grades: DataFrame, plan_id: str = "route_id", plan_text: str = "plan_text", grade: str = "quality",
                per_class: int = 2500, smooth: float = 1.0, cost: float = 1.0) -> QualityModel:
    """Fit the model to graded plans: 1 good, 0 bad.

    The fit reads at most ``per_class`` plans of each class, chosen by a hash of their id (the documented bound); features
    are made on the executors, and only the sample's slot lists reach the driver. Without both classes every score is 0.5.
    """
    sample = cut(graded_sample(small_batches(plans), grades, grade, per_class, plan_id, plan_text))

    def made(batches):
        scratch = np.zeros(1 << BITS, np.int32)
        for pdf in batches:
            yield pd.DataFrame({"grade": pdf.grade, "slots": [np.sort(indicators(t, scratch)).astype(np.int32).tobytes() for t in pdf.plan_text]})

    got = sample.mapInPandas(made, "grade int, slots binary").toPandas()
    y = np.where(got.grade.to_numpy() == 1, 1.0, -1.0)
    rows = [np.frombuffer(s, np.int32) for s in got.slots]
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tobytes()))  # independent of the order of partitions
    y, rows = y[order], [rows[i] for i in order]
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(1 << BITS, np.float32))
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for t, r in zip(y, rows, strict=True):
        (p if t > 0 else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2  # both classes weigh alike
    fold = np.arange(len(y)) % 4 == 0
    held = _fit(ratio, [r for r, f in zip(rows, fold, strict=True) if not f], y[~fold], cost * share[~fold])
    margins = np.array([held.bias + held.weights[r].sum(dtype=np.float64) for r, f in zip(rows, fold, strict=True) if f])
    slope, offset = logistic_1d(margins, (y[fold] > 0).astype(np.int32))
    full = _fit(ratio, rows, y, cost * share)
    return QualityModel(full.weights, full.bias, max(slope, 1e-6), offset)


def _fit(ratio: np.ndarray, rows: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> QualityModel:
    w, b = dual_coordinate_descent(rows, ratio, y, cost)
    return QualityModel((w * ratio).astype(np.float32), b)


def score_quality(plans: DataFrame, model: QualityModel, plan_text: str = "plan_text", threshold: float = 0.5) -> DataFrame:
    """``plans`` with ``quality_score`` (0..1, higher: grade 1 likelier) and ``is_good`` (at or above ``threshold``).

    Null and empty texts have no n-gram and get the score of the bias. All rows and columns stay; columns of these two names
    are replaced. Equal texts get equal scores. One pass, no shuffle; the model is one weight for each of 2**18 slots.
    """

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    x = small_batches(plans).withColumn("quality_score", quality(F.col(plan_text)))
    return x.withColumn("is_good", F.col("quality_score") >= threshold)
