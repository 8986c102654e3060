"""Code-point tables and bounded samples shared by the text operators.

The engine's own text record is the passage plan: one row per route with ``route_id`` and ``plan_text``. Every text
operator takes the two column names as parameters, so any table with an id and a text fits.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts, digits and signs that stand in for Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ց": "g", "ո": "n", "ս": "u", "օ": "o", "ɡ": "g", "ɑ": "a", "ɩ": "i",
    "ı": "i", "ł": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "!": "i",
}


BATCH_BYTES = 8 << 20


def small_batches(plans: DataFrame) -> DataFrame:
    """``plans``, after limiting the bytes that its session hands to Python at once, so that long texts stay within a worker's memory.

    A smaller setting of the session is kept.
    """
    conf, name = plans.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([a-z]*)", conf.get(name).lower())
    scale = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    if not now or now[2] not in scale or int(now[1]) * scale[now[2]] > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return plans


def code_points(text: str) -> np.ndarray:
    """The code points of a text (a read-only view of its UTF-32 form)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(points: np.ndarray) -> str:
    return points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=2)
def letter_table(lookalikes: bool = False) -> np.ndarray:
    """For every code point its lower-case letter, or a space for what is no letter or mark.

    ``lookalikes`` also folds ``LOOKALIKES`` and compatibility forms (full width, mathematical, circled, raised) onto Latin letters.
    """
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isalpha() or (cp > 0x2FF and unicodedata.combining(ch)):
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    if lookalikes:
        for cp in range(0x80, 0x30000):
            if unicodedata.decomposition(chr(cp)).startswith("<"):  # a form of another character, not a letter with a mark
                plain = unicodedata.normalize("NFKD", chr(cp)).strip("()")
                if len(plain) == 1:
                    table[cp] = table[ord(plain)] if plain.isalpha() else ord(LOOKALIKES.get(plain, " "))
        for a, b in LOOKALIKES.items():
            for form in {a, a.upper()}:
                if len(form) == 1:
                    table[ord(form)] = ord(b)
    return table


def remainder(doc_key: Column | str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``."""
    key = F.col(doc_key) if isinstance(doc_key, str) else doc_key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def graded_sample(plans: DataFrame, grades: DataFrame, grade: str, per_class: int, plan_id: str, plan_text: str) -> DataFrame:
    """At most ``per_class`` graded plans of each class (0 and 1), chosen by a hash of the id: (plan_text, grade).

    The ids are chosen from the narrow grade table that meets the ids of the plans; only then are texts read, with
    the at most ``2 * per_class`` chosen ids broadcast. Ids with both grades and null grades or ids are left out.
    """
    g = grades.filter(F.col(grade).isin(0, 1) & F.col(plan_id).isNotNull()).groupBy(plan_id).agg(F.min(grade).alias("_g"), F.max(grade).alias("_g2"))
    g = g.filter("_g = _g2").select(F.col(plan_id).alias("_id"), F.col("_g").cast("int").alias("_g"))
    g = g.join(plans.select(F.col(plan_id).alias("_id")), "_id", "left_semi")
    pick = lambda k: g.filter(F.col("_g") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    x = plans.select(F.col(plan_id).alias("_id"), F.coalesce(F.col(plan_text), F.lit("")).alias("_text"))
    return x.join(F.broadcast(chosen), "_id").select(F.col("_text").alias("plan_text"), F.col("_g").alias("grade"))


def logistic_1d(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Platt's scaling: slope and offset of a logistic curve by Newton steps, with his smoothed targets."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    m, s = float(x.mean()), float(x.std()) or 1.0
    z, a, b = (x - m) / s, 1.0, 0.0
    loss = lambda a, b: float((w * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum() + ridge * (a * a + b * b) / 2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, h = w * (p - t), w * p * (1 - p)
        grad = np.array([(d * z).sum() + ridge * a, d.sum() + ridge * b])
        hess = np.array([[(h * z * z).sum() + ridge, (h * z).sum()], [(h * z).sum(), h.sum() + ridge]])
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while size > 1e-4 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-9:
            break
    return a / s, b - a * m / s


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
