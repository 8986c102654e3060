"""Order statistics of whole tables without sorting them in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 256
SORTED = 1_000_000  # rows of one range that a task sorts; larger ranges are parted again


def values_at(df: DataFrame, value: str, ranks: Sequence[int], limit: int = SORTED) -> dict[int, float]:
    """Values at 0-based ranks of the non-null values in ascending order.

    The rows are counted in ranges whose bounds come from a quantile sketch; only ranges that hold a wanted rank are looked at further.
    A range of one value answers at once, a small one is sorted in a task of its own, a large one is parted again. The driver receives
    one number per range and rank.
    """
    x = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    bounds = x.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("b")).first()["b"]
    if not bounds or not ranks:
        return {}
    bounds = sorted(set(bounds))
    marks = F.array(*[F.lit(b) for b in bounds])  # each bound is a range of its own, so that a hot value never returns in a range to part
    x = x.withColumn("_r", F.size(F.filter(marks, lambda b: b < F.col("v"))) + F.size(F.filter(marks, lambda b: b <= F.col("v"))))
    found, start, small = {}, 0, {}
    for r in sorted(x.groupBy("_r").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["_r"]):
        mine = [k for k in ranks if start <= k < start + r["n"]]
        if mine and r["lo"] == r["hi"]:
            found |= dict.fromkeys(mine, r["lo"])
        elif mine and r["n"] <= limit:
            small |= {(r["_r"], k - start + 1): k for k in mine}
        elif mine:
            inner = values_at(x.filter(F.col("_r") == r["_r"]), "v", [k - start for k in mine], limit)
            found |= {start + k: v for k, v in inner.items()}
        start += r["n"]
    if small:
        s = x.filter(F.col("_r").isin(*{r for r, _ in small})).withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy("v")))
        want = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(n).alias("n")) for r, n in small])
        s = s.filter(F.array_contains(want, F.struct(F.col("_r").alias("r"), F.col("_n").alias("n"))))
        found |= {small[r["_r"], r["_n"]]: r["v"] for r in s.collect()}
    return found


def percentiles(df: DataFrame, value: str, fractions: Sequence[float], limit: int = SORTED) -> list[float | None]:
    """Exact percentiles, interpolated between the two nearest ranks; nulls are left out, None for a column without values."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return [None] * len(fractions)
    at = [(n - 1) * q for q in fractions]
    v = values_at(df, value, sorted({k for a in at for k in (math.floor(a), math.ceil(a))}), limit)
    low_high = [(v[math.floor(a)], v[math.ceil(a)], a - math.floor(a)) for a in at]
    return [lo if lo == hi else (1 - t) * lo + t * hi for lo, hi, t in low_high]
