"""Ordered work inside keys that may be very long.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. The helpers here cut a key
into blocks of consecutive rows, so a key that holds a third of a table still spreads over the
cluster, and only per-block totals are ordered per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK = 65536


def _prior_total(totals: DataFrame, keys: Sequence[str], block: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, block, F.sum(value).over(w).alias(out))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "seq") -> DataFrame:
    """``row_number`` per key, from 1. ``bucket`` must not decrease along ``order``."""
    x = df.withColumn("_bkt", bucket)
    counts = x.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    prior = _prior_total(counts, keys, "_bkt", "_n", "_prior")
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    x = x.withColumn("_in_bkt", F.row_number().over(w)).join(prior, [*keys, "_bkt"])
    return x.withColumn(out, F.col("_in_bkt").cast("bigint") + F.coalesce("_prior", F.lit(0))).drop("_bkt", "_in_bkt", "_prior")


def long_keys(df: DataFrame, key: str, most: int = BLOCK) -> list:
    """Keys with more than ``most`` rows, fewer than one for ``most`` rows of the table; the others fit a plain window each."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.filter((F.col("_n") > most) & F.col(key).isNotNull()).select(key).collect()]


def split_keys(df: DataFrame, key: str, most: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of ``long_keys`` or None). Rows without a key are in neither."""
    hot = long_keys(df.select(key), key, most)
    if not hot:
        return df.filter(F.col(key).isNotNull()), None
    return df.filter(~F.col(key).isin(hot)), df.filter(F.col(key).isin(hot))


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 1,
    ahead: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Window columns that look at most ``back`` rows behind and ``ahead`` rows in front.

    ``seq`` must be dense inside a key. Rows at a block border are copied to the neighbour block, the
    window runs per (key, block), and the copies are dropped again.
    """
    blk = F.floor(F.col(seq) / block)
    pos = F.pmod(F.col(seq), F.lit(block))
    own = F.struct(blk.alias("blk"), F.lit(True).alias("own"))
    copies = [own]
    if back:
        copies.append(F.when(pos >= block - back, F.struct((blk + 1).alias("blk"), F.lit(False).alias("own"))))
    if ahead:
        copies.append(F.when(pos < ahead, F.struct((blk - 1).alias("blk"), F.lit(False).alias("own"))))
    x = df.select("*", F.explode(F.array_compact(F.array(*copies))).alias("_c"))
    x = x.select(*df.columns, F.col("_c.blk").alias("_blk"), F.col("_c.own").alias("_own"))
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    return build(x, w).filter("_own").drop("_blk", "_own")


def running_sum(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to and including the current one."""
    x = df.withColumn("_blk", F.floor(F.col(seq) / block))
    w = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    totals = x.groupBy(*keys, "_blk").agg(F.sum(value).alias("_t"))
    prior = _prior_total(totals, keys, "_blk", "_t", "_prior").filter("_prior is not null")
    x = x.withColumn("_run", F.sum(value).over(w)).join(prior, [*keys, "_blk"], "left")
    return x.withColumn(out, F.col("_run") + F.coalesce("_prior", F.lit(0.0))).drop("_blk", "_run", "_prior")


def ends(df: DataFrame, keys: Sequence[str], seq: str, cols: Sequence[str]) -> DataFrame:
    """First and last row of each key as structs ``first``, ``last`` plus the count ``n`` (partial aggregation)."""
    row = F.struct(*cols)
    return df.groupBy(*keys).agg(
        F.min_by(row, F.col(seq)).alias("first"), F.max_by(row, F.col(seq)).alias("last"),
        F.count(F.lit(1)).alias("n"))
