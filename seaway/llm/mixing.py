"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 10), DataFrame functions only.

Every record draws an exponential key, divided by its quality weight, so records of good quality tend to come first. A source
whose target exceeds its size is taken whole as often as it fits (complete epochs); what is left is filled in key order up
to the remaining word budget. Only one small row per source decides: the key at which its budget ends. Nothing is sorted as
a whole, and texts are not shuffled.

Records: the engine's target and reconciliation rows carry a ``source``; their plain-text form (passage plans with
``route_id``, ``plan_text`` and ``source``) is what is mixed, and any table with an id, a text and a source fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seaway.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SIGNS = "0123456789#$%&*!|=<>@^~_{}[]\\"
BUCKET_ROWS = 4096  # rows of a key bucket, about
BROADCAST_SOURCES = 10_000  # more sources than these are joined by shuffle


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of characters that are neither digits nor unusual signs."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n > 0, F.lit(0.05) + F.lit(0.95) * (F.length(F.translate(text, SIGNS, "")) / n.cast("double"))).otherwise(F.lit(0.05))


def _uniform(key: Column, seed: str) -> Column:
    """(0, 1) from 52 bits of the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def measure(plans: DataFrame, plan_id: str = "route_id", plan_text: str = "plan_text", weight: str | None = None, seed: str = "mix") -> DataFrame:
    """``plans`` with ``size`` (words), and the sampling key ``mix_key``. ``weight`` names a column of positive quality weights; others count as 0.05."""
    w = quality_weight(F.col(plan_text)) if weight is None else F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(0.05)
    plans = plans.drop(*{"size", "source_size", "target", "taken", "mix_key"} - {plan_id, plan_text, weight})
    return plans.withColumn("size", word_count(F.col(plan_text))).withColumn("mix_key", -F.log(_uniform(F.col(plan_id), seed)) / w)


def targets(sizes: DataFrame, source: str, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Words wanted of each source: (source, source_size, n, target).

    Sources by code point, null last, get ``weights`` in turn. They share ``share`` times all words by weight; nothing exceeds
    ``cap`` times its source, the excess goes to the others by weight. The level at which that settles is found by ordering
    the sources by the level that fills them. One row per source.
    """
    s = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights)) + 1).cast("long"))
    s = s.withColumn("_full", F.lit(float(cap)) * F.col("source_size")).withColumn("_level", F.col("_full") / F.col("_w"))
    every, by = Window.partitionBy(), Window.orderBy("_level", "_rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_total": F.lit(float(share)) * F.sum("source_size").over(every), "_filled": F.coalesce(F.sum("_full").over(before), F.lit(0.0)),
                       "_open": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))})
    s = s.withColumn("_try", (F.col("_total") - F.col("_filled")) / F.col("_open"))
    first = F.min(F.when(F.col("_try") < F.col("_level"), F.struct("_level", "_rank", "_try"))).over(every)
    s = s.withColumn("_at", first)
    return s.select(source, "source_size", "n", F.when(F.col("_at").isNull(), F.col("_full")).otherwise(F.least("_full", F.col("_at._try") * F.col("_w"))).alias("target"))


def quotas(measured: DataFrame, plan_id: str = "route_id", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: target, complete epochs, and where in key order the fractional part ends.

    Key buckets of about ``BUCKET_ROWS`` rows are summed per source; only the bucket in which a source's budget ends is looked
    at row by row. ``cut_key`` and ``cut_id`` name the last record taken, ``cut_size`` its words (with all rows of that id),
    ``cut_rest`` the words it may give.
    """
    sizes = measured.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    q = targets(sizes, source, weights, share, cap)
    q = q.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    q = cut(q.withColumn("budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")).withColumn("_per", F.greatest(F.lit(1.0), F.col("n") / float(BUCKET_ROWS))))
    x = _meet(measured, q.select(source, "budget", "_per"), source).filter("budget > 0 and size > 0")
    x = x.select(source, F.col(plan_id).alias("_id"), "mix_key", "size", "budget", F.floor(F.col("mix_key") * F.col("_per")).alias("_bucket"))
    run = lambda *order: Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = x.groupBy(source, "_bucket").agg(F.sum("size").alias("_s"), F.first("budget").alias("budget"))
    b = b.withColumn("_run", F.sum("_s").over(run("_bucket"))).filter("_run >= budget and _run - _s < budget")
    b = b.select(source, "_bucket", (F.col("_run") - F.col("_s")).alias("_before"))
    rows = _meet(x, b.withColumnRenamed("_bucket", "_edge"), source).filter("_bucket = _edge")
    rows = rows.groupBy(source, "mix_key", "_id").agg(F.sum("size").alias("_s"), F.first("_before").alias("_before"), F.first("budget").alias("budget"))
    rows = rows.withColumn("_run", F.sum("_s").over(run("mix_key", "_id")) + F.col("_before")).filter("_run >= budget and _run - _s < budget")
    edge = rows.select(source, F.col("mix_key").alias("cut_key"), F.col("_id").alias("cut_id"), F.col("_s").alias("cut_size"), (F.col("budget") - F.col("_run") + F.col("_s")).alias("cut_rest"))
    return cut(q.drop("_per").join(edge.withColumnRenamed(source, "_src"), F.col(source).eqNullSafe(F.col("_src")), "left").drop("_src"))


def _meet(x: DataFrame, small: DataFrame, source: str) -> DataFrame:
    """Join with one row per source; broadcast only after its rows were counted."""
    small = small.withColumnRenamed(source, "_src")
    small = F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small
    return x.join(small, F.col(source).eqNullSafe(F.col("_src"))).drop("_src")


def take(measured: DataFrame, quota: DataFrame, plan_id: str = "route_id", source: str = "source") -> DataFrame:
    """``measured`` with ``source_size``, ``target`` and ``taken``: the words the mix takes of each record, repeats counted."""
    x = _meet(measured, quota.select(source, "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_rest"), source)
    here, end = F.struct(F.col("mix_key").alias("k"), F.col(plan_id).alias("i")), F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("i"))
    part = F.when(F.col("cut_key").isNull(), 0).when(here < end, F.col("size")).when(here == end, F.expr("(cut_rest * size) div cut_size")).otherwise(0)
    return x.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("epochs", "cut_key", "cut_id", "cut_size", "cut_rest", "mix_key")


def mix_sources(plans: DataFrame, plan_id: str = "route_id", plan_text: str = "plan_text", source: str = "source", weights: Sequence[int] = (3, 1, 2),
                share: float = 1.5, cap: float = 2.0, weight: str | None = None, seed: str = "mix") -> DataFrame:
    """``plans`` with ``size``, ``source_size``, ``target`` and ``taken``.

    The words taken of a source add up to its rounded target (records that share the id at the cut may leave a few words). Null
    and empty texts have size 0 and give nothing; a null source is a source of its own; ties of the key go by id, and rows
    of one id at the cut share the rest by size. All rows and columns stay; columns of the four names are replaced. Reruns
    agree, as keys come from the id. No text is shuffled.
    """
    measured = measure(plans, plan_id, plan_text, weight, seed)
    narrow = cut(measured.select(plan_id, source, "size", "mix_key"))
    return take(measured, quotas(narrow, plan_id, source, weights, share, cap), plan_id, source)


def repeat_taken(mixed: DataFrame, plan_text: str = "plan_text", whole: bool = False) -> DataFrame:
    """One row per copy that the mix takes; the last copy of a record at the cut keeps its first words as they stand in the text, with the space between them.

    With ``whole`` that copy is taken whole if this comes nearer to the budget than leaving it out, so every copy is a whole text.
    """
    if whole:
        x = mixed.filter("taken > 0").withColumn("_n", F.expr("taken div nullif(size, 0) + int(2 * (taken % nullif(size, 0)) >= size)").cast("int"))
        x = x.filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        # the text depends on the copy, or the optimiser moves Python functions of it into joins below, where they cannot run
        return x.withColumn(plan_text, F.when(F.col("_n") > 0, F.col(plan_text))).drop("_n")
    x = mixed.filter("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("size"), F.col("taken") - (F.col("_copy") - 1) * F.col("size")).cast("int")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(plan_text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), left), "")
    return x.withColumn(plan_text, F.when(left < F.col("size"), words).otherwise(F.col(plan_text))).drop("_copy")
