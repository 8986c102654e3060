"""The corpus pipeline: toxicity, near copies, private values, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Null texts
pass the filters with nothing to find and give no words to the mix, so they end there; empty tables stay empty; columns
other than those of ``documents`` are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaway.llm import mixing, near_copies, pieces, private, toxicity
from seaway.llm.queries import learnable, plans_of
from seaway.session import cut, ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_IDS = 1_000_000  # ids that are broadcast to drop rows; more are joined by shuffle


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of 0.7; the lexicon is learned from labels of the documents given."""
    model = toxicity.fit_toxicity(plans_of(docs), learnable(spark, sf_dir))
    x = toxicity.score_toxicity(docs.select(*COLUMNS), model, plan_text="text")
    return x.filter("not is_toxic").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts stay where they are; only ids move, but for rows that repeat an id. Those are compared row by row, so that each text
    under an id stays unless it is a near copy; rows that are equal in all columns are one.
    """
    docs = docs.select(*COLUMNS)
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        found = near_copies.near_copies(plans_of(docs), words=5, percent=80)
        return docs.join(_small(found.filter("not kept").select(F.col("route_id").alias("doc_id")).distinct()), "doc_id", "left_anti")
    again = _small(cut(again))
    key = lambda kind, number: F.concat(F.lit(kind), number.cast("string"))
    rows = docs.join(again, "doc_id", "left_semi").select(*COLUMNS).distinct()
    rows = cut(rows.withColumn("_key", key("r", F.monotonically_increasing_id())).withColumn("_order", F.xxhash64(*COLUMNS)))
    others = docs.join(again, "doc_id", "left_anti").withColumn("_key", key("d", F.col("doc_id"))).withColumn("_order", F.lit(0).cast("long"))
    keyed = others.unionByName(rows)
    found = near_copies.near_copies(keyed.select(F.col("_key").alias("route_id"), F.col("text").alias("plan_text")), words=5, percent=80)
    found = cut(found.filter("route_id is not null").select(F.col("route_id").alias("_key"), "component_id"))
    first = found.join(keyed.select("_key", "doc_id", "_order"), "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_order", "_key")).alias("k"))
    gone = cut(found.select("_key").join(first.select("k._key"), "_key", "left_anti"))
    return keyed.join(_small(gone), "_key", "left_anti").select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of private values."""
    x = private.pseudonymise(docs.select(*COLUMNS), plan_text="text")
    return x.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row per copy; the one in which a source's budget ends is whole or left out, whichever comes nearer."""
    x = mixing.mix_sources(docs.select(*COLUMNS), plan_id="doc_id", plan_text="text", source="source")
    return mixing.repeat_taken(x, plan_text="text", whole=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, piece_ids) of every row."""
    import public_tokenizers

    model = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    x = pieces.encode_pieces(docs.select(*COLUMNS), model, plan_text="text")
    return x.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("private", replace_private),
    ("mixing", mix),
    ("pieces", encode),
]
ORACLE_SQL = None  # learned and hashed stages: tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{number}-{name}")
            docs = spark.read.parquet(f"{home}/{number}-{name}")
    return docs
