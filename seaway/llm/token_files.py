"""Token ids of texts in files of wavelet matrices (operator 2).

Texts are encoded in ascending order of their id and cut into shards of whole texts; a shard is one row of a Parquet file
with the wavelet matrix of its ids and the ids and lengths of its texts. A shard answers token access, counting and
occurrence lookup from its own bytes.

Records: the engine stores no free remarks, so the operator runs on any (id, text) table; its defaults are those of
passage plans (``route_id``, ``plan_text``).
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seaway.llm.texts import small_batches
from seaway.llm.wavelet import WaveletMatrix
from seaway.llm.wordcache import WordCache

SHARD_TOKENS = 1 << 18
PARTS = 200_000  # parts of words remembered with their ids in a worker
BROADCAST_SHARDS = 500_000  # offsets of more shards are joined by shuffle


@lru_cache(maxsize=2)
def _cache(tokenizer_file: str) -> WordCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordCache(word_encoder(Tokenizer.from_file(tokenizer_file)))


def word_encoder(t):
    """A function from words without blanks to their ids.

    A tokenizer of the usual form (NFC, lower case, one splitting pattern, byte letters) is taken apart: words are normalised
    and split here by its own pattern, and each distinct part goes to its model once. Other tokenizers, and words that hold the
    text of an added token, are given whole words.
    """

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<i4").tobytes()

    def together(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(blobs), "<i4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4

    def whole(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return together([packed(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)])

    spec = json.loads(t.to_str())
    norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    usual = norms == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
    usual = usual and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    if not usual:
        return whole
    pattern = regex.compile(parts[0]["pattern"]["Regex"])
    mark = os.path.commonprefix([a["content"] for a in spec["added_tokens"]]) or ("" if spec["added_tokens"] else "\n")  # no word holds a line feed
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    model, memory = t.model, {}

    def ids_of(part: str) -> bytes:
        if len(memory) > PARTS:
            memory.clear()
        form = part if part.isascii() and part.isprintable() else part.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
        memory[part] = packed([x.id for x in model.tokenize(form)])
        return memory[part]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blobs = []
        for w in words:
            if w.isascii():
                text = w
            elif _plain(w):
                text = unicodedata.normalize("NFC", w)
            else:
                text = None
            if text is None or mark in w:
                blobs.append(whole([w])[0].tobytes())
            else:
                blobs.append(b"".join([memory.get(p) or ids_of(p) for p in pattern.findall(text.lower())]))
        return together(blobs)

    return encode


def _plain(word: str) -> bool:
    """Whether lower case and categories are beyond doubt: letters of the Latin, Greek and Cyrillic blocks, no final sigma."""
    return max(word) < "\u0530" and "\u03a3" not in word and "\u0130" not in word


def write_token_files(plans: DataFrame, path: str, tokenizer_file: str, end_id: int, plan_id: str = "route_id", plan_text: str = "plan_text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append ``end_id``, and write shards of about ``shard_tokens`` ids to ``path``.

    Null counts as empty; rows that repeat an id are ordered by text, null ids come first. The tokenizer must drop white space,
    so that words between blanks can be encoded by themselves. Columns: ``part`` and ``shard`` (their order is the order of texts), ``n_tokens``, ``ids`` (the ids of
    the texts), ``lengths``, ``matrix``. One shuffle, into ranges of ids; the writer's commit survives lost executors.
    """
    kind = plans.schema[plan_id].dataType.simpleString()
    x = small_batches(plans).select(F.col(plan_id).alias("id"), F.coalesce(F.col(plan_text), F.lit("")).alias("text"))
    x = x.repartitionByRange("id").sortWithinPartitions("id", "text")

    def shards(batches):
        cache, part, number = _cache(tokenizer_file), TaskContext.get().partitionId(), 0
        ids, parts, total = [], [], 0

        def full():
            m = WaveletMatrix.build(np.concatenate(parts))
            return pd.DataFrame({"part": [part], "shard": [number], "n_tokens": [total], "ids": [list(ids)], "lengths": [[len(p) for p in parts]], "matrix": [m.to_bytes()]})

        for pdf in batches:
            for i, tokens in zip(pdf["id"].astype(object), cache.encode_texts(pdf["text"]), strict=True):
                ids.append(None if pd.isna(i) else i)
                parts.append(np.append(tokens, np.int32(end_id)))
                total += len(parts[-1])
                if total >= shard_tokens:
                    yield full()
                    ids, parts, total, number = [], [], 0, number + 1
        if parts:
            yield full()

    x.mapInPandas(shards, f"part int, shard int, n_tokens long, ids array<{kind}>, lengths array<long>, matrix binary").write.option("compression", "zstd").parquet(path)


def token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a token file with ``start``: the number of ids in all shards before. Only per-shard counts are ordered."""
    files = spark.read.parquet(path)
    own = files.select("part", "shard", "n_tokens")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    parts = parts.select("part", F.coalesce(F.sum("_t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    starts = own.withColumn("_s", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("_s") + F.col("_p")).alias("start"))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_SHARDS else starts
    return files.join(starts, ["part", "shard"])


def read_token_files(spark: SparkSession, path: str, plan_id: str = "route_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every text in the files: ids before it, its own ids with the end id, and their CRC-32 as little-endian 32-bit integers."""
    kind = spark.read.parquet(path).schema["ids"].dataType.elementType.simpleString()

    def texts(batches):
        for pdf in batches:
            for start, ids, lengths, matrix in zip(pdf["start"], pdf["ids"], pdf["lengths"], pdf["matrix"], strict=True):
                tokens = WaveletMatrix.from_bytes(matrix).to_array().astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(tokens[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"id": pd.Series(list(ids), dtype=object), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(sums, np.int64)})

    x = token_shards(spark, path).select("start", "ids", "lengths", "matrix")
    return x.mapInPandas(texts, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", plan_id)


def count_tokens(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, shard, n, first): how often ``token`` occurs in each shard and its first position there (-1: none), from the planes alone."""

    def counted(batches):
        for pdf in batches:
            m = [WaveletMatrix.from_bytes(b) for b in pdf["matrix"]]
            yield pd.DataFrame({"part": pdf["part"], "shard": pdf["shard"], "n": [x.count(token) for x in m], "first": [x.select(token, 0) for x in m]})

    return spark.read.parquet(path).select("part", "shard", "matrix").mapInPandas(counted, "part int, shard int, n long, first long")
