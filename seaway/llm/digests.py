"""SHA-256 over rows in order, in memory that does not grow with the length of a run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest_runs(rows: DataFrame, key: str, piece: str, sep: str) -> DataFrame:
    """(key, sha256) of the pieces of each key joined by ``sep``; the rows of a key must follow each other within one partition.

    A null piece counts as empty. SHA-256 has no way to join two halves, so a key is read by one task, as a stream.
    """
    kind = rows.schema[key].dataType.simpleString()
    glue = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), pa.field("sha256", pa.string())])
            keys, sums = [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != at:
                    if state is not None:
                        keys.append(at)
                        sums.append(state.hexdigest())
                    at, state = k, hashlib.sha256()
                else:
                    state.update(glue)
                state.update((p or "").encode("utf-8", "surrogatepass"))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(sums, pa.string())], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], schema.field(0).type), pa.array([state.hexdigest()], pa.string())], schema=schema)

    return rows.select(key, piece).mapInArrow(run, f"`{key}` {kind}, sha256 string")


def digest_ordered(rows: DataFrame, key: str, order: Sequence[str], piece: str, sep: str) -> DataFrame:
    """As ``digest_runs`` on rows in any place: one shuffle by key, sorted by ``order`` within a key (nulls first)."""
    return digest_runs(rows.select(key, *order, F.col(piece)).repartition(key).sortWithinPartitions(key, *order), key, piece, sep)
