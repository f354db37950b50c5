"""Sharding by jump consistent hashing (operator 2).

A row's stable key and the number of shards decide its shard; there is no ring table.  When a shard
is appended, only the rows that move into it move: about one in (shards + 1).

Defined cases: a null key is hashed as a value of its own; repeated keys share a shard; null texts
have no bytes; texts of any length are sized whole; an empty table gives no rows; only the key and text
columns are read, whatever the others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import empty_if_null, prefix_sums

#: Stands for a null key.
NULL_KEY = -(2**63)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys, all keys a step at a time."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    here, ahead = np.full(state.size, -1, np.int64), np.zeros(state.size, np.int64)
    moving = np.arange(state.size)
    while moving.size:
        here[moving] = ahead[moving]
        s = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        state[moving] = s
        ahead[moving] = ((here[moving] + 1) * (2.0**31 / ((s >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return here


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads neighbouring integers before they seed the jumps."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def assign(df: DataFrame, key: str, shards: int, name: str = "shard", grown: str | None = None) -> DataFrame:
    """Adds each row's shard, and with ``grown`` the one it has when a shard is appended."""
    counts = [(name, shards)] + ([(grown, shards + 1)] if grown else [])
    schema = T.StructType([*df.schema.fields])
    for column, _ in counts:
        schema = schema.add(column, "integer")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mixed(np.array([NULL_KEY if k is None else k for k in batch.column(key).to_pylist()], np.int64))
            columns = [pa.array(jump_hash(keys, n), pa.int32()) for _, n in counts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(c for c, _ in counts)])

    return df.mapInArrow(place, schema)


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard, its gapless place in the shard by key, and its shard after growth by one."""
    body = empty_if_null(text)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), (F.octet_length(body).cast("bigint") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit(1).cast("bigint").alias("one"))
    placed = assign(rows, "doc_id", shards, "shard", "grown_shard")
    slots = prefix_sums(placed, ["shard", "doc_id", "text_crc32", "size"], "one", "slot", within="shard")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
