"""Token ids as ORC files (operator 9).

Documents are dealt to ranges of their id, sorted and encoded there, and written as ORC: ids are
integer columns under run-length encoding, each stripe has row indexes, and Bloom filters on the
document id let a reader skip stripes.  Files are numbered in ascending order of id.

Defined cases: null text counts as empty and yields the end id alone; null ids sort first; repeated
rows are written each; an empty table writes an empty file and reads back no rows; texts of any length are
encoded whole; columns other than the two named may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import prefix_sums, scratch, slices, sort_key, written

END_ID = 1
#: Bytes of a stripe; rows between entries of its index.
STRIPE, INDEX_ROWS = 64 << 20, 10_000
SCHEMA = "doc_id bigint, n_tokens int, ids array<int>"


def write(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, stripe_bytes: int = STRIPE, index_rows: int = INDEX_ROWS) -> None:
    """Writes the ids of every document to ORC files in ascending order of its id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(vocabulary)
        for batch in slices(batches, "text"):
            ids, bounds = encoder.encode(batch.column("text").to_pylist())
            n = batch.num_rows
            ends = bounds[1:]
            flat = np.insert(ids.astype(np.int32), ends, end_id)
            offsets = bounds + np.arange(n + 1)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int32()), lists], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    by = sort_key(F.col("doc_id"))
    dealt = rows.repartitionByRange(by).sortWithinPartitions(by)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes), "compression": "none"}
    dealt.mapInArrow(encode, SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files; filters on doc_id are pushed to stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def checksums(tokens: DataFrame) -> DataFrame:
    """Number and CRC-32 of each document's ids."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.asarray(lists.values, "<u4") if lists.values.null_count == 0 else np.asarray(lists.values.fill_null(0), "<u4")
            at = np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "ids").mapInArrow(sums, "doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, end_id: int = END_ID, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Writes the ids, reads the files back and tells where each document's ids start in the stream."""
    spark = docs.sparkSession
    path = scratch(spark, "token-orc")
    write(docs, path, end_id, key, text, vocabulary)
    # Written first, as dealing by ranges reads its input twice.
    found = written(checksums(read(spark, path)), "checksums")
    return prefix_sums(found, ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start")
