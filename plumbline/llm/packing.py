"""Packing token streams into fixed windows by concatenate and cut (operator 7).

Each task encodes its documents and adds up its own tokens; the totals of the tasks (one row each)
are summed to global offsets in a second pass; then every document is cut where the global stream
crosses a multiple of the window, which leaves one boundary record for each piece.  Only the last
window is shorter, so padding is below one window in all.  The ids are written once and never
shuffled.

Defined cases: null text counts as empty and yields the end id alone; repeated rows are packed
each; an empty table gives no rows; a document may span any number of windows; columns other than the two
named may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import SLICE_BYTES, Tables, slices, task_number

END_ID = 2
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def encoded(docs: DataFrame, end_id: int, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Each document's ids with the end id, as little-endian numbers of 16 bits where all ids of the vocabulary
    fit, else of 32; task and tokens before it there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, held = bpe.load(vocabulary), task_number(), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, bounds = encoder.encode(batch.column("text").to_pylist())
            kind = "<u2" if max(len(encoder.surface) - 1, end_id) < 1 << 16 else "<u4"
            rows = [np.append(ids[a:b], end_id).astype(kind).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            sizes = np.diff(bounds) + 1
            before = held + np.cumsum(sizes) - sizes
            held += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.full(sizes.size, number), pa.int32()), pa.array(before, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "task", "before", "ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, n_tokens bigint, task int, before bigint, ids binary")


def cut(tokens: DataFrame, window: int) -> DataFrame:
    """The pieces of written token rows: see ``PIECE`` for the boundary records, with the ids."""
    totals = tokens.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task that wrote tokens.
    starts = totals.select("task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("task_start"))
    rows = tokens.join(F.broadcast(starts), "task").select("doc_id", "n_tokens", (F.col("before") + F.col("task_start")).alias("at"), "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n, at, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "at", "ids"))):
                ids, start = np.frombuffer(raw, f"<u{len(raw) // n}"), 0
                while start < n:
                    size = min(n - start, window - (at + start) % window)
                    piece = ids[start : start + size].astype("<u4").tobytes()
                    out.append((doc, start, size, zlib.crc32(piece), n, (at + start) // window, (at + start) % window, piece))
                    start += size
            if out:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [*(c.split()[0] for c in PIECE.split(", ")), "ids"])

    return rows.mapInArrow(pieces, PIECE + ", ids binary")


def pack(docs: DataFrame, window: int = 4096, end_id: int = END_ID, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, tables: Tables | None = None) -> DataFrame:
    """Boundary records of the packed sequences, each with the ids of its piece (little-endian, 32 bits)."""
    tables = tables or Tables(docs.sparkSession)
    return cut(tables.write(encoded(docs, end_id, key, text, vocabulary), "tokens"), window)
