"""Removal of passages that repeat across documents by seed and extend (operator 4).

Seeds: from every window of ``length`` words the word gram with the smallest hash is its anchor, so
equal windows have equal anchors wherever they stand (winnowing).  The windows in a row that share an
anchor are one stretch.  Anchors found in one document only are dropped; documents are joined on the
others.

Extension: occurrences of an anchor are compared by what surrounds them.  Equal stretches match in
full, both ways: all but those of the smallest document are repeats as they stand, and only the
latter go on.  Where an anchor has several different stretches, what they share is found window by
window, from the anchor outwards on either side, as the windows whose words are all equal.  Both
comparisons are minima over equal keys, combined before they are dealt, so a passage in a third of
all documents sends one row from each task and no pairs are formed.

Windows that touch or overlap are joined to maximal repeats.

Defined cases: null text has no words; a null id counts as the smallest; rows that repeat an id are
not earlier than each other; texts under ``length`` words lose nothing; very long texts are read whole; an empty table gives no rows;
columns other than the two named are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import slices, written

LENGTH = 50
#: Words of an anchor; at most ``length``.
ANCHOR = 8
#: Stands for a null id.
NULL_ID = -(2**63)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rank orders documents; with row_key, a digest of the text, it names a row's content."""
    body = F.col(text).cast("string")
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_ID)).alias("rank"), F.xxhash64(body).alias("row_key"), body.alias("text"))


def stretches(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """rank, row_key, first word, number of windows, anchor and content of every stretch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = W.split(batch.column("text").to_pylist())
            grams = W.grams(w.hashes, anchor)
            at = W.window_minima(grams, length - anchor + 1)
            owner = w.text_of()
            whole = owner[: at.size] == owner[length - 1 : length - 1 + at.size]
            new = np.ones(at.size, bool)
            new[1:] = (at[1:] != at[:-1]) | (owner[1 : at.size] != owner[: at.size - 1]) | ~whole[:-1]
            first = np.nonzero(new & whole)[0]
            edges = np.append(np.nonzero(new | ~whole)[0], at.size)
            end = edges[np.searchsorted(edges, first, side="right")] if first.size else first
            seed = grams[at[first]]
            content = W.run_hashes(w.hashes, first, end + length - 1) + (at[first] - first).astype(np.uint64)
            own = owner[first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank").take(pa.array(own)), batch.column("row_key").take(pa.array(own)), pa.array(first - w.bounds[own], pa.int32()), pa.array(end - first, pa.int32()), pa.array(seed.view(np.int64)), pa.array(W.mix(content).view(np.int64))],
                ["rank", "row_key", "first", "n", "anchor", "content"],
            )

    return rows.mapInArrow(find, "rank bigint, row_key bigint, first int, n int, anchor bigint, content bigint")


def windows(wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each window of the stretches listed with a text: rank, row_key, first word, anchor, content."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = W.split(batch.column("text").to_pylist())
            lists = batch.column("stretches")
            flat, per_row = lists.flatten(), np.diff(np.asarray(lists.offsets))
            own = np.repeat(np.arange(batch.num_rows), per_row)
            n = np.asarray(flat.field("n"), np.int64)
            base = np.asarray(flat.field("first"), np.int64)
            each = np.repeat(np.arange(n.size), n)
            place = base[each] + np.arange(each.size) - np.repeat(np.cumsum(n) - n, n)
            row = own[each]
            at = w.bounds[row] + place
            content = W.run_hashes(w.hashes, at, at + length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank").take(pa.array(row)), batch.column("row_key").take(pa.array(row)), pa.array(place, pa.int32()), flat.field("anchor").take(pa.array(each)), pa.array(content.view(np.int64))],
                ["rank", "row_key", "first", "anchor", "content"],
            )

    return wanted.select("rank", "row_key", "text", "stretches").mapInArrow(find, "rank bigint, row_key bigint, first int, anchor bigint, content bigint")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Windows and stretches that a smaller document also has: rank, row_key, first word, end."""
    rows = _rows(docs, key, text)
    found = written(stretches(rows, length, anchor), "stretches")
    shared = written(found.groupBy("anchor").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").select("anchor"), "anchors")
    seeds = written(found.join(shared, "anchor", "left_semi"), "seeds")
    firsts = written(seeds.groupBy("anchor", "content").agg(F.min("rank").alias("earliest")), "firsts")
    several = written(firsts.groupBy("anchor").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a <> b").select("anchor"), "several")
    judged = written(seeds.join(firsts, ["anchor", "content"]).select("rank", "row_key", "first", "n", "anchor", "earliest"), "judged")
    whole = judged.filter("rank > earliest").select("rank", "row_key", "first", (F.col("first") + F.col("n") + (length - 1)).alias("end"))
    open_ = judged.filter("rank = earliest").join(several, "anchor", "left_semi")
    listed = open_.groupBy("rank", "row_key").agg(F.collect_set(F.struct("first", "n", "anchor")).alias("stretches"))
    every = written(windows(rows.join(listed, ["rank", "row_key"]), length), "windows")
    earliest = written(every.groupBy("anchor", "content").agg(F.min("rank").alias("earliest"), F.max("rank").alias("latest")).filter("earliest < latest").drop("latest"), "earliest")
    part = every.join(earliest, ["anchor", "content"]).filter("rank > earliest").select("rank", "row_key", "first", (F.col("first") + length).alias("end"))
    return whole.unionByName(part)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Every row with its words, the maximal repeats (first word, end), what is kept, and counts."""
    cut = repeats(docs, key, text, length, anchor).groupBy("rank", "row_key").agg(F.collect_set(F.struct("first", "end")).alias("cuts"))
    rows = _rows(docs, key, text).join(written(cut, "cuts"), ["rank", "row_key"], "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for rank, t, cuts in zip(batch.column("rank").to_pylist(), batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                own = (t or "").translate(_TO_BLANK).split(" ") if t else []
                own = [x for x in own if x]
                spans = merged([(c["first"], c["end"]) for c in cuts or ()])
                left, at = [], 0
                for a, b in spans:
                    left += own[at:a]
                    at = b
                left += own[at:]
                out.append((None if rank == NULL_ID else rank, len(own), len(own) - len(left), [{"first": a, "end": b} for a, b in spans], " ".join(left)))
            doc, n, gone, spans, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return rows.select("rank", "text", "cuts").mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first:int,end:int>>, kept_text string")


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
_TO_BLANK = {c: " " for c in range(0x09, 0x0E)}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    return remove(docs, key, text).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
