"""Exact deduplication as a stateful stream (operator 1).

A narrow table of (digest, stable identifier, content locator) is read as a stream; a streaming
aggregation keeps, in disk-backed RocksDB state without expiry, for each digest the identifier and
locator of the row that stays and the number of rows seen.  Rows are combined before they are dealt
by digest, so a text that makes up a third of the input sends one row from each task.  State outlives
the run in its checkpoint folder and is read back as a table.

Digests that were hit more than once have the full bytes of their texts checked; should two texts
ever share a digest, those rows are grouped by their bytes instead.  A Bloom filter of these digests, of
fixed size, tells every task which of its rows may be such hits: all other texts, whose digest stands
alone, are neither checked nor moved.  Rows that it lets through in error cost a move and nothing else.

Defined cases: null text counts as empty; texts are equal when identical after lower-casing A-Z;
the largest id stays, null ids being the smallest, and of rows that repeat an id one stays; an
empty table gives no rows; texts of any length are read whole; columns other than the two named may have any
name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, empty_if_null, lower_ascii

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores: space reserved ahead for each one's manifest would far exceed the state itself.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of one digest are checked in so many parts before the parts are compared.
PARTS = 32
#: Bits of the filter of hit digests (8 MB, whatever the input), bits that a digest sets, bytes of a block.
FILTER_BITS, PROBES, BLOCK = 1 << 26, 4, 1 << 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def seen(rows: DataFrame, checkpoint: str) -> DataFrame:
    """Runs the stream over what is new in a folder of (digest, doc_id, row_no, locator) and returns
    the whole state: digest, keep_id, keep_row, keep_locator, group_size."""
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        latest = F.max(F.struct("doc_id", "row_no", "locator")).alias("seed")
        state = rows.groupBy("digest").agg(latest, F.count("*").alias("group_size"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.format("statestore").load(checkpoint)
        value = found.schema["value"].dataType.names
        seed, size = (F.col("value").getField(n) for n in value)
        return found.select(F.col("key.digest").alias("digest"), seed["doc_id"].alias("keep_id"), seed["row_no"].alias("keep_row"), seed["locator"].alias("keep_locator"), size.alias("group_size"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _probes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bits of each digest, from two 64-bit hashes."""
    a, b = first.astype(np.uint64)[:, None], second.astype(np.uint64)[:, None] | np.uint64(1)
    return (a + b * np.arange(PROBES, dtype=np.uint64)) % np.uint64(FILTER_BITS)


def hit_filter(hits: DataFrame) -> Callable[[Column], Column]:
    """Whether a digest may be one of ``hits``; never false for one that is."""
    spark = hits.sparkSession
    hashes = lambda digest: (F.xxhash64(digest), F.xxhash64(F.lit("second"), digest))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _probes(np.asarray(batch.column(0)), np.asarray(batch.column(1))).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = bits.reshape(-1, BLOCK)
        used = np.nonzero(rows.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["block", "bits"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                held[i] = held[i] | own if i in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    first, second = hashes(F.col("digest"))
    found = hits.select(first.alias("first"), second.alias("second")).mapInArrow(blocks, "block int, bits binary").repartition("block").mapInArrow(united, "block int, bits binary")
    bits = np.zeros((FILTER_BITS // 8 // BLOCK, BLOCK), np.uint8)
    for row in found.collect():  # 128 blocks at most
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())

    @F.arrow_udf("boolean")
    def may_be(first: pa.Array, second: pa.Array) -> pa.Array:
        at = _probes(np.asarray(first), np.asarray(second))
        known = np.frombuffer(shared.value, np.uint8)
        return pa.array((known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1))

    return lambda digest: may_be(*hashes(digest))


def _shared_digests(texts: DataFrame) -> DataFrame:
    """Digests, among those of texts that the filter lets through, under which full texts differ.

    Texts are dealt once, by digest and part, so that a large group of copies is spread over parts.  Those let
    through in error stand alone under their digest and differ from nothing, so the digests that were hit need
    not be repeated for each part and joined: Spark would take that table for as small as the one without repeats
    and send all of it through the driver.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")
    own = texts.select("digest", "body", part).repartition("digest", "part")
    parts = own.groupBy("digest", "part").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    whole = parts.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return whole.filter("least <> most").select("digest")


def _found(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column], files_per_trigger: int, tables: Tables) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Every row's answer, and what tells rows that may be hits by their digest."""
    spark = docs.sparkSession
    body = lower_ascii(empty_if_null(text))
    folder, checkpoint = tables.folder("digests"), tables.folder("digest-state")
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), digest(body).alias("digest"), sha256(body).alias("text_sha256"), F.monotonically_increasing_id().alias("row_no"), F.input_file_name().alias("locator"))
    narrow.write.parquet(folder)
    stream = spark.readStream.schema(narrow.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    # Written as a table: reading the state opens its stores anew each time.
    state = tables.write(seen(stream, checkpoint), "seen")
    rows = spark.read.schema(narrow.schema).parquet(folder)
    out = rows.join(state, "digest").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256", "digest")
    hits = tables.write(state.filter("group_size > 1").select("digest"), "hits")
    may_be = hit_filter(hits)
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), digest(body).alias("digest"), sha256(body).alias("text_sha256"), body.alias("body")).filter(may_be(F.col("digest")))
    shared = _shared_digests(texts)
    if shared.take(1):
        out = out.join(shared, "digest", "left_anti").unionByName(_by_bytes(texts.join(shared, "digest")))
    return out, may_be


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 1000, tables: Tables | None = None) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256."""
    return _found(docs, key, text, digest, files_per_trigger, tables or Tables(docs.sparkSession))[0].drop("digest")


def _by_bytes(texts: DataFrame) -> DataFrame:
    """The same answer from whole texts, for digests that several texts share."""
    group = Window.partitionBy("digest", "body")
    first = group.orderBy(F.col("doc_id").desc_nulls_last())
    return texts.select("doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.row_number().over(first) == 1).alias("kept"), "text_sha256", "digest")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """The rows that stay, with all their own columns; one for each distinct text.

    Of rows that repeat the id and the normalised text that stay, the one with the smallest text as it was
    written stays; where those are equal too, any one of them.  Rows whose text stands alone stay where they are.
    """
    name = lambda id_, sha: F.xxhash64(F.coalesce(id_.cast("string"), F.lit("")), sha)
    answers, may_be = _found(docs, key, text, sha256, 1000, tables or Tables(docs.sparkSession))
    found = answers.filter("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias("own_name"), F.col("text_sha256").alias("own_sha"), F.col("doc_id").alias("stay_id"))
    raw = F.col(text).cast("string")
    marked = docs.select(F.struct("*").alias("own_row"), F.col(key).cast("bigint").alias("own_id"), sha256(lower_ascii(empty_if_null(raw))).alias("own_sha")).withColumn("may_be", may_be(F.col("own_sha")))
    rows = marked.filter("may_be").withColumn("own_name", name(F.col("own_id"), F.col("own_sha")))
    # Both the join and the grouping deal by name and digest, so whole rows are moved once: written as
    # a null-safe equality, the ids would be further keys of the join, and the grouping would move them again.
    same_id = F.coalesce(rows["own_id"] == found["stay_id"], rows["own_id"].isNull() & found["stay_id"].isNull())
    same = (rows["own_name"] == found["own_name"]) & (rows["own_sha"] == found["own_sha"]) & same_id
    joined = rows.join(found, same, "left_semi")
    several = joined.groupBy("own_name", "own_sha").agg(F.min_by("own_row", F.coalesce(F.col("own_row").getField(text).cast("string"), F.lit(""))).alias("own_row"))
    return marked.filter(~F.col("may_be")).select("own_row.*").unionByName(several.select("own_row.*"))
