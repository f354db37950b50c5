"""Sliding-window rate limits and first-anchored duplicate filters, in batch and as streams.

Both feed decisions back into state, so neither is a plain window count.  In batch, a key's log is cut where
nothing happens for a window, which no decision looks across; the segments are dealt, not the keys, so
a key with a third of all rows is decided in several tasks, and each task holds only the current segment's
last accepted times (at most the limit).  A log without any such gap is one segment: its decisions hang
together.  As streams, state is kept by key and goes when the watermark has passed its window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import logs

WINDOW_SECONDS = 600


def _dealt(df: DataFrame, key: str, seconds: str, tie: str, window: float) -> DataFrame:
    """Rows with their key's segment, segment by segment in order."""
    return logs.segments(df, key, seconds, tie, window, "own_segment").repartition("own_segment").sortWithinPartitions("own_segment", seconds, tie)


def rate_limited(df: DataFrame, key: str, seconds: str, tie: str, limit: int, window: int = WINDOW_SECONDS, name: str = "accepted") -> DataFrame:
    """Adds whether a row is accepted: fewer than ``limit`` accepted rows of its key in the window
    before it.  Rejected rows leave no trace.  ``seconds`` is a number, ``tie`` orders equal times."""
    schema = T.StructType([*df.schema.fields]).add("own_segment", "long").add(name, "boolean")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column("own_segment").to_pylist(), batch.column(seconds).to_pylist()):
                if k != current:
                    current = k
                    taken.clear()
                while taken and taken[0] <= t - window:
                    taken.popleft()
                out.append(len(taken) < limit)
                if out[-1]:
                    taken.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, name])

    return _dealt(df, key, seconds, tie, window).mapInArrow(decide, schema).drop("own_segment")


def first_seen(df: DataFrame, key: str, seconds: str, tie: str, ttl: int = WINDOW_SECONDS, name: str = "duplicate") -> DataFrame:
    """Adds whether a row repeats a key first seen less than ``ttl`` before; a repeat does not renew it."""
    schema = T.StructType([*df.schema.fields]).add("own_segment", "long").add(name, "boolean")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchor = object(), None
        for batch in batches:
            out = []
            for k, t in zip(batch.column("own_segment").to_pylist(), batch.column(seconds).to_pylist()):
                if k != current:
                    current, anchor = k, None
                again = anchor is not None and t - anchor < ttl
                out.append(again)
                if not again:
                    anchor = t
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, name])

    return _dealt(df, key, seconds, tie, ttl).mapInArrow(decide, schema).drop("own_segment")


def rate_limited_stream(events: DataFrame, key: str, seconds: str, limit: int, window: int = WINDOW_SECONDS) -> DataFrame:
    """The limiter over a stream: key, seconds, accepted.

    State is the accepted times in the window; it goes once the watermark, a window behind the latest
    event, has passed the last of them by a window.  Rows later than the watermark are left out.
    """

    def decide(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = []
        for t in sorted(float(x) for f in frames for x in f[seconds]):
            taken = [x for x in taken if x > t - window]
            ok = len(taken) < limit
            if ok:
                taken.append(t)
            rows.append((k[0], t, ok))
        state.update((taken,))
        if taken:
            state.setTimeoutTimestamp(max(int((max(taken) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, seconds, "accepted"])

    kind = events.schema[key].dataType.simpleString()
    output = f"{key} {kind}, {seconds} double, accepted boolean"
    timed = events.withColumn("own_ts", F.timestamp_seconds(seconds)).withWatermark("own_ts", f"{window} seconds")
    return timed.groupBy(key).applyInPandasWithState(decide, output, "taken array<double>", "append", "EventTimeTimeout")


def peeked(df: DataFrame, asked: DataFrame, key: str, seconds: str, limit: int, window: int = WINDOW_SECONDS, name: str = "allowed") -> DataFrame:
    """Whether a hit at each time ``asked`` about would be accepted, with nothing recorded: ``df`` has the
    accepted hits, of which each counts for the asks in the window behind it."""
    # An ask meets the hits of its own and the earlier window-long bucket only.
    bucket = lambda t: F.floor(t / window)
    rows = asked.withColumn("own_ask", F.monotonically_increasing_id()).withColumn("own_bucket", F.explode(F.array(bucket(F.col(seconds)), bucket(F.col(seconds)) - 1)))
    hits = df.select(F.col(key).alias("hit_key"), F.col(seconds).alias("hit_at"), bucket(F.col(seconds)).alias("hit_bucket"))
    near = (F.col("hit_at") <= F.col(seconds)) & (F.col("hit_at") > F.col(seconds) - window)
    met = rows.join(hits, (F.col(key) == F.col("hit_key")) & (F.col("own_bucket") == F.col("hit_bucket")), "left")
    counted = met.groupBy("own_ask", *asked.columns).agg(F.count_if(near).alias("n"))
    return counted.select(*asked.columns, (F.col("n") < limit).alias(name))


def without_repeats_stream(events: DataFrame, key: str, ts: str, ttl: str = "10 minutes") -> DataFrame:
    """First sightings of a key; state goes when the watermark passes ``ttl`` after them."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def counters_stream(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("value"))


def guard(df: DataFrame, text: str, key: str, seconds: str, tie: str, limit: int) -> DataFrame:
    """The submission ladder: the first rung that a row fails names its outcome.  The limiter only
    sees rows that reach its rung, and the duplicate filter only those that the limiter lets by."""
    t = F.coalesce(F.col(text), F.lit(""))
    early = F.when(F.trim(t) == "", "missing").when(F.length(t) > 8000, "too_long")
    rows = df.withColumn("rung", early)
    out = rows.filter("rung IS NOT NULL")
    limited = rate_limited(rows.filter("rung IS NULL"), key, seconds, tie, limit)
    out = out.unionByName(limited.filter("NOT accepted").withColumn("rung", F.lit("rate")).drop("accepted"))
    body = F.substring(F.lower(F.regexp_replace(F.substring(t, 1, 200), r"\s+", " ")), 1, 200)
    unique = first_seen(limited.filter("accepted").drop("accepted").withColumn("body_key", body), "body_key", seconds, tie)
    rest = unique.withColumn("rung", F.when(F.col("duplicate"), "duplicate").otherwise("accept")).drop("duplicate", "body_key")
    return out.unionByName(rest)
