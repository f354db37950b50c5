"""Logs of keys in pieces: places, totals and segments without ever having a key in one task.

Rows are dealt to ranges of (key, order) and sorted there, so a key that holds a third of all rows
lies in many ranges.  Each range counts for itself; what the ranges before it add is one row a range.
The dealt rows are cut with a checkpoint, since ranges are drawn by sampling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .lineage import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    by = [F.col(c).asc_nulls_first() for c in order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def _counted(df: DataFrame, key: str, seconds: str | None, gap: float | None) -> DataFrame:
    """The rows of sorted ranges with range_no and, counted within the range, ``breaks`` (changes of the key and gaps
    of its log) and ``place`` (rows of the key before)."""
    schema = T.StructType([*df.schema.fields]).add("range_no", "integer").add("breaks", "long").add("place", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, last, when, breaks, place = TaskContext.get().partitionId(), True, None, None, 0, -1
        for batch in batches:
            out_breaks, out_place = [], []
            times = batch.column(seconds).to_pylist() if seconds else [None] * batch.num_rows
            for k, t in zip(batch.column(key).to_pylist(), times):
                if not first:
                    changed = k != last
                    breaks += changed or (gap is not None and t - when >= gap)
                    place = -1 if changed else place
                place += 1
                first, last, when = False, k, t
                out_breaks.append(breaks)
                out_place.append(place)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([number] * n, pa.int32()), pa.array(out_breaks, pa.int64()), pa.array(out_place, pa.int64())], [*batch.schema.names, "range_no", "breaks", "place"])

    return cut(df.mapInArrow(count, schema))


def segments(df: DataFrame, key: str, seconds: str, tie: str, gap: float, name: str = "segment") -> DataFrame:
    """Adds a number that rows of a key share while no two neighbours of its log are ``gap`` or more apart.

    A decision that looks back less than ``gap`` seconds can be taken in each segment by itself.
    """
    rows = _counted(_ranged(df, [key, seconds, tie]), key, seconds, gap)
    at = F.struct(seconds, tie)
    ranges = rows.groupBy("range_no").agg(F.max("breaks").alias("own"), F.min_by(F.struct(F.col(key).alias("k"), F.col(seconds).alias("s")), F.struct("breaks", at)).alias("first"), F.max_by(F.struct(F.col(key).alias("k"), F.col(seconds).alias("s")), F.struct("breaks", at)).alias("last"))
    # One row for each range: as many as tasks, however many rows there are.
    order = Window.orderBy("range_no")
    before = F.lag("last").over(order)
    starts_anew = F.when(before.isNull(), 0).when(~before["k"].eqNullSafe(F.col("first.k")) | (F.col("first.s") - before["s"] >= gap), 1).otherwise(0)
    offset = F.sum(F.col("anew") + F.coalesce("earlier", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = ranges.withColumn("anew", starts_anew).withColumn("earlier", F.lag("own").over(order)).select("range_no", offset.alias("offset"))
    return rows.join(F.broadcast(ranges), "range_no").withColumn(name, F.col("breaks") + F.col("offset")).select(*df.columns, name)


def numbered(df: DataFrame, key: str, order: list[str], name: str = "nth") -> DataFrame:
    """Adds each row's place in its key's log, from 1, for keys of any size."""
    rows = _counted(_ranged(df, [key, *order]), key, None, None)
    # A range's rows of its first key stand behind the same key's rows in earlier ranges.
    ends = rows.groupBy(F.col("range_no").alias("own_range"), F.col(key).alias("own_key")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("own_key").orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1))
    # Of a key one row for each range that it lies in.
    starts = ends.select("own_range", "own_key", F.coalesce(before, F.lit(0)).alias("before"))
    joined = rows.join(starts, (F.col("range_no") == F.col("own_range")) & F.col(key).eqNullSafe(F.col("own_key")))
    return joined.withColumn(name, F.col("place") + F.col("before") + 1).select(*df.columns, name)
