"""Intervals packed into as few lanes as overlap at once: the earliest start first, into the lowest free lane.

Where no interval of a key is open all lanes are free, so a key's intervals fall into busy periods that
are packed by themselves, each in the task that its period is dealt to; a task holds the lanes of one
period, which are as many as overlap.

Defined cases: an interval without a start or an end has no lane (null) and takes none; an end is not part of its interval;
one that ends before it starts counts as empty at its start; equal starts go by ``tie``; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def packed(df: DataFrame, key: str, start: str, end: str, tie: str, name: str = "lane") -> DataFrame:
    """Adds the lane of each interval, from 0."""
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    rows = df.filter(whole).withColumn("own_start", F.col(start).cast("timestamp").cast("double")).withColumn("own_end", F.greatest(F.col(start), F.col(end)).cast("timestamp").cast("double"))
    by = Window.partitionBy(key).orderBy("own_start", tie)
    busy = F.max("own_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own_period", F.when(busy.isNull() | (F.col("own_start") >= busy), 1).otherwise(0))
    rows = rows.withColumn("own_period", F.sum("own_period").over(by))
    dealt = rows.repartition(key, "own_period").sortWithinPartitions(key, "own_period", "own_start", tie)
    schema = T.StructType([*dealt.schema.fields]).add(name, "integer")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ends, free, lanes = None, [], [], 0
        for batch in batches:
            out = []
            for k, p, a, b in zip(*(batch.column(c).to_pylist() for c in (key, "own_period", "own_start", "own_end"))):
                if (k, p) != current:
                    current, ends, free, lanes = (k, p), [], [], 0
                while ends and ends[0][0] <= a:
                    heapq.heappush(free, heapq.heappop(ends)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, lanes = lanes, lanes + 1
                heapq.heappush(ends, (b, lane))
                out.append(lane)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, name])

    found = dealt.mapInArrow(place, schema).select(*df.columns, name)
    return found.unionByName(df.filter(~whole).withColumn(name, F.lit(None).cast("int")))
