"""Counters that a stream adds up in a table, each batch once however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter


def bucketed(events: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Values that are not among those known count as other; null does as well."""
    return events.withColumn(column, F.when(F.col(column).isin(*known), F.col(column)).otherwise("other"))


def counted_into(stream: DataFrame, path: str, keys: list[str]) -> DataStreamWriter:
    """A writer that counts each batch by its keys and keeps the counts under the batch's own number.

    A batch that is replayed after a failure replaces what it had written, so every event counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("value")).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    return stream.writeStream.foreachBatch(merge)


def counters(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The counters as they stand: the sums of all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("value").alias("value"))


def compacted(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """The counters in one batch in another folder, for a stream that starts anew there."""
    counters(spark, path, keys).write.mode("overwrite").parquet(f"{target}/batch_no=-1")
