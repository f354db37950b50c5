"""What the operators share: shared scratch folders, bounded slices of Arrow batches, prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of text that a task holds in expanded form at a time.
SLICE_BYTES = 8_000_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The session's spark.checkpoint.dir is used; where it is unset, a local session (as in tests)
    gets a folder of its own, and any other session is refused, since executors share no disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read often, made once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are written, as it does
    whenever the driver collects garbage; a driver with memory to spare does so seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Tables:
    """Tables that a job writes to the shared folder and drops after their last reader."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[tuple[DataFrame | None, str, str | None]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path, schema = scratch(self.spark, label), df.schema
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(schema).parquet(path)
        self._paths.append((table, path, None))
        return table

    def write_bucketed(self, df: DataFrame, label: str, key: str) -> DataFrame:
        """A table dealt by a key once, so that joins on the key never shuffle it again."""
        path, buckets = scratch(self.spark, label), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
        table = self.spark.table(name)
        self._paths.append((table, path, name))
        return table

    def folder(self, label: str) -> str:
        """A folder that is deleted with the tables."""
        path = scratch(self.spark, label)
        self._paths.append((None, path, None))
        return path

    def close(self, reader: DataFrame | None = None) -> None:
        """Deletes all that is left, but for what a reader still reads."""
        read = reader.inputFiles() if reader is not None and self._paths else []
        for held in [x for x in self._paths if not any(x[1].rsplit("/", 1)[1] in f for f in read)]:
            self._delete(held)

    def _delete(self, held: tuple[DataFrame | None, str, str | None]) -> None:
        self._paths.remove(held)
        if held[2]:
            self.spark.sql(f"DROP TABLE IF EXISTS {held[2]}")
        delete(self.spark, held[1])

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            for held in [x for x in self._paths if table is not None and x[0] is table]:
                self._delete(held)


def empty_if_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it was."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, *more: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of few text bytes each; a longer text makes a piece of its own."""
    import pyarrow.compute as pc

    try:
        for batch in batches:
            sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in (column, *more)).tolist()
            start, held = 0, 0
            for i, n in enumerate(sizes):
                if i > start and held + n > limit:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n
            if batch.num_rows > start:
                yield batch.slice(start)
    finally:
        # Python workers outlive their tasks: what Arrow has freed goes back, not into the next task's way.
        pa.default_memory_pool().release_unused()


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def sort_key(column: Column) -> Column:
    return column.asc_nulls_first()


def prefix_sums(df: DataFrame, order: list[str], value: str, name: str, within: str | None = None, total: str | None = None, tables: Tables | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come before, for any number of rows.

    Rows are dealt to ranges of ``order`` and sorted there; each range sums its own rows, the totals
    of the ranges (one row each) are summed in turn, and no task holds more than a range.  With
    ``within``, a leading column of ``order``, sums start anew at each of its values; ``total`` then
    names a column for the sum over all rows of the value.  ``tables`` keeps the written step.
    """
    spark = df.sparkSession
    keys = [sort_key(F.col(c)) for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = T.StructType([*df.schema.fields]).add("range_no", "integer").add(name, "long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, group = task_number(), 0, None
        for batch in batches:
            out = []
            groups = batch.column(within).to_pylist() if within else [None] * batch.num_rows
            for v, g in zip(batch.column(value).to_pylist(), groups):
                if g != group:
                    held, group = 0, g
                out.append(held)
                held += v
            columns = [*batch.columns, pa.array([number] * batch.num_rows, pa.int32()), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "range_no", name])

    summed = dealt.mapInArrow(sums, fields)
    part = tables.write(summed, "prefix") if tables else written(summed, "prefix")
    by = [within] if within else []
    totals = part.groupBy("range_no", *by).agg(F.sum(value).alias("range_total"))
    before = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range (and group): as many as there are tasks, however many rows there are.
    starts = totals.select("range_no", *by, F.coalesce(F.sum("range_total").over(before), F.lit(0)).alias("range_start"), *([F.sum("range_total").over(Window.partitionBy(*by)).alias(total)] if total else []))
    # Groups whose number has no bound are joined by shuffle; (range, group) holds a range's rows at most.
    joined = part.join(starts if total else F.broadcast(starts), ["range_no", *by])
    return joined.withColumn(name, F.col(name) + F.col("range_start")).select(*df.columns, name, *([total] if total else []))
