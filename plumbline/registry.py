"""The engine's queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores.  A table of few bytes is read by few tasks, one where its file is a
    single row group; where a row's text takes milliseconds, moving it is the lesser cost."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def rows_sql(rows, columns: str, name: str) -> str:
    """Literal rows as a named table of a WITH part."""
    value = lambda v: "NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    listed = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {listed})"
