"""Sources and sinks: link blocklists, labelled cases, hashed lists, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url as U

CASE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "region", "content", "label", "category", "source", "addedAt")])


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Hosts of a quoted link list: comments skipped, third field the link, fourth its state."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.regexp_replace("value", '^"|"$', ""), '","')
    rows = lines.select(parts.alias("f")).filter(F.size("f") >= 4).filter(F.get("f", F.lit(3)) == "online")
    return rows.select(U.host(F.get("f", F.lit(2))).alias("host")).filter("host <> ''").distinct()


def hashed(hosts: DataFrame) -> DataFrame:
    """What is handed to clients: truncated hashes, no hosts."""
    return hosts.select(U.host_hash(F.col("host")).alias("host_hash")).distinct()


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled cases of JSON lines, and the lines that are none, with what is wrong."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parsed = lines.withColumn("c", F.from_json("value", CASE))
    wrong = F.array_compact(F.array(
        F.when(F.coalesce("c.id", F.lit("")) == "", "no id"), F.when(F.trim(F.coalesce("c.content", F.lit(""))) == "", "no content"),
        F.when(~F.coalesce(F.col("c.label").isin("scam", "benign"), F.lit(False)), "label"),
        F.when(~F.coalesce(F.col("c.type").isin("url", "sms", "email", "phone", "qr", "custom"), F.lit(False)), "type"),
        F.when(F.try_to_timestamp("c.addedAt", F.lit("yyyy-MM-dd")).isNull(), "date"),
    ))
    judged = parsed.withColumn("errors", wrong)
    return judged.filter(F.size("errors") == 0).select("c.*"), judged.filter(F.size("errors") > 0).select("file", "value", "errors")


def append(df: DataFrame, path: str, partition_by: str = "day") -> None:
    df.write.mode("append").partitionBy(partition_by).parquet(path)
