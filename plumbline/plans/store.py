"""Relational queries over stored reports and counters: feeds, counts, pivots, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import logs

SORTS = {
    "desc": [("submitted_at", False)], "asc": [("submitted_at", True)],
    "most": [("report_count", False), ("submitted_at", False)], "least": [("report_count", True), ("submitted_at", False)],
}
SMALL_CELL = 20


def feed(reports: DataFrame, search: str | None = None, columns: tuple[str, ...] = (), kind: str | None = None, since: Column | None = None, sort: str = "desc", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of public reports; ``id`` breaks ties, so pages never overlap."""
    df = reports.filter("suspect = 0")
    if kind:
        df = df.filter(F.col("type") == kind)
    if since is not None:
        df = df.filter(F.col("submitted_at") >= since)
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.col(c).ilike(f"%{search}%")
        df = df.filter(hit)
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in SORTS[sort]]
    return df.orderBy(*order, F.col("id").asc()).offset(max(0, offset)).limit(min(max(1, limit), 100))


def by_day(df: DataFrame, ts: str, name: str = "day") -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias(name)).agg(F.count("*").alias("n"))


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """Counters per key, as an upsert per event would leave them."""
    return df.groupBy(*keys).agg(F.count("*").alias("value"))


def suppressed(counters: DataFrame, least: int = SMALL_CELL) -> DataFrame:
    """Cells small enough to point at someone are left out."""
    return counters.filter(F.col("value") >= least)


def surface_breakdown(events: DataFrame, surface: str, outcome: str, outcomes: tuple[str, ...]) -> DataFrame:
    """Per surface: the count of each named outcome and of all others."""
    named = [F.sum(F.when(F.col(outcome) == o, 1).otherwise(0)).alias(o) for o in outcomes]
    other = F.sum(F.when(F.col(outcome).isin(*outcomes), 0).otherwise(1)).alias("other")
    return events.groupBy(surface).agg(*named, other)


def with_share(df: DataFrame, value: str, of: str | None = None) -> DataFrame:
    """Adds a value's share of the total; the input is one row for each group."""
    total = F.sum(value).over(Window.partitionBy(of) if of else Window.partitionBy(F.lit(1)))
    return df.withColumn("share", F.round(F.col(value) / total, 6))


def match_counts(reports: DataFrame, identifier: str, order: str) -> DataFrame:
    """Reports with how many share their identifier so far and in all; an identifier of any size is
    numbered in ranges and counted before it is dealt."""
    totals = reports.groupBy(F.col(identifier).alias("own_identifier")).agg(F.count("*").alias("report_count"))
    rows = logs.numbered(reports, identifier, [order])
    return rows.join(totals, F.col(identifier).eqNullSafe(F.col("own_identifier"))).drop("own_identifier")
