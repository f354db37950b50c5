"""Evaluation of a scorer on labelled rows: confusion metrics, intervals, slices, ratchets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def prediction(verdict: Column, covered: Column, suspicious_as: str = "flagged") -> Column:
    """flagged, clean or abstain; what is not covered abstains."""
    return F.when(~covered | (verdict == "unknown"), "abstain").when(verdict == "likely_scam", "flagged").when(verdict == "suspicious", suspicious_as).otherwise("clean")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """One end of the 95 % Wilson interval, within 0 and 1; null without cases."""
    p = hits / n
    middle = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    end = (middle + half if upper else middle - half) / (1 + Z * Z / n)
    return F.when(n > 0, F.greatest(F.least(end, F.lit(1.0)), F.lit(0.0)))


def confusion(predicted: Column, scam: Column) -> list[Column]:
    return [
        F.count_if(scam & (predicted == "flagged")).alias("tp"), F.count_if(scam & (predicted == "clean")).alias("fn"),
        F.count_if(~scam & (predicted == "flagged")).alias("fp"), F.count_if(~scam & (predicted == "clean")).alias("tn"),
        F.count_if(predicted == "abstain").alias("abstained"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    decided = tp + fn + fp + tn
    out = {
        "recall": _rate(tp, tp + fn), "recall_low": wilson(tp, tp + fn, False), "recall_high": wilson(tp, tp + fn, True),
        "fpr": _rate(fp, fp + tn), "precision": _rate(tp, tp + fp), "coverage": _rate(decided, decided + F.col("abstained")),
    }
    return counts.withColumns({k: F.round(v, 6) for k, v in out.items()})


def metrics(cases: DataFrame, predicted: str = "predicted", scam: str = "scam") -> DataFrame:
    return with_rates(cases.agg(*confusion(F.col(predicted), F.col(scam))))


def slices(cases: DataFrame, keys: list[str], predicted: str = "predicted", scam: str = "scam") -> DataFrame:
    """The same figures for each key alone and for both together, in one pass."""
    a, b = keys
    grouped = cases.groupingSets([[a], [a, b], [b]], a, b).agg(*confusion(F.col(predicted), F.col(scam)))
    return with_rates(grouped)


def lower_percentile(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """sorted[floor((n - 1) * p)] of each group: equal values are counted first, then summed up in
    order by window, so a task holds a group's distinct values and not its rows."""
    from pyspark.sql.window import Window

    counts = df.groupBy(key, value).agg(F.count("*").alias("here"))
    by, zero = Window.partitionBy(key), F.lit(0).cast("bigint")
    upto = F.sum("here").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.select(key, value, "here", upto.alias("upto"), F.coalesce(F.sum("here").over(by), zero).alias("n"))
    at = F.floor((F.col("n") - 1) * F.lit(p))
    return ranked.filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("here"))).select(key, F.col(value).alias("percentile"), "n")


def flips(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Cases that were right before and are wrong now; both have keys, predicted and right."""
    old = before.select(*keys, F.col("predicted").alias("was"), F.col("right").alias("was_right"))
    return now.join(old, keys).filter(F.col("was_right") & ~F.col("right")).drop("was_right")


def flips_beside(cases: DataFrame, keys: list[str], before: Column) -> DataFrame:
    """As ``flips``, where one table holds both scorers' cases and ``before`` tells the older: only rows that may
    be a flip are moved, once, and a key's rows are set beside one another without a second reading of the texts."""
    may = F.when(before, F.col("right")).otherwise(~F.col("right"))
    rows = cases.filter(may).filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*keys, before.alias("older"), "predicted")
    listed = lambda own: F.collect_list(F.when(own, F.col("predicted")))
    found = rows.groupBy(*keys).agg(listed(F.col("older")).alias("old"), listed(~F.col("older")).alias("now"))
    return found.select(*keys, F.explode("old").alias("was"), "now").select(*keys, "was", F.explode("now").alias("predicted"))


def breaches(figures: DataFrame, limits: tuple[tuple[str, float, bool], ...]) -> DataFrame:
    """metric, value, outcome: held, breached, or inconclusive where the limit lies within the interval."""
    parts = {"recall": ("tp", "fn"), "fpr": ("fp", "tn"), "precision": ("tp", "fp")}
    rows = []
    for metric, bound, at_least in limits:
        hits, n = F.col(parts[metric][0]), F.col(parts[metric][0]) + F.col(parts[metric][1])
        value = F.round(_rate(hits, n), 6)
        held = value >= bound if at_least else value <= bound
        within = (wilson(hits, n, False) <= bound) & (wilson(hits, n, True) >= bound)
        rows.append(F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.when(held, "held").when(within, "inconclusive").otherwise("breached").alias("outcome")))
    return figures.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
