"""Weighted rules as columns: evidence, deferred rules, discounts, clamping, verdicts.

A rule is data: an id, a condition and points.  All rules of a channel are evaluated in one
projection; what fired is an array of structs, so a score can always be explained.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SUSPICIOUS, LIKELY_SCAM, MOST = 20, 45, 100


@dataclass(frozen=True)
class Rule:
    """``deferred`` points count only beside other evidence; ``silenced_by`` names a stronger rule."""

    rule_id: str
    condition: Column
    points: int | Column
    source: str = "message"
    deferred: int = 0
    silenced_by: str | None = None


def checked(rules: list[Rule]) -> list[Rule]:
    """The rules, once ids are unique and silencing names rules that no other rule silences."""
    ids = [r.rule_id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("two rules share an id")
    silenced = {r.rule_id for r in rules if r.silenced_by}
    for r in rules:
        if r.silenced_by and (r.silenced_by not in ids or r.silenced_by in silenced):
            raise ValueError(f"{r.rule_id} is silenced by {r.silenced_by}, which is unknown or silenced itself")
    return rules


def evidence(rules: list[Rule]) -> Column:
    """What fired, in the rules' order: rule_id, points, source, deferred."""
    by_id = {r.rule_id: r for r in checked(rules)}
    rows = []
    for r in rules:
        fires = F.coalesce(r.condition, F.lit(False))
        if r.silenced_by:
            fires = fires & ~F.coalesce(by_id[r.silenced_by].condition, F.lit(False))
        points = F.lit(r.points) if isinstance(r.points, int) else r.points
        rows.append(F.when(fires, F.struct(F.lit(r.rule_id).alias("rule_id"), points.cast("int").alias("points"), F.lit(r.source).alias("source"), F.lit(r.deferred).alias("deferred"))))
    return F.array_compact(F.array(*rows))


def settled(found: Column) -> Column:
    """Deferred rows get their points if any other row scores."""
    backed = F.exists(found, lambda s: (s["points"] > 0) & (s["deferred"] == 0))
    return F.transform(found, lambda s: F.struct(s["rule_id"].alias("rule_id"), F.when(backed & (s["deferred"] > 0), s["deferred"]).otherwise(s["points"]).alias("points"), s["source"].alias("source"), s["deferred"].alias("deferred")))


def total(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda t, s: t + s["points"])


def score(found: Column) -> Column:
    return F.greatest(F.least(total(settled(found)), F.lit(MOST)), F.lit(0))


def verdict(points: Column) -> Column:
    return F.when(points < SUSPICIOUS, "safe").when(points < LIKELY_SCAM, "suspicious").otherwise("likely_scam")


def covered_verdict(points: Column, full_coverage: Column) -> Column:
    """Safe needs full coverage, else nothing is known."""
    v = verdict(points)
    return F.when((v == "safe") & ~full_coverage, "unknown").otherwise(v)


def discounted(sub_score: Column, full: Column, factor: float) -> Column:
    """An inner score within an outer one: ``full`` points at full weight, the rest at ``factor``, rounded down."""
    rest = F.greatest(sub_score - full, F.lit(0))
    return (F.floor(rest * F.lit(factor)) + full).cast("int")


def verdict_rank(v: Column) -> Column:
    return F.when(v == "likely_scam", 3).when(v == "suspicious", 2).when(v == "unknown", 1).otherwise(0)
