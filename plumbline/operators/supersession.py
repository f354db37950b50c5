"""Rules as a table: which were hit, which of them silence others, what the rest scores, and what is wrong with the table.

``rules`` has rule, ordinal, channels (null: all), reads, weights (channel or 'default' to points) and
supersedes.  A rule survives when no surviving rule that was hit with it supersedes it; the members
of a cycle among the rules that were hit are all silenced and silence nothing.  That depends only on the set of rules
hit, so it is worked out once for each set that occurs, by joins that are repeated until nothing changes, and joined back.

Defined cases: rules that are not in the table score nothing; a rule without a weight for the channel scores 0; a null
scale is 1; rows that repeat a hit count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

#: What a context of each channel can carry; fixed values.
CARRIED = {
    "sms": ("original", "body", "matches", "hostname", "url"), "custom": ("original", "body", "matches", "hostname", "url"), "url": ("original", "body", "matches", "hostname", "url"),
    "email": ("original", "body", "matches", "hostname", "url", "headers"), "phone": ("original", "body", "phone"),
}
CHANNELS = tuple(CARRIED)


def closure(edges: DataFrame, within: list[str] | None = None) -> DataFrame:
    """All pairs (a, b) such that edges lead from a to b, each set of ``within`` by itself.

    Paths double in length each round, so rounds grow with the logarithm of the longest path.  Steps
    are cut with checkpoints in the shared folder.
    """
    keys = within or []
    known = cut(edges.select(*keys, "a", "b").distinct())
    count = known.count()
    while True:
        ahead = known.select(*keys, F.col("a").alias("mid"), F.col("b").alias("far"))
        longer = known.withColumnRenamed("b", "mid").join(ahead, [*keys, "mid"]).select(*keys, "a", F.col("far").alias("b"))
        known = cut(known.unionByName(longer).distinct())
        before, count = count, known.count()
        if count == before:
            return known


def survivors(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """set_id, rule, survives for every rule of some sets (set_id, rule); ``edges`` has a, which supersedes b."""
    own = sets.select("set_id", "rule").distinct()
    side = lambda c: own.select("set_id", F.col("rule").alias(c))
    live = cut(edges.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["set_id", "b"]).select("set_id", "a", "b"))
    cyclic = closure(live, ["set_id"]).filter("a = b").select("set_id", F.col("a").alias("rule"), F.lit(False).alias("decided"))
    state = cut(own.join(cyclic, ["set_id", "rule"], "left").select("set_id", "rule", F.col("decided").alias("survives")))
    while True:
        # A claimant counts once it is decided: one that survives silences, and when all are silenced the rule survives.
        claims = live.join(state.select("set_id", F.col("rule").alias("a"), F.col("survives").alias("claimant")), ["set_id", "a"])
        told = claims.groupBy("set_id", F.col("b").alias("rule")).agg(F.max("claimant").alias("any"), F.count_if(F.col("claimant").isNull()).alias("open"))
        answer = F.when(F.col("survives").isNotNull(), F.col("survives")).when(F.col("any"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(state.join(told, ["set_id", "rule"], "left").select("set_id", "rule", answer.alias("survives")))
        if not state.filter("survives IS NULL").limit(1).count():
            return state


def weight(weights: Column, channel: Column) -> Column:
    """The channel's own weight, else the default one, else 0."""
    return F.coalesce(F.try_element_at(weights, channel), F.try_element_at(weights, F.lit("default")), F.lit(0.0))


def runs_on(channels: Column, channel: Column) -> Column:
    return channels.isNull() | F.array_contains(channels, channel)


def scored(hits: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each hit that counts: ``hits`` has the keys, channel, rule, nth and scale.

    A rule's hits are rounded together: each takes what the running total, rounded, adds, so that they sum
    to the rounded whole.
    """
    table = rules.select("rule", "ordinal", "channels", "weights")
    rows = hits.join(table, "rule").filter(runs_on(F.col("channels"), F.col("channel")))
    fired = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("rule")).alias("fired"))
    sets = fired.select("fired").distinct().select(F.xxhash64("fired").alias("set_id"), F.explode("fired").alias("rule"))
    edges = rules.select(F.col("rule").alias("a"), F.explode("supersedes").alias("b"))
    kept = survivors(sets, edges).filter("survives").select("set_id", "rule")
    named = rows.join(fired.select(*keys, F.xxhash64("fired").alias("set_id")), keys).join(kept, ["set_id", "rule"])
    order = Window.partitionBy(*keys, "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.floor(F.sum(weight(F.col("weights"), F.col("channel")) * F.coalesce("scale", F.lit(1.0))).over(order) + 0.5)
    named = named.withColumn("running", running)
    earlier = F.coalesce(F.lag("running").over(Window.partitionBy(*keys, "rule").orderBy("nth")), F.lit(0))
    return named.select(*keys, "rule", "ordinal", "nth", (F.col("running") - earlier).cast("int").alias("points"))


def problems(rules: DataFrame, tokenised: tuple[str, ...] = ()) -> DataFrame:
    """rule, problem, detail: rules listed twice, inputs that no channel carries, channels without a weight, and
    supersession that is dangling, never meets or goes in a circle."""
    own = rules.withColumn("on", F.coalesce("channels", F.array(*map(F.lit, CHANNELS))))
    carried = F.create_map(*(x for c in CHANNELS for x in (F.lit(c), F.array(*map(F.lit, (*CARRIED[c], *(("words",) if c in tokenised else ())))))))
    twice = own.groupBy("rule").agg(F.count("*").alias("n")).filter("n > 1").select("rule", F.lit("listed twice").alias("problem"), F.lit("").alias("detail"))
    reach = F.array_distinct(F.flatten(F.transform("on", lambda c: F.coalesce(F.try_element_at(carried, c), F.array().cast("array<string>")))))
    unread = own.select("rule", F.array_join(F.array_except("reads", reach), ",").alias("detail")).filter("detail <> ''").select("rule", F.lit("unreachable input").alias("problem"), "detail")
    bare = F.filter("on", lambda c: F.try_element_at(F.col("weights"), c).isNull() & F.try_element_at(F.col("weights"), F.lit("default")).isNull())
    unweighted = own.select("rule", F.array_join(bare, ",").alias("detail")).filter("detail <> ''").select("rule", F.lit("no weight").alias("problem"), "detail")
    edges = own.select("rule", "on", F.explode("supersedes").alias("target"))
    other = own.select(F.col("rule").alias("target"), F.col("on").alias("other_on")).dropDuplicates(["target"])
    met = edges.join(other, "target", "left")
    dangling = met.filter("other_on IS NULL").select("rule", F.lit("supersedes unknown").alias("problem"), F.col("target").alias("detail"))
    apart = met.filter((F.col("rule") != F.col("target")) & (F.size(F.array_intersect("on", "other_on")) == 0)).select("rule", F.lit("supersedes apart").alias("problem"), F.col("target").alias("detail"))
    circle = closure(met.filter("other_on IS NOT NULL").select(F.col("rule").alias("a"), F.col("target").alias("b"))).filter("a = b").select(F.col("a").alias("rule"), F.lit("cycle").alias("problem"), F.lit("").alias("detail"))
    return twice.unionByName(unread).unionByName(unweighted).unionByName(dangling).unionByName(apart).unionByName(circle).distinct()
