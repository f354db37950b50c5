"""Queries over messages: every conversation turn with one of the built messages before it."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lexicon, lures
from .dialect import DUCK, SPARK, phrases
from .operators import messages as M
from .plans import evaluation as E
from .registry import query, quoted, rows_sql, spread, table

N = len(lures.MESSAGES)
_PICK = f"(conv_id * 31 + turn) % {N}"


def _messages(spark, sf_dir, keyless: bool = False) -> DataFrame:
    """``keyless``: rows without a key, to which no built message is dealt, have their own text."""
    turns = spread(table(spark, sf_dir, "conversations"))
    at = ((F.col("conv_id") * 31 + F.col("turn")) % N).cast("int")
    lure = F.get(F.array(*(F.lit(t) for _, t in lures.MESSAGES)), at)
    label = F.get(F.array(*(F.lit(n) for n, _ in lures.MESSAGES)), at)
    before = F.concat(lure, F.lit(". "))
    return turns.select("conv_id", "turn", "role", F.concat(F.coalesce(before, F.lit("")) if keyless else before, F.coalesce("text", F.lit(""))).alias("text"), label.alias("label"))


_LURE = f"{DUCK.at(DUCK.array(t for _, t in lures.MESSAGES), _PICK)} || '. '"


def _messages_sql(lure: str) -> str:
    return f"msgs AS (SELECT conv_id, turn, role, {lure} || coalesce(text, '') AS text, {DUCK.at(DUCK.array(n for n, _ in lures.MESSAGES), _PICK)} AS label FROM conversations)"


MESSAGES = _messages_sql(_LURE)
SCORED = f"WITH RECURSIVE {MESSAGES}, {M.scored_sql(DUCK, 'msgs')}"


def _scored(spark, sf_dir, region=None, channel="sms") -> DataFrame:
    return M.scored(_messages(spark, sf_dir), "text", region, channel)


@query(f"{SCORED} SELECT conv_id, turn, score, verdict, evidence FROM scored")
def message_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("conv_id", "turn", "score", "verdict", "evidence")


@query(f"WITH {MESSAGES}, {M.scored_sql(DUCK, 'msgs', 'text', 'GB')} SELECT conv_id, turn, score, verdict, coverage, evidence FROM scored")
def message_scores_gb(spark, sf_dir):
    return _scored(spark, sf_dir, "GB").select("conv_id", "turn", "score", "verdict", "coverage", "evidence")


@query(f"{SCORED} SELECT conv_id, turn, base, score - base AS settled, pending FROM scored")
def deferred_rules(spark, sf_dir):
    """Deferred points count beside others; alone they stay pending."""
    return _scored(spark, sf_dir).select("conv_id", "turn", "base", (F.col("score") - F.col("base")).alias("settled"), "pending")


@query(f"WITH {MESSAGES}, {M.scored_sql(DUCK, 'msgs', 'text', None, 'email')} SELECT conv_id, turn, CAST(floor(greatest(score - full_points, 0) * CAST(0.7 AS DOUBLE)) + least(full_points, 100) AS INT) AS merged FROM scored")
def discounted_merge(spark, sf_dir):
    """A message within a mail: the rules that escape the discount in full, the rest at 0.7."""
    rest = F.floor(F.greatest(F.col("score") - F.col("full_points"), F.lit(0)) * F.lit(0.7))
    return _scored(spark, sf_dir, None, "email").select("conv_id", "turn", (rest + F.least("full_points", F.lit(100))).cast("int").alias("merged"))


_SHARES = """x AS (SELECT conv_id, turn, score, full_points, unnest(string_split(evidence, ',')) AS e FROM scored WHERE evidence <> ''),
y AS (SELECT conv_id, turn, e, string_split(e, ':')[1] AS rule_id, CAST(string_split(e, ':')[2] AS INT) AS points, score, full_points FROM x)"""
_FULL = [r.rule_id for r in M.rules(None) if r.full]


@query(f"""{SCORED}, {_SHARES}, z AS (SELECT *, rule_id NOT IN ({quoted(_FULL)}) AS cut, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rule_id) AS k FROM y),
b AS (SELECT *, CAST(floor(greatest(score - full_points, 0) * CAST(0.7 AS DOUBLE)) AS INT) AS budget, sum(CASE WHEN cut THEN points ELSE 0 END) OVER p AS cut_total, sum(CASE WHEN cut THEN points ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY k) AS upto FROM z WINDOW p AS (PARTITION BY conv_id, turn))
SELECT conv_id, turn, rule_id, CAST(CASE WHEN NOT cut THEN points ELSE floor(budget * upto / cut_total::DOUBLE) - floor(budget * (upto - points) / cut_total::DOUBLE) END AS INT) AS share FROM b""")
def discounted_shares(spark, sf_dir):
    """How the discounted budget is dealt to rules: cumulative rounding, so that shares add up to it."""
    each = _evidence(_scored(spark, sf_dir))
    cut = ~F.col("rule_id").isin(_FULL)
    row = Window.partitionBy("conv_id", "turn")
    own = F.when(cut, F.col("points")).otherwise(0)
    upto = F.sum(own).over(row.orderBy("rule_id").rowsBetween(Window.unboundedPreceding, 0))
    total, budget = F.sum(own).over(row), F.floor(F.greatest(F.col("score") - F.col("full_points"), F.lit(0)) * F.lit(0.7))
    share = F.floor(budget * upto / total) - F.floor(budget * (upto - F.col("points")) / total)
    return each.select("conv_id", "turn", "rule_id", F.when(cut, share).otherwise(F.col("points")).cast("int").alias("share"))


def _evidence(scored: DataFrame) -> DataFrame:
    each = scored.filter("evidence <> ''").withColumn("e", F.explode(F.split("evidence", ",")))
    return each.withColumn("rule_id", F.split("e", ":")[0]).withColumn("points", F.split("e", ":")[1].cast("int")).drop("e")


_RULES = [(r.rule_id, r.deferred, r.full) for r in M.rules(None)]


@query(f"{SCORED}, {_SHARES}, {rows_sql(_RULES, 'rule_id, deferred, is_full', 'r')} SELECT r.rule_id, r.deferred, r.is_full, count(y.points) AS hits, coalesce(sum(y.points), 0)::BIGINT AS points FROM r LEFT JOIN y ON r.rule_id = y.rule_id GROUP BY ALL")
def rule_inventory(spark, sf_dir):
    """Every rule with how often it fired, rules that never did included."""
    known = spark.createDataFrame(_RULES, "rule_id string, deferred int, is_full boolean")
    hits = _evidence(_scored(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("hits"), F.sum("points").alias("points"))
    return known.join(hits, "rule_id", "left").select("rule_id", "deferred", "is_full", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("hits", "points")))


_RANK = "CASE verdict WHEN 'likely_scam' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
def _rank():
    return F.expr(_RANK)


@query(f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {_RANK} DESC, turn) AS k FROM scored) SELECT conv_id, turn AS worst_turn, verdict, score FROM r WHERE k = 1")
def worst_turn(spark, sf_dir):
    """The first turn of the worst verdict."""
    best = F.max(F.struct(_rank().alias("rank"), (-F.col("turn")).alias("before"), "verdict", "score")).alias("w")
    return _scored(spark, sf_dir).groupBy("conv_id").agg(best).select("conv_id", (-F.col("w.before")).alias("worst_turn"), "w.verdict", "w.score")


@query(f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {_RANK} DESC, score DESC, turn) AS k FROM scored) SELECT conv_id, turn AS worst_turn, score FROM r WHERE k = 1")
def worst_identifier(spark, sf_dir):
    """The worst card of an evaluation: rank, then score, then the first."""
    best = F.max(F.struct(_rank().alias("rank"), "score", (-F.col("turn")).alias("before"))).alias("w")
    return _scored(spark, sf_dir).groupBy("conv_id").agg(best).select("conv_id", (-F.col("w.before")).alias("worst_turn"), "w.score")


@query(f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place FROM scored) SELECT conv_id, place, turn, score FROM r WHERE place <= 5")
def top_cards(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "turn")
    return _scored(spark, sf_dir).withColumn("place", F.row_number().over(by)).filter("place <= 5").select("conv_id", F.col("place").cast("bigint").alias("place"), "turn", "score")


@query(f"{SCORED}, {_SHARES}, p AS (SELECT conv_id, rule_id, max(points) AS points FROM y GROUP BY ALL) SELECT conv_id, count(*) AS n_signals, CAST(least(sum(points), 100) AS INT) AS pooled, sum(points) > 100 AS clamped FROM p GROUP BY conv_id")
def pooled_evidence(spark, sf_dir):
    """The distinct signals of all turns, added up and clamped."""
    each = _evidence(_scored(spark, sf_dir)).groupBy("conv_id", "rule_id").agg(F.max("points").alias("points"))
    return each.groupBy("conv_id").agg(F.count("*").alias("n_signals"), F.least(F.sum("points"), F.lit(100)).cast("int").alias("pooled"), (F.sum("points") > 100).alias("clamped"))


_COVER = "CASE coverage WHEN 'none' THEN 3 WHEN 'minimal' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END"


@query(f"""{SCORED}, c AS (SELECT conv_id, max({_RANK}) AS rank, max(score) AS score, bool_and(verdict = 'safe') AS safe, max({_COVER}) AS cover, conv_id % 7 = 0 AS pixel FROM scored GROUP BY conv_id)
SELECT conv_id, CASE WHEN pixel AND rank < 2 THEN 'suspicious' ELSE ['safe', 'unknown', 'suspicious', 'likely_scam'][rank + 1] END AS verdict, CAST(CASE WHEN pixel THEN greatest(score, 40) ELSE score END AS INT) AS score,
safe AND NOT pixel AS is_clean, ['full', 'partial', 'minimal', 'none'][cover + 1] AS coverage FROM c""")
def overall_verdict(spark, sf_dir):
    """A conversation's verdict; a tracking pixel (here: every seventh conversation) lifts it to suspicious."""
    c = _scored(spark, sf_dir).groupBy("conv_id").agg(F.max(_rank()).alias("rank"), F.max("score").alias("score"), F.bool_and(F.col("verdict") == "safe").alias("safe"), F.max(F.expr(_COVER)).alias("cover"))
    pixel, names = F.col("conv_id") % 7 == 0, F.array(*map(F.lit, ("safe", "unknown", "suspicious", "likely_scam")))
    verdict = F.when(pixel & (F.col("rank") < 2), "suspicious").otherwise(F.get(names, F.col("rank")))
    return c.select("conv_id", verdict.alias("verdict"), F.when(pixel, F.greatest("score", F.lit(40))).otherwise(F.col("score")).alias("score"), (F.col("safe") & ~pixel).alias("is_clean"), F.get(F.array(*map(F.lit, ("full", "partial", "minimal", "none"))), F.col("cover")).alias("coverage"))


@query(f"{SCORED} SELECT conv_id, turn, concat_ws(',', {', '.join(f'''CASE WHEN regexp_matches(evidence, '(?:{p})[a-z_]*:') THEN '{n}' END''' for n, p in lexicon.TACTICS)}) AS tactics FROM scored")
def message_tactics(spark, sf_dir):
    found = [F.when(F.col("evidence").rlike(f"(?:{p})[a-z_]*:"), n) for n, p in lexicon.TACTICS]
    return _scored(spark, sf_dir).select("conv_id", "turn", F.concat_ws(",", *found).alias("tactics"))


@query(f"WITH {MESSAGES} SELECT conv_id, turn, concat_ws(',', {', '.join(f'''CASE WHEN regexp_matches(lower(text[:100000]), '\\b{p}\\b') THEN '{n}' END''' for n, p in lexicon.PRESSURE)}) AS tactics FROM msgs")
def pressure_tactics(spark, sf_dir):
    low = F.lower(F.substring("text", 1, 100_000))  # longer texts are judged by their beginning: a documented bound
    return _messages(spark, sf_dir).select("conv_id", "turn", F.concat_ws(",", *(F.when(low.rlike(rf"\b{p}\b"), n) for n, p in lexicon.PRESSURE)).alias("tactics"))


_KEYWORDS = tuple(dict.fromkeys((*lexicon.BASE["urgency"], *lexicon.BASE["reward"], *lexicon.BASE["ask"])))
_CUSTOM = f"""CAST(greatest(least(100, least(8 * {{distinct}}, 60) + CASE WHEN {{platform}} THEN 50 ELSE 0 END + CASE WHEN {{again}} THEN 25 ELSE 0 END + CASE WHEN {{link}} THEN 8 ELSE 0 END), 10) AS INT)"""


def _custom(d) -> str:
    parts = {"distinct": d.distinct("lower(text)", phrases(_KEYWORDS)), "platform": d.has("lower(text)", phrases(lexicon.BASE["platforms"])), "again": d.has("lower(text)", phrases(lexicon.BASE["reregistration"])), "link": d.has("lower(text)", "http://")}
    return _CUSTOM.format(**parts)


@query(f"WITH {MESSAGES} SELECT conv_id, turn, {_custom(DUCK)} AS score FROM msgs")
def custom_text(spark, sf_dir):
    """Text of no known kind: distinct keywords, platforms, a plain link at half weight, at least 10."""
    return _messages(spark, sf_dir).selectExpr("conv_id", "turn", f"{_custom(SPARK)} AS score")


def _unique_authorities() -> list[tuple[str, str]]:
    seen: dict[str, list[str]] = {}
    for region, p in lexicon.PACKS.items():
        for a in p["authority"]:
            seen.setdefault(a, []).append(region)
    return sorted(((a, r[0]) for a, r in seen.items() if len(r) == 1), key=lambda x: (-len(x[0]), x[0]))


def _region(d) -> tuple[str, str]:
    phone = d.replace(d.extract("text", M.NUMBER), "[^0-9]", "")
    by_phone = "CASE " + " ".join(f"WHEN phone LIKE '{p['plan']}%' THEN '{r}'" for r, p in sorted(lexicon.PACKS.items(), key=lambda x: -len(x[1]["plan"])) if p["plan"] and r != "CA") + " END"
    by_host = "CASE " + " ".join(f"WHEN {d.has('low', 'https?://[^/ ]*' + p['official_suffix'].replace('.', chr(92) + '.') + '(?:[/ ]|$)')} THEN '{r}'" for r, p in lexicon.PACKS.items() if p["official_suffix"]) + " END"
    by_name = "CASE " + " ".join(f"WHEN {d.has('low', phrases([a], False))} THEN '{r}'" for a, r in _unique_authorities()) + " END"
    return f"{phone} AS phone, lower(text) AS low", f"{by_phone} AS by_phone, {by_host} AS by_host, {by_name} AS by_name"


_CHOSEN = "coalesce(by_phone, by_host, by_name, 'ZZ') AS region, CASE WHEN by_phone IS NOT NULL THEN 'phone' WHEN by_host IS NOT NULL THEN 'tld' WHEN by_name IS NOT NULL THEN 'authority' ELSE 'none' END AS confidence"


@query(f"WITH {MESSAGES}, a AS (SELECT *, {_region(DUCK)[0]} FROM msgs), b AS (SELECT *, {_region(DUCK)[1]} FROM a) SELECT conv_id, turn, {_CHOSEN} FROM b")
def target_region(spark, sf_dir):
    """Whom a message is aimed at: by phone number, national suffix, then an authority that one region alone claims."""
    first, second = _region(SPARK)
    return _messages(spark, sf_dir).selectExpr("*", first.split(" AS phone")[0] + " AS phone", "lower(text) AS low").selectExpr("conv_id", "turn", *[x + " AS " + n for x, n in _named(second)]).selectExpr("conv_id", "turn", _CHOSEN.split(", CASE")[0], "CASE" + _CHOSEN.split(", CASE")[1])


def _named(listed: str) -> list[tuple[str, str]]:
    out, rest = [], listed
    for name in ("by_phone", "by_host", "by_name"):
        part, rest = rest.split(f" AS {name}", 1)
        out.append((part.lstrip(", "), name))
    return out


# -- evaluation -----------------------------------------------------------------------------
_PREDICTED = "CASE WHEN coverage <> 'full' OR verdict = 'unknown' THEN 'abstain' WHEN verdict = 'safe' THEN 'clean' ELSE 'flagged' END"
CASES = f"{SCORED}, c AS (SELECT conv_id, turn, role, label = 1 AS scam, score, {_PREDICTED} AS predicted, CAST({_PICK} AS VARCHAR) AS kind FROM scored)"
COUNTS = """count(*) FILTER (WHERE scam AND predicted = 'flagged') AS tp, count(*) FILTER (WHERE scam AND predicted = 'clean') AS fn,
 count(*) FILTER (WHERE NOT scam AND predicted = 'flagged') AS fp, count(*) FILTER (WHERE NOT scam AND predicted = 'clean') AS tn, count(*) FILTER (WHERE predicted = 'abstain') AS abstained"""


def _wilson_sql(hits: str, n: str, sign: str) -> str:
    z = E.Z
    return f"CASE WHEN {n} > 0 THEN greatest(least(({hits} / {n}::DOUBLE + {z * z}::DOUBLE / (2 * {n}) {sign} {z}::DOUBLE * sqrt({hits} / {n}::DOUBLE * (1 - {hits} / {n}::DOUBLE) / {n} + {z * z}::DOUBLE / (4 * {n} * {n}))) / (1 + {z * z}::DOUBLE / {n}), 1.0), 0.0) END"


RATES = f"""round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round({_wilson_sql("tp", "(tp + fn)", "-")}, 6) AS recall_low, round({_wilson_sql("tp", "(tp + fn)", "+")}, 6) AS recall_high,
 round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round((tp + fn + fp + tn) / nullif(tp + fn + fp + tn + abstained, 0)::DOUBLE, 6) AS coverage"""


def _cases(spark, sf_dir, region=None) -> DataFrame:
    scored = _scored(spark, sf_dir, region)
    predicted = E.prediction(F.col("verdict"), F.col("coverage") == "full")
    return scored.select("conv_id", "turn", "role", (F.col("label") == 1).alias("scam"), "score", predicted.alias("predicted"), ((F.col("conv_id") * 31 + F.col("turn")) % N).cast("string").alias("kind"))


@query(f"{CASES}, m AS (SELECT {COUNTS} FROM c) SELECT *, {RATES} FROM m")
def eval_metrics(spark, sf_dir):
    return E.metrics(_cases(spark, sf_dir))


@query(f"{CASES}, m AS (SELECT role, kind, {COUNTS} FROM c GROUP BY GROUPING SETS ((role), (role, kind), (kind))) SELECT *, {RATES} FROM m")
def eval_slices(spark, sf_dir):
    return E.slices(_cases(spark, sf_dir), ["role", "kind"])


@query(f"{CASES} SELECT role, list_sort(list(score))[CAST(floor((count(*) - 1) * CAST(0.95 AS DOUBLE)) AS INT) + 1] AS percentile, count(*) AS n FROM c GROUP BY role")
def eval_percentile(spark, sf_dir):
    return E.lower_percentile(_cases(spark, sf_dir), "role", "score", 0.95)


_LIMITS = (("recall", 0.8, True), ("fpr", 0.1, False), ("precision", 0.995, True))


@query(f"""{CASES}, m AS (SELECT {COUNTS} FROM c), n AS (SELECT 'recall' AS metric, tp AS hits, tp + fn AS n FROM m UNION ALL SELECT 'fpr', fp, fp + tn FROM m UNION ALL SELECT 'precision', tp, tp + fp FROM m),
{rows_sql(_LIMITS, 'metric, bound, at_least', 'l')}, w AS (SELECT metric, bound, at_least, round(hits / n::DOUBLE, 6) AS value, {_wilson_sql('hits', 'n', '-')} AS low, {_wilson_sql('hits', 'n', '+')} AS high FROM n JOIN l USING (metric))
SELECT metric, value, CASE WHEN at_least AND value >= bound OR NOT at_least AND value <= bound THEN 'held' WHEN bound BETWEEN low AND high THEN 'inconclusive' ELSE 'breached' END AS outcome FROM w""")
def eval_thresholds(spark, sf_dir):
    """Limits held, breached, or inconclusive where the limit lies within the interval."""
    return E.breaches(E.metrics(_cases(spark, sf_dir)), _LIMITS)


@query(f"""{CASES}, {M.scored_sql(DUCK, 'msgs', 'text', 'GB', 'sms', 'gb')}, o AS (SELECT conv_id, turn, {_PREDICTED} AS later FROM gb)
SELECT c.conv_id, c.turn, predicted AS before, later AS after FROM c JOIN o USING (conv_id, turn) WHERE (predicted = 'flagged') = scam AND predicted <> 'abstain' AND NOT ((later = 'flagged') = scam AND later <> 'abstain')""")
def eval_flips(spark, sf_dir):
    """Cases that this region's rules (the baseline) get right and another region's get wrong."""
    old = lexicon.DEFAULT_REGION
    rows = M.scored_by_region(_messages(spark, sf_dir), (old, "GB"))
    rows = rows.withColumn("predicted", E.prediction(F.col("verdict"), F.col("coverage") == "full"))
    right = ((F.col("predicted") == "flagged") == (F.col("label") == 1)) & (F.col("predicted") != "abstain")
    cases = rows.select("conv_id", "turn", "region", "predicted", right.alias("right"))
    return E.flips_beside(cases, ["conv_id", "turn"], F.col("region") == old).select("conv_id", "turn", F.col("was").alias("before"), F.col("predicted").alias("after"))


@query(f"{CASES} SELECT kind, scam, predicted, count(*) AS n, min(conv_id * 1000 + turn) AS first_case FROM c WHERE predicted = 'abstain' OR (predicted = 'flagged') <> scam GROUP BY ALL")
def eval_misses(spark, sf_dir):
    wrong = _cases(spark, sf_dir).filter((F.col("predicted") == "abstain") | ((F.col("predicted") == "flagged") != F.col("scam")))
    return wrong.groupBy("kind", "scam", "predicted").agg(F.count("*").alias("n"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_case"))


#: Transforms that must not change a score, or not weaken it: name, equal, expression over text in each dialect.
def _transforms(d, c: str = "text") -> dict[str, tuple[bool, str]]:
    """name -> whether the score must stay the same (else: must not fall), and the rewritten text."""
    wide, digits = "".join(chr(0xFF10 + i) for i in range(10)), "0123456789"
    ref = d.ref
    return {
        "phone-e164": (True, d.replace(c, r"[+]([0-9]) [(]([0-9]{3})[)] ([0-9]{3})-([0-9]{4})", f"+{ref(1)}{ref(2)}{ref(3)}{ref(4)}")), "phone-spacing": (True, d.replace(c, r"[+]([0-9]) [(]([0-9]{3})[)] ", f"+{ref(1)} {ref(2)} ")),
        "host-case": (True, d.replace(c, "https://", "HTTPS://")), "host-trailing-dot": (True, d.replace(c, r"(https?://[^\s/]+)/", f"{ref(1)}./")), "tracking-parameters": (True, d.replace(c, r"(https?://[^\s?]+)/pay\b", f"{ref(1)}/pay?utm_source=x")),
        "whitespace": (True, d.replace(c, " ", "  ")), "defanged": (True, d.replace(d.replace(c, "http(s?)://", f"hxxp{ref(1)}://"), r"[.](com|top|xyz|click)\b", f"[.]{ref(1)}")),
        "zero-width": (False, d.replace(c, "re", "re\u200b")), "homoglyphs": (False, d.swapped(c, "ao", "\u0430\u043e")), "fullwidth-digits": (False, d.swapped(c, digits, wide)),
        "benign-padding": (False, f"concat({c}, ' See you soon, and thank you for everything.')"), "forwarded-prefix": (False, f"concat('---------- Forwarded message ---------', chr(10), {c})"), "quoted-reply": (False, f"concat('> ', {c})"),
        "punctuation": (False, d.swapped(c, "-'", "\u2010\u2019")),
    }


def _stacks(count: int = 6, seed: int = 20) -> dict[str, tuple[str, ...]]:
    """Some transforms one upon another, drawn once and for all: two to four different ones in any order."""
    draw, names, found = random.Random(seed), list(_transforms(SPARK)), {}
    while len(found) < count:
        own = tuple(draw.sample(names, draw.randrange(2, 5)))
        if frozenset(own) not in {frozenset(x) for x in found.values()}:
            found["+".join(own)] = own
    return found


def _stacked(d) -> dict[str, tuple[bool, str]]:
    """A stack keeps the score only if all of its transforms do."""
    out = {}
    for name, own in _stacks().items():
        text, equal = "text", True
        for step in own:
            same, text = _transforms(d, text)[step]
            equal = equal and same
        out[name] = (equal, text)
    return out


def _rewritten_sql(relations: dict[str, tuple[bool, str]]) -> str:
    return f"WITH {MESSAGES}, tr AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS relation, {str(eq).upper()} AS equal_to, {x} AS text FROM msgs" for n, (eq, x) in relations.items()) + f"), {M.scored_sql(DUCK, 'msgs')}, {M.scored_sql(DUCK, 'tr', 'text', None, 'sms', 'after')}"


_BROKEN = "CASE WHEN a.equal_to THEN a.score <> b.score ELSE a.score < b.score END"
_COUNTS = f"SELECT a.relation, a.equal_to, count(*) AS checked, count(*) FILTER (WHERE a.text <> b.text) AS applied, count(*) FILTER (WHERE {_BROKEN}) AS violations FROM after a JOIN scored b USING (conv_id, turn) GROUP BY ALL"


def _rewritten(spark, sf_dir, relations: dict[str, tuple[bool, str]], differing: bool = False) -> DataFrame:
    """Every message rewritten in each way, with its score before and after and whether the relation is broken."""
    after = M.rewritten(_messages(spark, sf_dir), relations, ("conv_id", "turn"), differing=differing)
    return after.withColumn("broken", F.when(F.col("equal_to"), F.col("score") != F.col("was")).otherwise(F.col("score") < F.col("was")))


def _relation_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("relation", "equal_to").agg(F.count("*").alias("checked"), F.count_if(F.col("text") != F.col("before")).alias("applied"), F.count_if("broken").alias("violations"))


@query(f"{_rewritten_sql(_transforms(DUCK))} {_COUNTS}")
def metamorphic_relations(spark, sf_dir):
    """Texts rewritten in ways that should keep, or not weaken, their score."""
    return _relation_counts(_rewritten(spark, sf_dir, _transforms(SPARK)))


@query(f"{_rewritten_sql(_transforms(DUCK))} SELECT conv_id, turn, a.relation, b.score AS was, a.score AS score FROM after a JOIN scored b USING (conv_id, turn) WHERE {_BROKEN}")
def metamorphic_violations(spark, sf_dir):
    """The messages for which a relation does not hold."""
    return _rewritten(spark, sf_dir, _transforms(SPARK), differing=True).filter("broken").select("conv_id", "turn", "relation", "was", "score")


@query(f"{_rewritten_sql(_stacked(DUCK))} {_COUNTS}")
def composite_relations(spark, sf_dir):
    """Stacks of rewritings, held to the weakest of their relations."""
    return _relation_counts(_rewritten(spark, sf_dir, _stacked(SPARK)))


_PROBES = tuple(lexicon.PACKS)
_KEYLESS = _messages_sql(f"coalesce({_LURE}, '')")
_BY_REGION = f"WITH {_KEYLESS}, " + ", ".join(M.scored_sql(DUCK, "msgs", "text", r, "sms", f"s_{r.lower()}") for r in _PROBES) + ", every_region AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, label, '{r}' AS region, score, verdict FROM s_{r.lower()}" for r in _PROBES) + ")"


@query(f"{_BY_REGION}, z AS (SELECT conv_id AS own_id, turn AS own_turn, score AS base FROM every_region WHERE region = 'ZZ') SELECT region, count(*) AS n, count(*) FILTER (WHERE score > base) AS stronger, count(*) FILTER (WHERE score < base) AS weaker, count(*) FILTER (WHERE label = 0 AND score >= 20) AS false_alarms FROM every_region JOIN z ON conv_id IS NOT DISTINCT FROM own_id AND turn IS NOT DISTINCT FROM own_turn GROUP BY region")
def region_monotonicity(spark, sf_dir):
    """The scores of every message in every region beside those without a pack: a pack should add, not take away."""
    rows = M.scored_by_region(_messages(spark, sf_dir, keyless=True), _PROBES).select("conv_id", "turn", "label", "region", "score")
    # Rows are set beside those without a pack within their key, nulls being keys too; rows that repeat a key are counted, not multiplied.
    keys = ["conv_id", "turn"]
    dealt = rows.repartition(*keys)
    counted = dealt.groupBy(*keys, "region", "label", "score").agg(F.count("*").alias("here"))
    each = counted.groupBy(*keys).agg(F.collect_list(F.struct("region", "label", "score", "here")).alias("own"))
    pairs = each.select(F.explode("own").alias("a"), "own").select("a", F.explode(F.filter("own", lambda o: o["region"] == "ZZ")).alias("z"))
    pairs = pairs.select("a.region", "a.label", "a.score", F.col("z.score").alias("base"), (F.col("a.here") * F.col("z.here")).alias("n"))
    counts = {"stronger": F.col("score") > F.col("base"), "weaker": F.col("score") < F.col("base"), "false_alarms": (F.col("label") == 0) & (F.col("score") >= 20)}
    return pairs.groupBy("region").agg(F.sum("n").alias("n"), *(F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).alias(name) for name, c in counts.items()))


# -- packs ----------------------------------------------------------------------------------
_ENTRIES = lexicon.entries()
_REGIONS = [(r, lexicon.REGION_NAMES[r], p["tier"]) for r, p in lexicon.PACKS.items()]


def _entries(spark) -> DataFrame:
    return spark.createDataFrame(_ENTRIES, "region string, list string, ordinal int, value string")


@query(f"""WITH {rows_sql(_ENTRIES, 'region, list, ordinal, value', 'e')}, {rows_sql(_REGIONS, 'region, name, tier', 'r')}, p AS (SELECT r.region, e.list, e.value, min(CASE WHEN e.region = '' THEN e.ordinal ELSE 1000 + e.ordinal END) AS place FROM r JOIN e ON e.region = r.region OR e.region = '' GROUP BY ALL)
SELECT region, list, value, row_number() OVER (PARTITION BY region, list ORDER BY place) AS ordinal FROM p""")
def pack_entries(spark, sf_dir):
    """Every region's lists: base entries first, then its own, repeats once."""
    regions = spark.createDataFrame(_REGIONS, "region string, name string, tier string").select("region")
    e = _entries(spark)
    own = e.filter("region <> ''").select("region", "list", "value", (F.col("ordinal") + 1000).alias("place"))
    base = regions.crossJoin(F.broadcast(e.filter("region = ''").select("list", "value", F.col("ordinal").alias("place"))))  # two fixed lists
    places = own.unionByName(base).groupBy("region", "list", "value").agg(F.min("place").alias("place"))
    return places.select("region", "list", "value", F.row_number().over(Window.partitionBy("region", "list").orderBy("place")).cast("bigint").alias("ordinal"))


@query(f"WITH {rows_sql(_REGIONS, 'region, name, tier', 'r')} SELECT region, name, tier, row_number() OVER (ORDER BY region = 'ZZ', name) AS place FROM r")
def region_options(spark, sf_dir):
    """The regions to choose from, by name, the fallback last."""
    rows = spark.createDataFrame(_REGIONS, "region string, name string, tier string")
    return rows.select("*", F.row_number().over(Window.orderBy(F.col("region") == "ZZ", "name")).cast("bigint").alias("place"))


_CODES = [(i * 2, r) for i, r in enumerate(lexicon.PACKS)]


@query(f"""WITH {rows_sql(_CODES, 'nation, code', 'm')}, {rows_sql(_REGIONS, 'region, name, tier', 'r')} SELECT c_custkey, r.region, r.tier FROM customer LEFT JOIN m ON nation = c_nationkey JOIN r ON r.region = coalesce(m.code, '{lexicon.DEFAULT_REGION}')""")
def region_resolution(spark, sf_dir):
    """Every customer's pack by nation; nations without one get the default."""
    m, r = spark.createDataFrame(_CODES, "nation int, code string"), spark.createDataFrame(_REGIONS, "region string, name string, tier string")
    rows = table(spark, sf_dir, "customer").join(m, F.col("c_nationkey") == F.col("nation"), "left")
    return rows.withColumn("region", F.coalesce("code", F.lit(lexicon.DEFAULT_REGION))).join(r, "region").select("c_custkey", "region", "tier")


@query(f"""WITH {rows_sql(_ENTRIES, 'region, list, ordinal, value', 'e')}, {rows_sql(_REGIONS, 'region, name, tier', 'r')}, o AS (SELECT region, count(*) FILTER (WHERE list = 'authority') AS n_authority, count(*) FILTER (WHERE list = 'urgency') AS n_urgency FROM e a WHERE region <> '' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.region = '' AND b.list = a.list AND b.value = a.value) GROUP BY region)
SELECT r.region, coalesce(n_authority, 0) AS n_authority, CASE WHEN coalesce(n_urgency, 0) > 0 THEN 'covered' WHEN coalesce(n_authority, 0) > 0 THEN 'partial' ELSE 'none' END AS covered FROM r LEFT JOIN o USING (region)""")
def language_coverage(spark, sf_dir):
    """What a region adds to the base lists, and so how far its own wording is covered."""
    e, regions = _entries(spark), spark.createDataFrame(_REGIONS, "region string, name string, tier string").select("region")
    own = e.filter("region <> ''").join(e.filter("region = ''").select("list", "value"), ["list", "value"], "left_anti")
    n = own.groupBy("region").agg(F.count_if(F.col("list") == "authority").alias("n_authority"), F.count_if(F.col("list") == "urgency").alias("n_urgency"))
    zero = F.lit(0).cast("bigint")
    covered = F.when(F.coalesce("n_urgency", zero) > 0, "covered").when(F.coalesce("n_authority", zero) > 0, "partial").otherwise("none")
    return regions.join(n, "region", "left").select("region", F.coalesce("n_authority", zero).alias("n_authority"), covered.alias("covered"))
