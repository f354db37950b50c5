"""Hosts in prose, other forms of listed words, and rules that silence each other, over whole tables.

The SQL of each query is written by hand and finds the same rows another way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .dialect import DUCK
from .functions import hosts, stems, text
from .operators import supersession
from .query_messages import MESSAGES, _messages
from .registry import query, quoted, rows_sql, table

# -- hosts ----------------------------------------------------------------------------------
#: One of these stands before each document's text: hosts, and what looks like one.
HOST_TEXTS = (
    "Login at commbank-secure-login.top/auth today", "claim now at freemoney.top", "claim now at freemoney.top urgently", "Pay at secure-billing.top now, see auspost.com.au/track.", "AUSPOST-TRACK.XYZ/verify!",
    "the plumber came by.Work is done", "tune in.click for more", "sign up here.quest registration closes", "send the notes.org file, our team is dev.io", "archive.zip and http://evil.zip/get?x=foo.bar/baz",
    "www.аuspost-redelivery.icu/pay (a.b@mail.top) dir/file.top", "Mum is in hospital.ICU visiting hours", "see \"www.bank.com\" or <x.y.example.com/a>", "Δelta-billing.icu/1 and node.js, README.md, e.g. No.5", "evil.top, worse.xyz; a-b.click",
)


def _prefixed(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lead = F.get(F.array(*map(F.lit, HOST_TEXTS)), F.pmod("doc_id", F.lit(len(HOST_TEXTS))).cast("int"))
    return docs.select("doc_id", F.concat(lead, F.lit(" \n"), F.coalesce("text", F.lit(""))).alias("text"))


_L, _S = r"A-Za-z0-9\x{0370}-\x{03FF}\x{0400}-\x{052F}", r" \t\n\x0B\f\r\x{00A0}"
_SEEN = rf"(?:^|[^A-Za-z0-9_@./\\-])(?:[{_L}](?:[{_L}-]*[{_L}])?\.)+[A-Za-z]{{2,24}}(?:/[^{_S}<>\"'']*)?"


@query(f"""WITH d AS (SELECT doc_id, {DUCK.at(DUCK.array(HOST_TEXTS), f'doc_id % {len(HOST_TEXTS)}')} || ' ' || chr(10) || coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM (SELECT doc_id, regexp_extract_all(t, '[{_S}]*[^{_S}]+') AS l FROM d)),
p AS (SELECT doc_id, z[2] AS tok, sum(length(z[2])) OVER w - length(z[2]) AS base, lead(z[2]) OVER w AS following FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY z[1])),
c AS (SELECT *, regexp_extract_all(tok, '{_SEEN}') AS m, regexp_split_to_array(tok, '{_SEEN}') AS gaps FROM p WHERE regexp_matches(tok, '{_SEEN}')),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM c),
y AS (SELECT *, regexp_replace(m[i], '^[^{_L}]', '') AS found, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0) + length(m[i]) AS stop FROM x),
h AS (SELECT doc_id, base, tok, following, stop, found, CASE WHEN contains(found, '/') THEN split_part(found, '/', 1) ELSE found END AS host, contains(found, '/') OR starts_with(lower(found), 'www.') AS backed FROM y),
r AS (SELECT *, string_split(lower(host), '.') AS labels, regexp_extract(host, '[^.]*$') AS ending FROM h)
SELECT doc_id, CAST(base + stop - length(found) AS INT) AS start, CAST(base + stop AS INT) AS "end", host, CASE WHEN contains(found, '/') THEN substr(found, length(host) + 1) END AS path FROM r
WHERE NOT regexp_matches(left(tok, CAST(stop - length(found) AS INT)), '(?i)https?://') AND NOT regexp_matches(ending, '^[A-Z][a-z]')
AND NOT (len(labels) = 2 AND NOT backed AND (labels[1] IN ({quoted(hosts.PROSE)}) OR (regexp_matches(labels[1], '^[a-z]+$') AND stop = length(tok) AND regexp_matches(coalesce(following, ''), '^[{_S}]+[A-Za-z]'))))
AND (lower(ending) IN ({quoted(lexicon.ABUSED_TLDS)}) OR lower(ending) IN ({quoted(hosts.MAINSTREAM)}))
AND (backed OR (lower(ending) IN ({quoted(lexicon.ABUSED_TLDS)}) AND lower(ending) NOT IN ({quoted(hosts.AMBIGUOUS)})))""")
def bare_hosts(spark, sf_dir):
    """Every host without a scheme in every document: its place, name and path."""
    found = hosts.candidates(_prefixed(spark, sf_dir), "text")
    return found.select("doc_id", F.explode(hosts.accepted(F.col("candidates"), lexicon.ABUSED_TLDS)).alias("h")).select("doc_id", "h.start", "h.end", "h.host", "h.path")


@query()
def prose_texts(spark, sf_dir):
    """Every document without its links, addresses and hosts, as a digest; no SQL: what one replacement
    leaves is searched by the next."""
    return hosts.without_link_text(_prefixed(spark, sf_dir), "text", lexicon.ABUSED_TLDS).select("doc_id", F.sha2("prose", 256).alias("prose_sha256"), F.length("prose").alias("n_chars"))


# -- stems ----------------------------------------------------------------------------------
#: Other forms of the entries, and words that only look like them.
STEM_TEXTS = (
    "please verifies your account", "it was referred to the team", "the card was frozen", "shipped and shaping", "we crossed and spelled it", "the invoice was paid", "preferred supplies for companies", "committing to transferring funds",
    "stolen goods", "he bought and sold", "permitted replies", "caught in deliveries",
)
STEM_ENTRIES = ("verify", "refer", "freeze", "supply", "company", "commit", "transfer", "steal", "catch", "permit", "reply", "delivery", "pay", "ship", "gift card", "prefer")


@query(f"""WITH m AS (SELECT conv_id, turn, {DUCK.at(DUCK.array(STEM_TEXTS), f'(conv_id * 7 + turn) % {len(STEM_TEXTS)}')} || '. ' || coalesce(text, '') AS text FROM conversations),
g AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM m),
e AS (SELECT * FROM g WHERE NOT (len(w) >= 10 AND len(list_filter(w, lambda x: x IN ({quoted(lexicon.ENGLISH_STOP_WORDS)}))) / len(w)::DOUBLE < 0.08)),
s AS (SELECT DISTINCT conv_id, turn, unnest(w) AS word FROM e),
{rows_sql([(x,) for x in STEM_ENTRIES if " " not in x], "entry", "n")},
{rows_sql(stems.IRREGULAR.items(), "form, verb", "irregular")},
every_word AS (SELECT word AS x FROM s WHERE length(word) > 4 UNION SELECT entry FROM n WHERE length(entry) > 4),
st AS (SELECT x, CASE WHEN verb IS NOT NULL THEN verb WHEN regexp_matches(x, '[^aeiou]ies$') THEN left(x, length(x) - 3) || 'y'
 WHEN regexp_matches(x, '(?:{'|'.join(c + c for c in 'bcdfghjkmnpqrtvwxyz')})(?:ed|ing)$') AND regexp_matches(left(x, length(x) - CASE WHEN x LIKE '%ed' THEN 3 ELSE 4 END), '[^aeiou][aeiou][^aeiou]$')
 THEN left(x, length(x) - CASE WHEN x LIKE '%ed' THEN 3 ELSE 4 END) ELSE x END AS stem FROM every_word LEFT JOIN irregular ON form = x)
SELECT DISTINCT conv_id, turn, entry FROM s JOIN st a ON a.x = s.word JOIN st b ON b.stem = a.stem JOIN n ON n.entry = b.x""")
def stem_mentions(spark, sf_dir):
    """Entries of which a message has some form with the same stem, in messages that read as English."""
    turns = table(spark, sf_dir, "conversations")
    lead = F.get(F.array(*map(F.lit, STEM_TEXTS)), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(STEM_TEXTS))).cast("int"))
    rows = turns.select("conv_id", "turn", F.concat(lead, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))
    foreign = (F.size(text.words_of(F.col("text"))) >= 10) & (text.stop_word_share(F.col("text"), lexicon.ENGLISH_STOP_WORDS) < 0.08)
    entries = spark.createDataFrame([(e,) for e in STEM_ENTRIES], "entry string")
    return stems.found_by_stem(rows, ["conv_id", "turn"], "text", entries, foreign)


# -- rules as a table -----------------------------------------------------------------------
#: rule, channels, inputs, weights by channel, what it supersedes, pattern: chains, a circle and a target that never meets.
RULES = (
    ("run.windows", ("sms", "email"), ("body",), {"default": 50.0}, ("run.terminal",), r"\bwin(?:dows)?\s?\+\s?r\b"), ("run.terminal", None, ("body",), {"default": 50.0}, (), r"\b(?:terminal|paste)\b"),
    ("urgent.final", None, ("body",), {"sms": 25.0, "default": 15.0}, ("urgent.soon",), r"\b(?:final|suspended|overdue)\b"), ("urgent.soon", None, ("body",), {"default": 12.5}, ("urgent.any",), r"\b(?:now|today|urgent)\b"), ("urgent.any", None, ("body",), {"default": 7.0}, (), r"\b(?:please|act|notice)\b"),
    ("prize.gift", None, ("matches",), {"default": 20.0}, ("prize.cash",), r"\b(?:gift|prize)\b"), ("prize.cash", None, ("matches",), {"default": 20.0}, ("prize.won",), r"\b(?:cash|winnings|claim)\b"), ("prize.won", None, ("matches",), {"default": 20.0}, ("prize.gift", "urgent.any"), r"\b(?:won|lottery|jackpot)\b"),
    ("link.any", ("sms",), ("url",), {"sms": 15.0}, (), r"https?://\S+"), ("call.any", ("sms", "phone"), ("body",), {"sms": 10.5, "phone": 0.0}, ("link.any", "mail.header"), r"\bcall\b"), ("mail.header", ("email",), ("headers",), {"email": 30.0}, (), r"\bfrom:"),
)
RULE_SCHEMA = "rule string, ordinal int, channels array<string>, reads array<string>, weights map<string,double>, supersedes array<string>, pattern string"


def rule_table(spark) -> DataFrame:
    rows = [(r, i, None if c is None else list(c), list(reads), dict(w), list(s), p) for i, (r, c, reads, w, s, p) in enumerate(RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


_RULES_SQL = rows_sql([(r, i, p, c is None or "sms" in c, float(w.get("sms", w.get("default", 0.0)))) for i, (r, c, _, w, _, p) in enumerate(RULES)], "rule, ordinal, pattern, sms, weight", "rules")
_EDGES_SQL = rows_sql([(r, b) for r, _, _, _, s, _ in RULES for b in s], "a, b", "edges")
_TURNS = " ".join(f", s{i + 1} AS (SELECT f.* FROM live f WHERE NOT EXISTS (SELECT 1 FROM s{i} c JOIN edges e ON e.a = c.rule WHERE c.conv_id = f.conv_id AND c.turn = f.turn AND e.b = f.rule))" for i in range(6))


@query(f"""WITH RECURSIVE {MESSAGES}, {_RULES_SQL}, {_EDGES_SQL},
found AS (SELECT conv_id, turn, rule, ordinal, weight, unnest(range(1, n + 1)) AS nth FROM (SELECT conv_id, turn, rule, ordinal, weight, len(regexp_extract_all(lower(text), pattern)) AS n FROM msgs JOIN rules ON sms)),
fired AS (SELECT DISTINCT conv_id, turn, rule FROM found),
met AS (SELECT x.conv_id, x.turn, e.a, e.b FROM edges e JOIN fired x ON x.rule = e.a JOIN fired y ON y.rule = e.b AND y.conv_id = x.conv_id AND y.turn = x.turn),
reach(conv_id, turn, a, b) AS (SELECT * FROM met UNION SELECT r.conv_id, r.turn, r.a, m.b FROM reach r JOIN met m ON m.conv_id = r.conv_id AND m.turn = r.turn AND m.a = r.b),
live AS (SELECT f.* FROM fired f ANTI JOIN (SELECT conv_id, turn, a AS rule FROM reach WHERE a = b) c USING (conv_id, turn, rule)),
s0 AS (SELECT * FROM live WHERE FALSE){_TURNS},
p AS (SELECT f.*, floor(sum(weight / nth) OVER (PARTITION BY f.conv_id, f.turn, f.rule ORDER BY nth) + 0.5) AS running FROM found f JOIN s6 USING (conv_id, turn, rule))
SELECT conv_id, turn, rule, CAST(nth AS INT) AS nth, CAST(running - coalesce(lag(running) OVER (PARTITION BY conv_id, turn, rule ORDER BY nth), 0) AS INT) AS points FROM p""")
def rule_hits(spark, sf_dir):
    """Points of every hit of a table of rules on every message; repeated hits of a rule count less and less."""
    rules = rule_table(spark)
    rows = _messages(spark, sf_dir).select("conv_id", "turn", F.lit("sms").alias("channel"), F.lower("text").alias("low"))
    # Rules are a fixed table; each is one column, so a message is searched once for each.
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.regexp_count("low", F.lit(p)).alias("n")) for r, _, _, _, _, p in RULES))
    hits = rows.select("conv_id", "turn", "channel", F.explode(each).alias("h")).filter("h.n > 0")
    hits = hits.select("conv_id", "turn", "channel", "h.rule", F.explode(F.sequence(F.lit(1), F.col("h.n"))).alias("nth")).withColumn("scale", 1 / F.col("nth").cast("double"))
    return supersession.scored(hits, rules, ["conv_id", "turn"]).select("conv_id", "turn", "rule", "nth", "points")
