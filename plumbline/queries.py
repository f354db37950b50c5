"""The engine's queries on the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lexicon
from .functions import mime
from .functions import text as T
from .operators import channels as C
from .plans import store
from .registry import QUERIES, SQL, query, quoted, table  # noqa: F401
from .streaming import limits

def _scrub_sql(column: str) -> str:
    for _, pattern, holder in T.PLACEHOLDERS:
        column = f"regexp_replace({column}, '{pattern}', '{holder}', 'g')"
    return column


@query(f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed_sha256, {_scrub_sql('text')} <> text AS changed FROM documents")
def pii_redaction(spark, sf_dir):
    clean = T.scrubbed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("scrubbed_sha256"), (clean != F.col("text")).alias("changed"))


@query(f"""WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) >= 10 AND len(list_filter(w, lambda x: x IN ({quoted(lexicon.ENGLISH_STOP_WORDS)}))) / nullif(len(w), 0)::DOUBLE < 0.08 AS looks_foreign FROM w""")
def language_guess(spark, sf_dir):
    words = T.words_of(F.col("text"))
    share = T.stop_word_share(F.col("text"), lexicon.ENGLISH_STOP_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", ((F.size(words) >= 10) & (share < 0.08)).alias("looks_foreign"))


@query("SELECT o_orderkey AS id, o_orderpriority AS type FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def feed_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reports = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("submitted_at"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("suspect"))
    return store.feed(reports, "urgent", ("type",)).select("id", "type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def feed_by_day(spark, sf_dir):
    return store.by_day(table(spark, sf_dir, "events"), "ts")


@query("SELECT event_type, count(*) AS value FROM events GROUP BY 1")
def feed_by_type(spark, sf_dir):
    return store.counted(table(spark, sf_dir, "events"), "event_type")


_OUTCOMES = ("click", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{o}') AS \"{o}\"" for o in _OUTCOMES) + f", count(*) FILTER (WHERE event_type NOT IN ({quoted(_OUTCOMES)})) AS other FROM events GROUP BY 1")
def surface_breakdown(spark, sf_dir):
    return store.surface_breakdown(table(spark, sf_dir, "events"), "user_id", "event_type", _OUTCOMES)


@query("SELECT user_id, event_type, count(*) AS value FROM events GROUP BY ALL HAVING count(*) >= 20")
def small_cell_suppression(spark, sf_dir):
    return store.suppressed(store.counted(table(spark, sf_dir, "events"), "user_id", "event_type"))


_REGION_SQL = "SELECT r_name, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"


def _customer_regions(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"WITH d AS ({_REGION_SQL}) SELECT r_name, value, round(value / sum(value) OVER (), 6) AS share FROM d")
def region_demand(spark, sf_dir):
    return store.with_share(store.counted(_customer_regions(spark, sf_dir), "r_name"), "value")


@query("""SELECT r_name, strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m') AS month, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def region_month(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(_customer_regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("r_name", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 10 HOURS"), "yyyy-MM").alias("month")).agg(F.count("*").alias("value"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS report_count FROM events")
def match_count(spark, sf_dir):
    return store.match_counts(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "nth", "report_count")


def _timed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")).withColumn("seconds", F.col("micros") / 1e6)


@query()
def rate_limit_accepts(spark, sf_dir):
    return limits.rate_limited(_timed(spark, sf_dir), "user_id", "seconds", "event_id", 4, 86_400).select("event_id", "accepted")


@query()
def ttl_dedupe(spark, sf_dir):
    keyed = _timed(spark, sf_dir).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return limits.first_seen(keyed, "key", "seconds", "event_id", 43_200).select("event_id", "duplicate")


@query()
def submission_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 60.0 + F.col("turn")).alias("seconds"), (F.col("conv_id") * 1000 + F.col("turn")).alias("tie"), F.concat("role", F.lit(":"), (F.col("conv_id") % 16).cast("string")).alias("sender"))
    return limits.guard(rows, "text", "sender", "seconds", "tie", 4).select("conv_id", "turn", "rung")


def _season_values() -> str:
    return ", ".join(f"('{n}', {a * 100 + b}, {c * 100 + d})" for n, a, b, c, d in lexicon.SEASONS)


@query(f"""WITH e AS (SELECT event_id, month(ts) * 100 + day(ts) AS md FROM events), s(season, lo, hi) AS (VALUES {_season_values()})
SELECT season, count(*) AS n FROM e JOIN s ON CASE WHEN lo <= hi THEN md BETWEEN lo AND hi ELSE md >= lo OR md <= hi END GROUP BY season""")
def season_active(spark, sf_dir):
    md = F.month("ts") * 100 + F.dayofmonth("ts")
    seasons = F.array(*(F.struct(F.lit(n).alias("season"), F.lit(a * 100 + b).alias("lo"), F.lit(c * 100 + d).alias("hi")) for n, a, b, c, d in lexicon.SEASONS))
    inside = lambda s: F.when(s["lo"] <= s["hi"], F.col("md").between(s["lo"], s["hi"])).otherwise((F.col("md") >= s["lo"]) | (F.col("md") <= s["hi"]))
    days = table(spark, sf_dir, "events").groupBy(md.alias("md")).agg(F.count("*").alias("n"))
    return days.select("n", F.explode(F.filter(seasons, inside)).alias("s")).groupBy("s.season").agg(F.sum("n").alias("n"))


def _readable_sql(html: str) -> str:
    """The steps of ``mime.readable`` written for an engine without look-around: what was looked at is put back."""
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<style[\s/>].*?</style>", r"(?is)<script[\s/>].*?</script>", r"(?is)<head[\s/>].*?</head>"):
        html = f"regexp_replace({html}, '{pattern}', '', 'g')"
    anchor = r"""(?is)<a(?:[\s/][^>]*?\bhref\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)[^>]*|[\s/][^>]*|)>(.*?)</a(?:[^>]*>|[^>]*\z)"""
    html = f"replace(regexp_replace({html}, '{anchor}', '\\2' || chr(1) || '\\1' || chr(2), 'g'), chr(1) || chr(2), '')"
    html = f"translate({html}, chr(1) || chr(2), ' ')"
    html = f"regexp_replace({html}, '(?i)</(?:p|div|tr|h[1-6]|li|blockquote)>', chr(10), 'g')"
    html = f"regexp_replace(regexp_replace({html}, '(?i)<br([\\s/>])', chr(10) || '<\\1', 'g'), '<[^>]*>', '', 'g')"
    for name, character in (("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("apos", "chr(39)"), ("#39", "chr(39)"), ("amp", "'&'")):
        html = f"regexp_replace({html}, '(?i)&{name};', {character}, 'g')"
    html = f"array_to_string(list_transform(string_split({html}, chr(10)), lambda x: regexp_replace(x, '\\s+\\z', '')), chr(10))"
    return f"regexp_replace(regexp_replace({html}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g')"


@query(f"SELECT page_id, {_readable_sql('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", mime.readable(F.col("html")).alias("text"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


_PHONE = r"\+[0-9][0-9 ().-]{6,18}[0-9]"
_BY_LENGTH = sorted(lexicon.CALLING_CODES, key=lambda c: (-len(c[0]), c[0]))
_CODE_SQL = "CASE " + " ".join(f"WHEN starts_with(digits, '{code}') THEN '{country}'" for code, country, _ in _BY_LENGTH) + " END"


@query(f"""WITH p AS (SELECT unnest(regexp_extract_all(text, '{_PHONE}')) AS number FROM documents), d AS (SELECT regexp_replace(number, '[^0-9]', '', 'g') AS digits FROM p)
SELECT {_CODE_SQL} AS country, count(*) AS n FROM d GROUP BY 1""")
def phone_countries(spark, sf_dir):
    numbers = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_PHONE), F.lit(0))).alias("number"))
    return numbers.groupBy(C.calling_code(F.col("number"))["country"].alias("country")).agg(F.count("*").alias("n"))


from . import query_mail, query_messages, query_more, query_plans, query_prose, query_urls  # noqa: E402, F401

SQL |= {"rate_limit_accepts": query_more.RATE_SQL, "ttl_dedupe": query_more.TTL_SQL}
