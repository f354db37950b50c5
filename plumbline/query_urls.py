"""Queries over links: every page's link, every second one replaced by a built link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon, lures
from .dialect import DUCK, SPARK, Spark
from .functions import url as U
from .functions import web_address
from .registry import query, quoted, rows_sql, table

N = len(lures.URLS)
_AT = f"CAST(floor(page_id / 2) AS BIGINT) % {N}"
#: Hosts of a fetched blocklist, as ``readers.blocklist`` would give them.
BLOCKED = ("paypal-secure.xyz", "evil.example", "facebook.com.evil.top", "id.example.org", "casino-win.com", "cheap-pills.net")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def _links(d: Spark) -> str:
    return f"CASE WHEN page_id % 2 = 0 THEN {d.at(d.array(lures.URLS), _AT)} ELSE url END AS url"


def _parsed(d: Spark) -> list[str]:
    typed = d.extract("url", _HOST, 1)
    return [f"{typed} AS typed", f"rtrim(lower({typed}), '.') AS host" if type(d) is not Spark else f"rtrim('.', lower({typed})) AS host"]


_RULES = [(r.lstrip("!*."), "exception" if r.startswith("!") else "wildcard" if r.startswith("*") else "exact") for r in lexicon.SUFFIX_RULES]
LINKS = f"links AS (SELECT *, {', '.join(_parsed(DUCK))} FROM (SELECT page_id, {_links(DUCK)} FROM pages))"
DOMAINS = f"""{rows_sql(_RULES, 'rule, kind', 'rules')}, hs AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM links WHERE host <> ''),
cand AS (SELECT host, p, len(p) - i + 1 AS n, array_to_string(p[i:], '.') AS own, array_to_string(p[i + 1:], '.') AS above FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM hs)),
hit AS (SELECT host, max(CASE WHEN kind = 'exception' THEN 1000 + n - 1 ELSE n END) AS k FROM cand JOIN rules ON (kind <> 'wildcard' AND own = rule) OR (kind = 'wildcard' AND above = rule) GROUP BY host),
doms AS (SELECT hs.host, CAST(coalesce(CASE WHEN k >= 1000 THEN k - 1000 ELSE k END, 1) AS INT) AS k, p FROM hs LEFT JOIN hit USING (host)),
domains AS (SELECT host, array_to_string(p[-k:], '.') AS suffix, CASE WHEN len(p) > k AND NOT regexp_matches(host, '^[0-9.]+$') THEN array_to_string(p[-(k + 1):], '.') ELSE '' END AS registrable FROM doms)"""


def links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", _links(SPARK)).selectExpr("*", *_parsed(SPARK))


def domains(hosts: DataFrame) -> DataFrame:
    """host, suffix, registrable: exception rules first, then the longest exact or wildcard rule, then the last label.

    A host's own suffixes are joined with the rules, so a full public list is a table like any other.
    """
    rules = hosts.sparkSession.createDataFrame(_RULES, "rule string, kind string")
    hs = hosts.select("host").distinct().filter("host <> ''").withColumn("p", F.split("host", r"\."))
    tail = lambda i: F.array_join(F.slice("p", i, F.greatest(F.size("p") - i + 1, F.lit(0))), ".")
    cand = hs.select("host", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).select("host", (F.size("p") - F.col("i") + 1).alias("n"), tail(F.col("i")).alias("own"), F.when(F.col("i") < F.size("p"), tail(F.col("i") + 1)).otherwise("").alias("above"))
    exact = cand.join(rules.filter("kind <> 'wildcard'"), F.col("own") == F.col("rule")).select("host", F.when(F.col("kind") == "exception", 999 + F.col("n")).otherwise(F.col("n")).alias("k"))
    wild = cand.join(rules.filter("kind = 'wildcard'"), F.col("above") == F.col("rule")).select("host", F.col("n").alias("k"))
    hit = exact.unionByName(wild).groupBy("host").agg(F.max("k").alias("k"))
    k = F.coalesce(F.when(F.col("k") >= 1000, F.col("k") - 1000).otherwise(F.col("k")), F.lit(1))
    out = hs.join(hit, "host", "left").withColumn("k", k)
    last = lambda n: F.array_join(F.slice("p", F.greatest(F.size("p") - n + 1, F.lit(1)), n), ".")
    registrable = F.when((F.size("p") > F.col("k")) & ~F.col("host").rlike("^[0-9.]+$"), last(F.col("k") + 1)).otherwise("")
    return out.select("host", last(F.col("k")).alias("suffix"), registrable.alias("registrable"))


def _points(d: Spark) -> list[tuple[str, str]]:
    """The link rules: id and points, over url, typed, host, label, blocked."""
    under = lambda hosts: "(" + " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in hosts) + ")"
    when = lambda c, p: f"CASE WHEN {c} THEN {p} ELSE 0 END"
    brands = " + ".join(f"CASE WHEN host LIKE '%{b}%' AND label <> '{b}' THEN 45 ELSE 0 END" for b in lexicon.BRANDS)
    words = " + ".join(f"CASE WHEN {d.has('label', '(?:^|-)' + b + '(?:-|$)')} AND label <> '{b}' THEN 45 ELSE 0 END" for b in lexicon.WORD_BRANDS)
    typos = sorted({t for b in lexicon.BRANDS if len(b) >= 6 for t in U.typos(b)})
    puny, mixed = "(host LIKE 'xn--%' OR host LIKE '%.xn--%')", d.has("typed", web_address.MIXED)
    return [
        ("blocklist", when("blocked", 70)), ("shortener", when(under(lexicon.SHORTENERS), 40)), ("tld", when(d.has("host", r"\.(?:" + "|".join(lexicon.ABUSED_TLDS) + ")$"), 30)), ("ip_host", when(d.has("host", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 35)),
        ("ipfs", when(under(lexicon.IPFS_GATEWAYS) + " OR " + d.has("url", "/ipfs/[A-Za-z0-9]{20,}"), 40)), ("hosting", "CASE " + " ".join(f"WHEN host LIKE '%.{h}' THEN {p}" for h, p in lexicon.HOSTING.items()) + " ELSE 0 END"),
        ("redirect", when(d.has("lower(url)", "[?&](?:url|redirect|next|target)=https?"), 15)), ("brand", brands), ("brand_word", words), ("typo", when(f"label IN ({quoted(typos)})", 35)),
        ("mixed_script", when(mixed, 45)), ("punycode", when(f"{puny} AND NOT ({mixed})", 10)), ("hyphens", when("length(typed) - length(replace(typed, '-', '')) >= 3", 20)), ("plain_http", when("lower(url) LIKE 'http:%'", 15)), ("long", when("length(url) > 200", 15)),
        ("labels", when("length(host) - length(replace(host, '.', '')) >= 5", 20)), ("login_word", when(d.has("lower(url)", "login|signin|verify|secure"), 10)),
        ("oauth", when(d.has("lower(url)", r"/oauth2?/|/authorize\?") + f" AND NOT {under(lexicon.IDENTITY_HOSTS)}", 15)),
    ]


_LEGIT = tuple(dict.fromkeys(h for p in lexicon.PACKS.values() for h in p["legit"]))


def _verdict(d: Spark) -> list[str]:
    legit = "(" + " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in _LEGIT) + ")"
    total = d.once(d.whole(f"CASE WHEN host = '' THEN 60 WHEN {legit} THEN 5 ELSE least({' + '.join('u_' + n for n, _ in _points(d))}, 100) END"))
    return [f"{total} AS score", d.once(f"CASE WHEN host = '' OR {legit} THEN 0 ELSE {' + '.join(f'CASE WHEN u_{n} > 0 THEN 1 ELSE 0 END' for n, _ in _points(d))} END") + " AS n_signals", f"(host = '') AS unparseable"]


_BANDS = "CASE WHEN unparseable THEN 'suspicious' WHEN score < 20 THEN 'safe' WHEN score < 45 THEN 'suspicious' ELSE 'likely_scam' END AS verdict"
URL_SCORES = f"""WITH {LINKS}, {DOMAINS}, {rows_sql([(b,) for b in BLOCKED], 'b', 'bl')}, j AS (SELECT l.*, coalesce(string_split(registrable, '.')[1], '') AS label, l.host IN (SELECT b FROM bl) AS blocked FROM links l LEFT JOIN domains USING (host)),
u AS (SELECT *, {', '.join(f'{p} AS u_{n}' for n, p in _points(DUCK))} FROM j), s AS (SELECT *, {', '.join(_verdict(DUCK))} FROM u), scored AS (SELECT *, {_BANDS} FROM s)"""


def scored_links(df: DataFrame, blocked_hashes: DataFrame) -> DataFrame:
    """Links (url, typed, host) with the points of each rule, score and verdict; the list is joined by hash."""
    known = domains(df)
    hashes = blocked_hashes.select(F.col("host_hash").alias("listed")).distinct()
    out = df.join(known, "host", "left").withColumn("hash", U.host_hash(F.col("host"))).join(hashes, F.col("hash") == F.col("listed"), "left")
    out = out.withColumn("blocked", F.col("listed").isNotNull()).withColumn("label", F.coalesce(F.substring_index("registrable", ".", 1), F.lit("")))
    out = out.selectExpr("*", *(f"CAST({p} AS INT) AS u_{n}" for n, p in _points(SPARK)))
    return out.selectExpr("*", *_verdict(SPARK)).selectExpr("*", _BANDS)


def _scored(spark, sf_dir) -> DataFrame:
    hashes = spark.createDataFrame([(b,) for b in BLOCKED], "host string").select(U.host_hash(F.col("host")).alias("host_hash"))
    return scored_links(links(spark, sf_dir), hashes)


@query(f"{URL_SCORES} SELECT page_id, CAST(n_signals AS INT) AS n_signals, score, verdict FROM scored")
def url_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", F.col("n_signals").cast("int").alias("n_signals"), "score", "verdict")


@query(f"{URL_SCORES} SELECT verdict, count(*) AS n, max(score) AS most FROM scored GROUP BY verdict")
def url_verdict_counts(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.max("score").alias("most"))


@query(f"{URL_SCORES}, p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, u_{n} AS points FROM u" for n, _ in _points(DUCK)) + ") SELECT rule_id, count(*) FILTER (WHERE points > 0) AS hits, sum(points)::BIGINT AS points FROM p GROUP BY rule_id")
def url_rule_hits(spark, sf_dir):
    """How often each link rule fired."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule_id"), F.col(f"u_{n}").alias("points")) for n, _ in _points(SPARK)))).alias("r")
    return _scored(spark, sf_dir).select(each).groupBy("r.rule_id").agg(F.count_if(F.col("r.points") > 0).alias("hits"), F.sum("r.points").alias("points"))


@query(f"WITH {LINKS}, {DOMAINS} SELECT page_id, host, coalesce(suffix, '') AS suffix, coalesce(registrable, '') AS registrable FROM links LEFT JOIN domains USING (host)")
def host_registrable(spark, sf_dir):
    rows = links(spark, sf_dir)
    return rows.join(domains(rows), "host", "left").select("page_id", "host", F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("registrable", F.lit("")).alias("registrable"))


@query(f"WITH {LINKS}, {DOMAINS} SELECT suffix, suffix IN ({quoted(lexicon.COMMERCIAL)}) AS commercial, count(*) AS n, count(DISTINCT registrable) AS owners FROM links JOIN domains USING (host) GROUP BY ALL")
def suffix_counts(spark, sf_dir):
    """Links under each public suffix, national commercial ones marked."""
    rows = links(spark, sf_dir)
    return rows.join(domains(rows), "host").groupBy("suffix", F.col("suffix").isin(*lexicon.COMMERCIAL).alias("commercial")).agg(F.count("*").alias("n"), F.count_distinct("registrable").alias("owners"))


@query(f"WITH {LINKS}, {rows_sql([(b,) for b in BLOCKED], 'b', 'bl')} SELECT page_id, sha256(host)[1:16] AS host_hash FROM links WHERE sha256(host)[1:16] IN (SELECT sha256(b)[1:16] FROM bl)")
def blocklist_hits(spark, sf_dir):
    """Links on a fetched list, found by truncated hashes as a client would."""
    listed = spark.createDataFrame([(b,) for b in BLOCKED], "host string").select(U.host_hash(F.col("host")).alias("host_hash"))
    return links(spark, sf_dir).select("page_id", U.host_hash(F.col("host")).alias("host_hash")).join(listed, "host_hash", "left_semi").select("page_id", "host_hash")


@query(f"WITH {LINKS} SELECT page_id, brand FROM links JOIN (SELECT unnest([{quoted(lexicon.BRANDS)}]) AS brand) b ON contains(host, b.brand)")
def brand_in_host(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", F.explode(F.filter(F.array(*map(F.lit, lexicon.BRANDS)), lambda b: F.contains(F.col("host"), b))).alias("brand"))


@query(f"""WITH {LINKS}, q AS (SELECT page_id, regexp_extract(url, '(#.*)$', 1) AS f, regexp_replace(url, '#.*$', '') AS b FROM links),
x AS (SELECT page_id, f, regexp_extract(b, '^([^?]*)', 1) AS pre, list_filter(string_split(regexp_extract(b, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({quoted(lexicon.TRACKING_PARAMETERS)})) AS k FROM q)
SELECT page_id, pre || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || f AS clean_url FROM x""")
def url_strip_tracking(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.without_tracking(F.col("url")).alias("clean_url"))


@query(f"""WITH {LINKS}, {rows_sql(lexicon.REDIRECTS, 'src, dst', 'r')} SELECT page_id, host, coalesce(c.dst, b.dst, a.dst, host) AS destination, (a.dst IS NOT NULL)::INT + (b.dst IS NOT NULL)::INT + (c.dst IS NOT NULL)::INT AS hops
FROM links LEFT JOIN r a ON a.src = host LEFT JOIN r b ON b.src = a.dst LEFT JOIN r c ON c.src = b.dst""")
def url_expansion(spark, sf_dir):
    """Where links lead by a table of redirects, three hops at most."""
    r = spark.createDataFrame(lexicon.REDIRECTS, "src string, dst string")
    out = links(spark, sf_dir)
    for i, before in ((1, "host"), (2, "d1"), (3, "d2")):
        hop = r.select(F.col("src").alias(f"s{i}"), F.col("dst").alias(f"d{i}"))
        out = out.join(hop, F.col(before) == F.col(f"s{i}"), "left")
    return out.select("page_id", "host", F.coalesce("d3", "d2", "d1", "host").alias("destination"), sum(F.col(f"d{i}").isNotNull().cast("int") for i in (1, 2, 3)).alias("hops"))


#: Addresses written in ways that hide their host, and some that have none.
ODD_ADDRESSES = (
    "https://p\u0430ypal.com/login", "https://%70aypal-help.top//a//b", "http:\\\\evil.top\\x", "https:/one.example", "https://user@good.example@evil.top/x", "HTTPS://EXAMPLE.com.:443/", "http://0x7f.1/", "http://2130706433", "http://256.1.1.1/", "https://xn--pypal-4ve.com",
    "https://xn--\u00e4/", "https://m\u00fcnchen-bank-login.de/a", "https://a..b/", "https://exa mple.com/", "https://x.com:99999/", "x.com:8443/p", "", "https://[::1]/a", "ftp.example.com", "https://a_b.example/{x}|y", "http", "https://1.2.3/", "https://0300.0250.1.1/",
)


@query()
def web_addresses(spark, sf_dir):
    """Every link of the pages, and one odd address beside each page, taken apart; tested against a plain parser."""
    pages = table(spark, sf_dir, "pages")
    odd = F.get(F.array(*map(F.lit, ODD_ADDRESSES)), F.pmod("page_id", F.lit(len(ODD_ADDRESSES))).cast("int"))
    found = F.concat(F.array("url", odd), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    each = pages.select("page_id", F.posexplode(found).alias("nth", "link"))
    return web_address.parsed(each, "link").withColumn("hyphens", web_address.shown_hyphens(F.col("link"))).withColumn("mixed", web_address.mixes_scripts(F.col("link")))
