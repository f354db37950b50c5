"""Queries over numbers, mails, stored counters, limits, the calendar, identifiers and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lexicon, lures
from .dialect import DUCK, SPARK, Spark, folded
from .operators import messages as M
from .query_messages import MESSAGES, _messages
from .registry import query, quoted, rows_sql, table

# -- phone numbers --------------------------------------------------------------------------
_HOME = lexicon.PLANS[lexicon.DEFAULT_REGION]
_CODES = sorted(lexicon.CALLING_CODES, key=lambda c: (-len(c[0]), c[0]))


def _phone_steps(d: Spark) -> list[list[str]]:
    like = lambda column, prefixes: "(" + " OR ".join(f"{column} LIKE '{p}%'" for p in prefixes) + ")"
    code = _HOME["code"]
    full = len(code) + _HOME["length"][1]
    national = f"CASE WHEN abroad THEN '' WHEN number LIKE '+{code}%' THEN substr(digits, {len(code) + 1}) WHEN digits LIKE '{code}%' AND length(digits) = {full} THEN substr(digits, {len(code) + 1}) WHEN digits LIKE '{_HOME['trunk']}%' THEN substr(digits, 2) ELSE digits END"
    right = f"length(national) BETWEEN {_HOME['length'][0]} AND {_HOME['length'][1]}"
    kind = f"""CASE WHEN digits IN ({quoted(_HOME['emergency'])}) AND number NOT LIKE '+%' THEN 'emergency' WHEN length(digits) < 6 THEN 'short' WHEN {d.has('digits', '^(?:0{6,}|1{6,}|2{6,}|3{6,}|4{6,}|5{6,}|6{6,}|7{6,}|8{6,}|9{6,})$')} THEN 'repeated'
 WHEN abroad AND country IS NULL THEN 'invalid' WHEN abroad THEN 'international' WHEN {like('national', _HOME['premium'])} THEN 'premium' WHEN {like('national', _HOME['free'])} THEN 'free' WHEN {like('national', _HOME['shared'])} THEN 'shared'
 WHEN {right} AND {like('national', _HOME['mobile'])} THEN 'mobile' WHEN {right} AND {like('national', _HOME['voip'])} THEN 'voip' WHEN {right} AND {like('national', _HOME['fixed'])} THEN 'fixed' ELSE 'invalid' END"""
    pick = lambda i: "CASE " + " ".join(f"WHEN digits LIKE '{c[0]}%' THEN '{c[i]}'" for c in _CODES) + " END"
    wangiri = like("digits", [c[0] for c in _CODES if len(c[0]) == 4 and c[0].startswith("1") and c[2] == "high"])
    level = f"CASE WHEN kind IN ('short', 'repeated', 'premium') OR (kind = 'international' AND wangiri) THEN 3 WHEN kind = 'invalid' OR (kind = 'international' AND risk = 'high') THEN 2 WHEN kind IN ('free', 'shared', 'voip') OR (kind = 'international' AND risk = 'medium') THEN 1 ELSE 0 END"
    return [
        [f"{d.replace('number', '[^0-9]', '')} AS digits", f"(number LIKE '+%' AND number NOT LIKE '+{code}%') AS abroad"],
        [f"{pick(1)} AS country", f"{pick(2)} AS risk", f"{national} AS national", f"{wangiri} AS wangiri"], [f"{kind} AS kind"], [f"{d.once(level)} AS level"],
        [f"{d.whole('least(100, CASE level WHEN 3 THEN 75 WHEN 2 THEN 55 WHEN 1 THEN 30 ELSE 15 END + ' + 'CASE WHEN kind = ' + chr(39) + 'premium' + chr(39) + ' OR (kind = ' + chr(39) + 'international' + chr(39) + ' AND wangiri) THEN 20 WHEN kind = ' + chr(39) + 'voip' + chr(39) + ' THEN 10 ELSE 0 END)')} AS score"],
    ]


def _nested(source: str, steps: list[list[str]], name: str) -> str:
    parts, last = [], source
    for i, step in enumerate(steps, 1):
        now = name if i == len(steps) else f"{name}_{i}"
        parts.append(f"{now} AS (SELECT *, {', '.join(step)} FROM {last})")
        last = now
    return ", ".join(parts)


def _number(d: Spark) -> str:
    return f"{d.at(d.array(lures.NUMBERS), f'c_custkey % {len(lures.NUMBERS)}')} AS number"


_PHONES = f"WITH n AS (SELECT c_custkey, {_number(DUCK)} FROM customer), {_nested('n', _phone_steps(DUCK), 'p')}"


def _phones(spark, sf_dir):
    out = table(spark, sf_dir, "customer").selectExpr("c_custkey", _number(SPARK))
    for step in _phone_steps(SPARK):
        out = out.selectExpr("*", *step)
    return out


@query(f"{_PHONES} SELECT c_custkey, kind, CASE WHEN kind = 'international' THEN country END AS country, level, score FROM p")
def phone_ladder(spark, sf_dir):
    """Every customer's number: its type, the risk ladder's level and the score."""
    return _phones(spark, sf_dir).select("c_custkey", "kind", F.when(F.col("kind") == "international", F.col("country")).alias("country"), "level", "score")


@query(f"{_PHONES} SELECT kind, level, count(*) AS n, min(score) AS least, max(score) AS most FROM p GROUP BY ALL")
def phone_levels(spark, sf_dir):
    return _phones(spark, sf_dir).groupBy("kind", "level").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


# -- mails ----------------------------------------------------------------------------------
def _mail(d: Spark) -> str:
    return f"concat({d.at(d.array(lures.MAILS), f's_suppkey % {len(lures.MAILS)}')}, ' Ref ', s_suppkey) AS mail"


def _mail_steps(d: Spark) -> list[list[str]]:
    header = lambda name: f"trim({d.extract('head', '(?im)^' + name + ':[ \\t]*(.*)$', 1)})"
    address = lambda h: f"lower({d.extract(h, '([^ <>]+@[^ <>]+)', 1)})"
    domain = lambda a: f"CASE WHEN {a} LIKE '%@%' THEN {d.extract(a, '@([^@]*)$', 1)} ELSE '' END"
    two = r"(?:" + "|".join(r.replace(".", r"\.") for r in lexicon.SUFFIX_RULES if r.count(".") == 1 and r[0] not in "*!") + ")"
    org = lambda x: f"CASE WHEN {d.has(x, r'\.' + two + '$')} THEN {d.extract(x, r'([^.]+\.[^.]+\.[^.]+)$', 1)} ELSE {d.extract(x, r'([^.]+\.[^.]+)$', 1)} END"
    result = lambda mech: d.extract("auth", mech + "=([a-z]+)", 1)
    brands = "|".join(lexicon.BASE["brands"] + ("ato",))
    points = {
        "reply_to": ("reply_to <> '' AND reply_domain <> own", 40), "brand_name": ("claims", 40), "shown_address": ("shown <> '' AND shown <> sender", 35),
        "return_path": ("path_domain <> '' AND path_org <> org AND dmarc <> 'pass'", 20), "spf": ("spf IN ('fail', 'softfail')", 35), "dmarc": ("dmarc = 'fail'", 40), "dmarc_none": ("dmarc = 'none' AND claims", 25),
        "dkim_domain": ("dkim = 'pass' AND dkim_domain <> '' AND dkim_org <> org", 15), "locale": ("claims AND locale <> '' AND locale NOT LIKE 'en%'", 15),
        "tld": (d.has("own", r"\.(?:" + "|".join(lexicon.ABUSED_TLDS) + ")$"), 30), "official": (d.has("lower(display)", r"\b(?:ato|medicare|mygov)\b") + " AND own NOT LIKE '%.gov.au'", 40),
        "greeting": (d.has("low", r"\bdear (?:customer|user|client|taxpayer|member)\b"), 15), "attachment": (d.has("low", r"\bopen the attached\b"), 25), "svg": (d.has("low", r"\battached[^.]*\.svg\b"), 20),
        "device_code": (d.has("low", "devicelogin") + " AND " + d.has("low", r"\benter the code\b"), 30),
    }
    invoice = f"CASE WHEN callback_brands >= 1 AND dispute AND invoiced >= 200 AND NOT {d.has('low', 'https?://')} THEN 45 WHEN callback_brands >= 2 AND dispute THEN 25 ELSE 0 END"
    listed = ", ".join(f"CASE WHEN i_{n} > 0 THEN '{n}' END" for n in [*points, "invoice"])
    return [
        [f"{d.replace(d.extract('mail', '(?s)^(.*?)' + chr(92) + 'n' + chr(92) + 'n', 1), chr(92) + 'n[ ' + chr(92) + 't]+', ' ')} AS head", f"{d.extract('mail', '(?s)' + chr(92) + 'n' + chr(92) + 'n(.*)$', 1)} AS body"],
        [f"{header('From')} AS sender_line", f"{address(header('Reply-To'))} AS reply_to", f"{address(header('Return-Path'))} AS return_path", f"lower({header('Authentication-Results')}) AS auth", f"lower({header('Content-Language')}) AS locale", "lower(body) AS low"],
        [f"{address('sender_line')} AS sender0", f"trim({d.replace('sender_line', chr(34) + '|<[^>]*>', '')}) AS display", f"{result('spf')} AS spf", f"{result('dkim')} AS dkim", f"{result('dmarc')} AS dmarc", f"{d.extract('auth', 'header[.]d=([a-z0-9.-]+)', 1)} AS dkim_domain", f"{domain('reply_to')} AS reply_domain", f"{domain('return_path')} AS path_domain"],
        [f"CASE WHEN sender_line LIKE '%<%' THEN lower({d.extract('sender_line', '<([^<>]+)>', 1)}) ELSE sender0 END AS sender", f"lower({d.extract('display', '([^ ]+@[^ ]+)', 1)}) AS shown", f"{d.distinct('low', chr(92) + 'b(?:' + '|'.join(lexicon.BASE['callback_brands']) + ')' + chr(92) + 'b')} AS callback_brands", f"{d.has('low', chr(92) + 'b(?:to cancel|to dispute|call us)' + chr(92) + 'b')} AS dispute", f"coalesce(TRY_CAST({d.extract('low', '[$]([0-9]+(?:[.][0-9]+)?)', 1)} AS DOUBLE), 0.0) AS invoiced"],
        [f"{domain('sender')} AS own"], [f"{org('own')} AS org", f"{org('path_domain')} AS path_org", f"{org('dkim_domain')} AS dkim_org", f"({d.has('lower(display)', chr(92) + 'b(?:' + brands + ')' + chr(92) + 'b')} AND NOT {d.has('own', '(?:' + brands + ')[.](?:com|net)$')} AND own NOT LIKE '%.gov.au') AS claims"],
        [f"{d.whole(f'CASE WHEN {c} THEN {p} ELSE 0 END')} AS i_{n}" for n, (c, p) in points.items()] + [f"{d.whole(invoice)} AS i_invoice"],
        [f"{d.once(' + '.join(f'i_{n}' for n in [*points, 'invoice']))} AS identity", d.once("concat_ws(',', " + listed + ")") + " AS findings"],
    ]


_MAILS = f"WITH m0 AS (SELECT s_suppkey, {_mail(DUCK)} FROM supplier), {_nested('m0', _mail_steps(DUCK), 'mails')}, {M.scored_sql(DUCK, 'mails', 'body', None, 'email')}"


def _mails(spark, sf_dir):
    out = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", _mail(SPARK))
    for step in _mail_steps(SPARK):
        out = out.selectExpr("*", *step)
    return M.scored(out, "body", None, "email")


@query(f"{_MAILS} SELECT s_suppkey, sender, display, org, spf, dkim, dmarc, dkim_domain FROM scored")
def email_headers(spark, sf_dir):
    """Headers unfolded and parsed, with the sender's organisation."""
    return _mails(spark, sf_dir).select("s_suppkey", "sender", "display", "org", "spf", "dkim", "dmarc", "dkim_domain")


@query(f"{_MAILS} SELECT s_suppkey, CAST(identity AS INT) AS identity, findings FROM scored")
def email_identity(spark, sf_dir):
    return _mails(spark, sf_dir).select("s_suppkey", F.col("identity").cast("int").alias("identity"), "findings")


_MAIL_SCORE = "CAST(least(100, floor(greatest(score - full_points, 0) * CAST(0.7 AS DOUBLE)) + full_points + identity) AS INT) AS mail_score"


@query(f"{_MAILS}, z AS (SELECT s_suppkey, {_MAIL_SCORE} FROM scored) SELECT s_suppkey, mail_score, CASE WHEN mail_score < 20 THEN 'safe' WHEN mail_score < 45 THEN 'suspicious' ELSE 'likely_scam' END AS verdict FROM z")
def email_scores(spark, sf_dir):
    """The message pass at 0.7, but for rules that escape it, and the sender's findings in full."""
    return _mails(spark, sf_dir).selectExpr("s_suppkey", _MAIL_SCORE).selectExpr("*", "CASE WHEN mail_score < 20 THEN 'safe' WHEN mail_score < 45 THEN 'suspicious' ELSE 'likely_scam' END AS verdict")


@query(f"{_MAILS} SELECT s_suppkey, concat_ws(' · ', CASE WHEN spf IN ('pass', 'fail', 'softfail', 'neutral') THEN 'SPF ' || spf END, CASE WHEN dkim IN ('pass', 'fail', 'none') THEN 'DKIM ' || dkim || CASE WHEN dkim_domain <> '' THEN ' (' || dkim_domain || ')' ELSE '' END END, CASE WHEN dmarc IN ('pass', 'fail', 'none') THEN 'DMARC ' || dmarc END) AS summary FROM scored")
def auth_summary(spark, sf_dir):
    known = lambda c, *values: F.col(c).isin(*values)
    by = F.when(F.col("dkim_domain") != "", F.concat(F.lit(" ("), "dkim_domain", F.lit(")"))).otherwise("")
    parts = [F.when(known("spf", "pass", "fail", "softfail", "neutral"), F.concat(F.lit("SPF "), "spf")), F.when(known("dkim", "pass", "fail", "none"), F.concat(F.lit("DKIM "), "dkim", by)), F.when(known("dmarc", "pass", "fail", "none"), F.concat(F.lit("DMARC "), "dmarc"))]
    return _mails(spark, sf_dir).select("s_suppkey", F.concat_ws(" · ", *parts).alias("summary"))


# -- identifiers ----------------------------------------------------------------------------
_IDENT = {"url": (r"https?://[^\s]+", r"[.,;:!?)\x27\x22]+$"), "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "$^"), "phone": (M.NUMBER, "$^")}
_KIND = lambda d: f"CASE WHEN {d.has('text', '(?i)^https?://[^ ]+$')} THEN 'url' WHEN {d.has('text', '^[+]?[0-9][0-9 ().-]{5,20}$')} THEN 'phone' WHEN {d.has('text', '(?im)^(?:from|subject|received):')} THEN 'email' ELSE 'sms' END AS kind"
_FOUND = lambda d: [f"{d.replace(d.extract('text', x), trail, '')} AS first_{n}" for n, (x, trail) in _IDENT.items()]


@query(f"WITH {MESSAGES} SELECT conv_id, turn, {_KIND(DUCK)}, {', '.join(_FOUND(DUCK))} FROM msgs")
def identifiers(spark, sf_dir):
    """What kind of text it is, and its first link, address and number."""
    return _messages(spark, sf_dir).selectExpr("conv_id", "turn", _KIND(SPARK), *_FOUND(SPARK))


@query(f"WITH {MESSAGES} SELECT doc_id, sha256({folded(DUCK, 'text')}) AS folded_sha256, {folded(DUCK, 'text')} <> lower(text) AS changed FROM documents")
def folded_text(spark, sf_dir):
    """Text without accents, combining marks and invisible characters."""
    t = f"{folded(SPARK, 'text')}"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"sha2({t}, 256) AS folded_sha256", f"{t} <> lower(text) AS changed")


# -- stored rows ----------------------------------------------------------------------------
@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS recent, count(*) FILTER (WHERE o_orderpriority ILIKE '%urgent%') AS matching FROM orders WHERE o_orderstatus = 'O'")
def feed_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("recent"), F.count_if(F.col("o_orderpriority").ilike("%urgent%")).alias("matching"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END AS surface, CASE WHEN value > 50 THEN 'delivered' WHEN value IS NULL THEN 'unknown' ELSE 'analysed' END AS outcome, count(*) AS value FROM events GROUP BY ALL""")
def check_events(spark, sf_dir):
    """Counters as upserts would leave them; unknown surfaces share a bucket."""
    surface = F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("event_type")).otherwise("other")
    outcome = F.when(F.col("value") > 50, "delivered").when(F.col("value").isNull(), "unknown").otherwise("analysed")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), surface.alias("surface"), outcome.alias("outcome")).agg(F.count("*").alias("value"))


@query("WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL) SELECT day, event_type, value FROM d ORDER BY day DESC, event_type LIMIT 100")
def check_events_page(spark, sf_dir):
    d = table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-10'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("value"))
    return d.orderBy(F.col("day").desc(), "event_type").limit(100)


@query("SELECT sum(CASE WHEN s_acctbal > 0 THEN s_nationkey END)::BIGINT AS total, min(s_suppkey) AS first FROM supplier")
def reported_users(spark, sf_dir):
    return table(spark, sf_dir, "supplier").agg(F.sum(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey"))).alias("total"), F.min("s_suppkey").alias("first"))


# -- radar and calendar ---------------------------------------------------------------------
_RADAR = rows_sql(lexicon.RADAR, "place, lure, region, status, channel", "radar")


def _radar(spark):
    return spark.createDataFrame(lexicon.RADAR, "place int, lure string, region string, status string, channel string")


@query(f"WITH {_RADAR}, {rows_sql([(c,) for c in lexicon.RADAR_CHANNELS], 'channel', 'c')} SELECT c.channel, count(place) AS n, count(place) FILTER (WHERE status = 'active') AS active FROM c LEFT JOIN radar ON c.channel = radar.channel GROUP BY c.channel")
def radar_channels(spark, sf_dir):
    """Lures by channel, channels without any included."""
    c = spark.createDataFrame([(x,) for x in lexicon.RADAR_CHANNELS], "channel string")
    return c.join(_radar(spark), "channel", "left").groupBy("channel").agg(F.count("place").alias("n"), F.count_if(F.col("status") == "active").alias("active"))


@query(f"WITH {_RADAR}, {rows_sql([(r,) for r in lexicon.PACKS], 'region', 'p')} SELECT count(*) AS lures, count(DISTINCT region) AS regions, count(*) FILTER (WHERE status = 'active') AS active, (SELECT count(*) FROM p WHERE region NOT IN (SELECT region FROM radar)) AS uncovered FROM radar")
def radar_summary(spark, sf_dir):
    r = _radar(spark)
    missing = spark.createDataFrame([(x,) for x in lexicon.PACKS], "region string").join(r, "region", "left_anti").agg(F.count("*").alias("uncovered"))
    return r.agg(F.count("*").alias("lures"), F.count_distinct("region").alias("regions"), F.count_if(F.col("status") == "active").alias("active")).join(F.broadcast(missing))  # one row each


@query(f"WITH {_RADAR} SELECT place, lure FROM radar WHERE status <> 'dormant' ORDER BY place LIMIT 4")
def radar_circulating(spark, sf_dir):
    return _radar(spark).filter("status <> 'dormant'").orderBy("place").limit(4).select("place", "lure")


_YEAR = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_DAYS = [(n, sum(_YEAR[: a - 1]) + b, sum(_YEAR[: c - 1]) + d) for n, a, b, c, d in lexicon.SEASONS]


@query(f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(least(dayofyear(ts), 365) AS INT) AS today FROM events), {rows_sql(_DAYS, 'season, lo, hi', 's')},
x AS (SELECT day, season, CASE WHEN lo <= hi THEN today BETWEEN lo AND hi ELSE today >= lo OR today <= hi END AS active, (lo - today + 365) % 365 AS starts_in, (hi - today + 365) % 365 AS ends_in FROM d, s)
SELECT CAST(day AS VARCHAR) AS day, season, active, CAST(starts_in AS INT) AS starts_in, CAST(ends_in AS INT) AS ends_in, coalesce(CASE WHEN NOT active THEN row_number() OVER (PARTITION BY day, active ORDER BY starts_in, season) END <= 3, FALSE) AS upcoming FROM x""")
def season_distances(spark, sf_dir):
    """Days to each season's start and end on a circle of 365 days; the three nearest that are not active."""
    from pyspark.sql.window import Window

    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().withColumn("today", F.least(F.dayofyear("day"), F.lit(365)))
    seasons = F.explode(F.array(*(F.struct(F.lit(n).alias("season"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in _DAYS))).alias("s")
    x = days.select("day", "today", seasons).select("day", "today", "s.*")
    active = F.when(F.col("lo") <= F.col("hi"), F.col("today").between(F.col("lo"), F.col("hi"))).otherwise((F.col("today") >= F.col("lo")) | (F.col("today") <= F.col("hi")))
    x = x.select("day", "season", active.alias("active"), F.pmod(F.col("lo") - F.col("today"), F.lit(365)).alias("starts_in"), F.pmod(F.col("hi") - F.col("today"), F.lit(365)).alias("ends_in"))
    place = F.row_number().over(Window.partitionBy("day", "active").orderBy("starts_in", "season"))
    return x.select(F.col("day").cast("string").alias("day"), "season", "active", "starts_in", "ends_in", F.coalesce(F.when(~F.col("active"), place) <= 3, F.lit(False)).alias("upcoming"))


# -- tracking -------------------------------------------------------------------------------
_PIXELS = tuple(f'<img src="{u}" {size}>' for u, size in (
    ("https://open.list-manage.com/track/open.php?u=0123456789abcdef0123456789abcdef01", 'width="1" height="1"'), ("https://cdn.example.com/logo.png", 'width="120" height="40"'), ("https://x.sendgrid.net/wf/open?upn=aaaabbbbccccddddeeeeffff0000111122", 'width="1" height="1"'),
    ("https://img.example.org/pixel.gif?e=ann%40example.com", 'width="0" height="0"'), ("https://news.example.com/photo.jpg", ""), ("https://t.klaviyo.com/open/0123456789abcdef0123456789abcdef01", 'height="1" width="1"'), ("https://shop.example.net/track/o/1", ""),
))


def _pixel_steps(d: Spark) -> tuple[str, list[list[str]]]:
    page = f"concat(html, {d.at(d.array(_PIXELS), f'page_id % {len(_PIXELS)}')}, {d.at(d.array(_PIXELS), f'(page_id + 3) % {len(_PIXELS)}')}) AS page"
    tiny = d.has("tag", r"width=\x22[01]\x22") + " AND " + d.has("tag", r"height=\x22[01]\x22")
    sender = "CASE " + " ".join(f"WHEN src LIKE '%{part}%' THEN '{name}'" for part, name in lexicon.SENDERS) + " ELSE '' END"
    return page, [[f"{d.extract('tag', 'src=' + chr(92) + 'x22([^' + chr(92) + 'x22]*)', 1)} AS src", f"({tiny}) AS tiny"], [f"{sender} AS platform", f"{d.has('src', '/(?:track|open|pixel)[/.?]|/wf/open')} AS path_hit", f"{d.has('src', '%40')} AS names_reader", f"{d.extract('src', '[A-Za-z0-9]{32,}')} AS token"]]


_PIX = f"WITH p0 AS (SELECT page_id, {_pixel_steps(DUCK)[0]} FROM pages), p1 AS (SELECT page_id, unnest(regexp_extract_all(page, '<img[^>]*>')) AS tag FROM p0), {_nested('p1', _pixel_steps(DUCK)[1], 'px')}"


def _pixels(spark, sf_dir):
    page, steps = _pixel_steps(SPARK)
    out = table(spark, sf_dir, "pages").selectExpr("page_id", page).select("page_id", F.explode(F.regexp_extract_all("page", F.lit("<img[^>]*>"), F.lit(0))).alias("tag"))
    for step in steps:
        out = out.selectExpr("*", *step)
    return out


@query(f"{_PIX} SELECT page_id, src, platform, tiny, names_reader FROM px WHERE tiny OR path_hit OR platform <> ''")
def tracking_pixels(spark, sf_dir):
    """Images that report being opened: tiny, under a tracking path, or of a sending platform."""
    return _pixels(spark, sf_dir).filter("tiny OR path_hit OR platform <> ''").select("page_id", "src", "platform", "tiny", "names_reader")


@query(f"{_PIX} SELECT token, count(DISTINCT page_id) AS pages FROM px WHERE token <> '' GROUP BY token HAVING count(*) >= 2")
def recurring_tokens(spark, sf_dir):
    """Long tokens that recur across links and so name a reader."""
    return _pixels(spark, sf_dir).filter("token <> ''").groupBy("token").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("n")).filter("n >= 2").drop("n")


# -- limits as recursion --------------------------------------------------------------------
_TIMED = "t AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS s FROM events)"
RATE_SQL = f"""WITH RECURSIVE {_TIMED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM t),
z(user_id, k, event_id, taken, accepted) AS (SELECT user_id, k, event_id, [s], TRUE FROM r WHERE k = 1 UNION ALL
 SELECT r.user_id, r.k, r.event_id, CASE WHEN len(list_filter(taken, lambda x: x > s - 86400)) < 4 THEN list_append(list_filter(taken, lambda x: x > s - 86400), s) ELSE list_filter(taken, lambda x: x > s - 86400) END, len(list_filter(taken, lambda x: x > s - 86400)) < 4
 FROM z JOIN r ON r.user_id = z.user_id AND r.k = z.k + 1)
SELECT event_id, accepted FROM z"""
TTL_SQL = f"""WITH RECURSIVE {_TIMED}, r AS (SELECT *, user_id || ':' || event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS k FROM t),
z(key, k, event_id, anchor, duplicate) AS (SELECT key, k, event_id, s, FALSE FROM r WHERE k = 1 UNION ALL
 SELECT r.key, r.k, r.event_id, CASE WHEN s - anchor < 43200 THEN anchor ELSE s END, s - anchor < 43200 FROM z JOIN r ON r.key = z.key AND r.k = z.k + 1)
SELECT event_id, duplicate FROM z"""
