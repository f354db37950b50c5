"""Mails built around the texts of ``documents`` and what is read back from them.

The tables hold no mails, so each document's whole text is sent in one: encoded, nested, attached,
forwarded or cut, by its number.  The SQL never looks at a mail: it says from the document what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import mime
from .operators import mail
from .registry import query, spread, table

#: What the mail of document n is, by n modulo their number.
SHAPES = ("plain", "escaped", "coded html", "alternative", "nested", "inline", "attached", "resent", "body", "cut")
_FROM = "From: Sender <sender@mail.example>\nTo: reader@home.example\n"


def _escaped(text: Column) -> Column:
    """Quoted-printable: every byte that is no letter or digit as =XX, soft breaks between escapes."""
    code = F.regexp_replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), "%", "=")
    return F.regexp_replace(code, "((?:=..|[^=]){24})", "$1=\n")


def _coded(text: Column) -> Column:
    lines = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")
    return F.regexp_replace(lines, "(.{76})", "$1\r\n")


def _part(kind: str, encoding: str, body: Column, more: str = "") -> Column:
    return F.concat(F.lit(f"Content-Type: {kind}\r\n{more}Content-Transfer-Encoding:\r\n  {encoding}\r\n\r\n"), body)


def _container(kind: str, mark: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"Content-Type: {kind};\r\n\tboundary=\"{mark}\"\r\n\r\npreamble\r\n"), *(F.concat(F.lit(f"--{mark}\r\n"), p, F.lit("\r\n")) for p in parts), F.lit(f"--{mark}--\r\nepilogue"))


def mails(docs: DataFrame) -> DataFrame:
    """doc_id, mail, cut and forwarded; null texts are empty ones."""
    t = F.coalesce(F.col("text"), F.lit(""))
    nested = _part("text/plain; charset=utf-8", "base64", _coded(t))
    levels = {0: nested}
    for i in range(1, 12):
        levels[i] = _container("Multipart/Mixed", f"=_b{i:02d}", levels[i - 1])
    deep = F.coalesce(*(F.when(F.col("doc_id") % 12 == i, m) for i, m in levels.items()))
    forward = F.concat(F.lit("FYI\n\n---------- Forwarded message ---------\n> From: Scam <scam@bad.example>\n> Subject: prize\n>\n"), t)
    inner = F.concat(F.lit("From: Inner <inner@bad.example>\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n"), _coded(F.concat(F.lit("<p>"), t)))
    pdf = _part("application/pdf; name=\"bill.pdf\"", "base64", F.lit("JVBERi0xLjQK" * 8), "Content-Disposition: attachment;\r\n filename*=utf-8''in%20voice.pdf\r\n")
    cut = _container("multipart/mixed", "cut", _part("text/plain", "quoted-printable", _escaped(t)), _part("text/html", "base64", _coded(t)), pdf)
    shapes = {
        "plain": F.concat(F.lit(_FROM + "Subject: plain\n\n"), t),
        "escaped": F.concat(F.lit(_FROM), _part("text/plain; charset=utf-8", "Quoted-Printable", _escaped(t))),
        "coded html": F.concat(F.lit(_FROM), _part("text/html", "BASE64", _coded(t))),
        "alternative": F.concat(F.lit(_FROM), _container("multipart/alternative", "alt(1)+", _part("text/plain", "quoted-printable", _escaped(t)), _part("text/html", "base64", _coded(t)))),
        "nested": F.concat(F.lit(_FROM), deep),
        "inline": F.concat(F.lit(_FROM), _part("text/plain", "base64", _coded(forward))),
        "attached": F.concat(F.lit(_FROM), _container("multipart/mixed", "att", _part("text/plain", "7bit", F.lit("see attached")), F.concat(F.lit("Content-Type: message/rfc822\r\n\r\n"), inner))),
        "resent": F.concat(F.lit("Resent-From: helper@home.example\n" + _FROM + "Subject: sent on\n\n"), t),
        "body": F.concat(F.lit(_FROM), _part("text/plain", "base64", _coded(t))),
        # The last part and the closing delimiter are missing.
        "cut": F.concat(F.lit(_FROM), F.substring(cut, F.lit(1), F.length(cut) - 60)),
    }
    shape = F.pmod("doc_id", F.lit(len(SHAPES)))
    built = F.coalesce(*(F.when(shape == i, shapes[name]) for i, name in enumerate(SHAPES)))
    return docs.select("doc_id", built.alias("mail"), (shape == SHAPES.index("cut")).alias("cut"), shape.isin(SHAPES.index("resent"), SHAPES.index("body")).alias("forwarded"))


def _mails(spark, sf_dir) -> DataFrame:
    return mails(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


_SHAPED = "d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 10 AS shape, doc_id % 12 AS levels FROM documents)"
#: White space at the ends of a text goes, and lines lose their quote signs.
_TRIM = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"
_UNQUOTED = r"array_to_string(list_transform(regexp_split_to_array({}, '\r?\n'), lambda s: regexp_replace(s, '\A\s*>+\s?', '')), chr(10))"


@query(f"""WITH {_SHAPED}
SELECT doc_id, path, CAST(depth AS INT) AS depth, type, filename, complete FROM (SELECT doc_id, '' AS path, 0 AS depth, CASE shape WHEN 0 THEN '' WHEN 7 THEN '' WHEN 2 THEN 'text/html' ELSE 'text/plain' END AS type, '' AS filename, TRUE AS complete
 FROM d WHERE shape IN (0, 1, 2, 5, 7, 8) OR shape = 4 AND levels = 0
UNION ALL SELECT doc_id, unnest(['1', '2']), 1, unnest(['text/plain', 'text/html']), '', TRUE FROM d WHERE shape = 3
UNION ALL SELECT doc_id, array_to_string(list_transform(range(levels), lambda i: '1'), '.'), levels, CASE WHEN levels <= 10 THEN 'text/plain' END, CASE WHEN levels <= 10 THEN '' END, CASE WHEN levels <= 10 THEN TRUE END
 FROM d WHERE shape = 4 AND levels > 0
UNION ALL SELECT doc_id, unnest(['1', '2.1']), unnest([1, 2]), unnest(['text/plain', 'text/html']), '', TRUE FROM d WHERE shape = 6
UNION ALL SELECT doc_id, unnest(['1', '2', '3']), 1, unnest(['text/plain', 'text/html', 'application/pdf']), unnest(['', '', 'in voice.pdf']), unnest([TRUE, TRUE, FALSE]) FROM d WHERE shape = 9)""")
def mail_parts(spark, sf_dir):
    """Every part of every mail with its place, type, name and whether it arrived whole."""
    return mail.parts(_mails(spark, sf_dir), ["doc_id"], cut=F.col("cut"))


@query(f"""WITH {_SHAPED}, x AS (SELECT doc_id, shape = 4 AND levels > 10 AS deep,
 CASE WHEN shape IN (0, 1, 5, 7, 8) OR shape = 4 AND levels <= 10 THEN CASE shape WHEN 5 THEN 'FYI' || chr(10) || chr(10) || '---------- Forwarded message ---------' || chr(10) || '> From: Scam <scam@bad.example>' || chr(10) || '> Subject: prize' || chr(10) || '>' || chr(10) ELSE '' END || t
 WHEN shape IN (3, 9) THEN t || chr(13) || chr(10) WHEN shape = 6 THEN 'see attached' || chr(13) || chr(10) ELSE '' END AS plain,
 CASE WHEN shape IN (2, 3, 9) THEN t ELSE '' END AS html FROM d)
SELECT doc_id, sha256(plain) AS plain_sha256, sha256(html) AS html_sha256, CAST(deep AS BIGINT) AS too_deep FROM x""")
def mail_texts(spark, sf_dir):
    """The decoded texts of every mail, as digests."""
    found = mail.texts(_mails(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.sha2("plain", 256).alias("plain_sha256"), F.sha2("html", 256).alias("html_sha256"), "too_deep")


_INNER = "'From: Inner <inner@bad.example>' || chr(10) || 'Content-Type: text/html' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || trim(regexp_replace(base64(encode('<p>' || t)), '(.{76})', '\\1' || chr(13) || chr(10), 'g'), chr(13) || chr(10))"


@query(f"""WITH {_SHAPED}
SELECT doc_id, CASE shape WHEN 5 THEN 'inline' WHEN 6 THEN 'attachment' WHEN 8 THEN 'body' ELSE 'toplevel' END AS source,
 CASE shape WHEN 5 THEN sha256('From: Scam <scam@bad.example>' || chr(10) || 'Subject: prize' || CASE WHEN {_TRIM.format(_UNQUOTED.format("t"))} <> '' THEN chr(10) || chr(10) ELSE '' END || {_TRIM.format(_UNQUOTED.format("t"))}
  || chr(10) || chr(10) || 'FYI' || chr(10) || chr(10) || '---------- Forwarded message ---------' || chr(10) || '>')
 WHEN 6 THEN sha256({_INNER}) WHEN 8 THEN sha256({_TRIM.format("t")}) WHEN 0 THEN sha256('From: Sender <sender@mail.example>' || chr(10) || 'To: reader@home.example' || chr(10) || 'Subject: plain' || chr(10) || chr(10) || t)
 WHEN 7 THEN sha256('Resent-From: helper@home.example' || chr(10) || 'From: Sender <sender@mail.example>' || chr(10) || 'To: reader@home.example' || chr(10) || 'Subject: sent on' || chr(10) || chr(10) || t) END AS original_sha256,
 sha256(CASE WHEN shape IN (2, 3, 9) THEN t WHEN shape = 6 THEN '<p>' || t ELSE '' END) AS markup_sha256 FROM d""")
def mail_originals(spark, sf_dir):
    """The mail that matters inside each mail, how it was found, and its markup; whole mails that are
    not forwards are the mail itself and stand as null here but for the plain and the resent ones."""
    found = mail.unwrapped(_mails(spark, sf_dir), ["doc_id"], forwarded=F.col("forwarded"))
    told = (F.col("source") != "toplevel") | F.pmod("doc_id", F.lit(10)).isin(0, 7)
    return found.select("doc_id", "source", F.when(told, F.sha2("original", 256)).alias("original_sha256"), F.sha2("markup", 256).alias("markup_sha256"))


@query(f"""WITH {_SHAPED}, x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace({_TRIM.format("t")}, '(?i)<https?://[^>\\s]+>', ' [scam link removed]', 'g'), '(?i)https?://[^\\s<>")\\]]+', '[scam link removed]', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS b FROM d),
h AS (SELECT *, 'From: Sender <sender@mail.example>' || chr(10) || 'To: reader@home.example' || CASE shape WHEN 0 THEN chr(10) || 'Subject: plain' WHEN 7 THEN chr(10) || 'Subject: sent on' ELSE '' END AS h FROM x WHERE shape IN (0, 1, 3, 4, 7, 8, 9))
SELECT doc_id, sha256(h || CASE WHEN {_TRIM.format("b")} = '' OR shape = 4 AND levels > 10 THEN '' ELSE chr(10) || chr(10) || {_TRIM.format("b")} END) AS shown_sha256 FROM h""")
def mail_distilled(spark, sf_dir):
    """What a reader is shown of the mails that are texts: a few headers and the body without its links."""
    own = _mails(spark, sf_dir).filter(F.pmod("doc_id", F.lit(10)).isin(0, 1, 3, 4, 7, 8, 9))
    return mail.distilled(own, ["doc_id"]).select("doc_id", F.sha2("shown", 256).alias("shown_sha256"))
