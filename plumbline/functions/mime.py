"""Pieces of mail as column expressions: headers, boundaries, transfer encodings, readable text of HTML.

Texts are read whole and nothing here calls Python: quoted-printable becomes percent escapes, base64 is
checked before it is decoded, and bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_LINE = r"\r?\n\r?\n"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def head_and_body(raw: Column) -> Column:
    """A mail cut at its first blank line: one or two texts."""
    # Splitting with a limit of two would search the whole body for further blank lines.
    def cut(blank: Column) -> Column:
        head = F.call_function("substring_index", raw, blank, F.lit(1))
        return F.when(blank != "", F.array(head, F.substring(raw, F.length(head) + F.length(blank) + 1, F.length(raw)))).otherwise(F.array(raw))

    return bound(F.regexp_extract(raw, f"(?:{BLANK_LINE})", 0), cut)


def unfolded(head: Column) -> Column:
    """Headers with continuation lines joined to the line that they continue."""
    return F.regexp_replace(head, r"\r?\n[ \t]+", " ")


def header(head: Column, name: str) -> Column:
    """The first value of a header, '' where there is none."""
    return trimmed(F.regexp_extract(unfolded(head), rf"(?im)^{name}\s*:\s*(.*)$", 1))


def boundary(content_type: Column) -> Column:
    """The boundary parameter, quoted or not, in its own case; '' where there is none."""
    quoted = F.regexp_extract(content_type, r'(?i)boundary\s*=\s*"([^"]+)"', 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(content_type, r"(?i)boundary\s*=\s*([^\s;]+)", 1))


def segments(body: Column, mark: Column) -> Column:
    """A body cut at each delimiter; the first segment is what stands before any."""
    literal = F.concat(F.lit(r"\Q--"), F.replace(mark, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.split(body, literal)


def _as_text(binary: Column) -> Column:
    """Bytes as text: a leading byte order mark goes, what is no UTF-8 becomes U+FFFD."""
    return F.regexp_replace(F.make_valid_utf8(binary.cast("string")), "^﻿", "")


def from_quoted_printable(body: Column) -> Column:
    """Soft line breaks gone and =XX as bytes; an = that starts no escape stays."""
    joined = F.regexp_replace(body, r"=\r?\n", "")
    # %XX is decoded run by run as UTF-8, so own percent and plus signs are escaped first.
    escaped = F.replace(F.replace(joined, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(F.regexp_replace(escaped, "=([0-9A-Fa-f]{2})", "%$1")), "^﻿", "")


def from_base64(body: Column) -> Column:
    """Decoded text; a body that was cut within a group of four counts up to the last whole group,
    and a body that is no base64 stays as it is."""
    def valid(core: Column) -> Column:
        whole = F.concat(core, F.repeat(F.lit("="), F.pmod(-F.length(core), F.lit(4))))
        return F.when(core.rlike(r"\A[A-Za-z0-9+/]*\z") & (F.length(core) % 4 != 1), _as_text(F.unbase64(whole)))

    def decoded(code: Column) -> Column:
        return bound(F.when(F.length(code) % 4 == 0, F.regexp_replace(code, "={1,2}$", "")).otherwise(code), valid)

    clean = F.regexp_replace(body, r"\s+", "")
    return F.coalesce(bound(clean, lambda c: F.coalesce(decoded(c), decoded(F.substring(c, F.lit(1), F.length(c) - F.length(c) % 4)))), body)


def decoded(body: Column, encoding: Column) -> Column:
    """A part's text by its transfer encoding; unknown encodings leave it as it is."""
    by = lambda kind: F.when(kind == "quoted-printable", from_quoted_printable(body)).when(kind == "base64", from_base64(body)).otherwise(body)
    return bound(F.lower(trimmed(encoding)), by)


def filename(head: Column) -> Column:
    """The declared name of a part: of its disposition, else of its type; percent escapes decoded where they are valid."""
    by_disposition = F.regexp_extract(header(head, "content-disposition"), r'(?i)filename\*?\s*=\s*"?([^";\r\n]+)', 1)
    by_type = F.regexp_extract(header(head, "content-type"), r'(?i)\bname\s*=\s*"?([^";\r\n]+)', 1)
    raw = F.regexp_replace(trimmed(F.when(by_disposition != "", by_disposition).otherwise(by_type)), r"^[\w-]*'[\w-]*'", "")
    plain = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(plain.isNull() | plain.contains("�"), raw).otherwise(plain)


#: Entities that are restored, & last so that none is restored twice; fixed values.
ENTITIES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("amp", "&"))
_REMOVED = "[scam link removed]"


def readable(html: Column, links: str = "keep") -> Column:
    """What a reader sees of HTML.  Links leave their address behind their text with ``keep`` and a
    placeholder with ``redact``.  For reading and analysis only: the result is not safe as markup."""
    text = html
    for opener, closer in (("<!--", "-->"), (r"<style(?=[\s/>])", "</style>"), (r"<script(?=[\s/>])", "</script>"), (r"<head(?=[\s/>])", "</head>")):
        text = F.regexp_replace(text, f"(?is){opener}.*?{closer}", "")
    anchor = r"""(?is)<a(?=[\s/>])(?:[^>]*?\bhref\s*=\s*["']?([^"'\s>]+))?[^>]*>(.*?)</a(?:[^>]*>|[^>]*\z)"""
    if links == "redact":
        text = F.regexp_replace(text, anchor, f"$2 {_REMOVED}")
    else:
        # The address is set off by marks first, since an anchor without one adds no blank.
        text = F.regexp_replace(text, anchor, "$2\x01$1\x02")
        text = F.translate(F.replace(text, F.lit("\x01\x02"), F.lit("")), "\x01\x02", " ")
    text = F.regexp_replace(text, "(?i)</(?:p|div|tr|h[1-6]|li|blockquote)>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br(?=[\s/>])", "\n<"), "<[^>]*>", "")
    for name, character in ENTITIES:
        text = F.regexp_replace(text, f"(?i)&{name};", character)
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+(?=\n|\z)", ""), "\n{3,}", "\n\n"))


def without_links(text: Column) -> Column:
    """Text in which web addresses are replaced by a placeholder."""
    out = F.regexp_replace(text, r"(?i)<https?://[^>\s]+>", f" {_REMOVED}")
    out = F.regexp_replace(out, r"(?i)https?://[^\s<>\")\]]+", _REMOVED)
    return F.regexp_replace(out, "[ \t]{2,}", " ")
