"""Web addresses taken apart as a browser does: what the host really is, or that there is none.

The steps are columns: white space goes, a missing scheme is https, slashes may be many or backslashes, the last
@ ends the user, percent escapes and letters of other scripts in the host are decoded, numbers become IPv4
addresses.  Only hosts with letters beyond ASCII meet Python, each distinct one once, for their ASCII form.

Defined cases: null and empty input are not valid; a host with a forbidden character, an empty label, a
label that is no punycode, a port above 65535 or an address out of range is not valid; parts of what is not
valid are null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mime import trimmed

#: Letters of Cyrillic, and those of Greek that look like Latin ones; fixed values.
CONFUSABLE = r"\x{0400}-\x{052F}ΑΒΕΖΗΙΚΜΝΟΡΣΤΥΧαεηικμνορςστυχ"
#: A label of a host that mixes Latin letters with ones that look like them.
MIXED = rf"[A-Za-z][^./:]*[{CONFUSABLE}]|[{CONFUSABLE}][^./:]*[A-Za-z]"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}
_FORBIDDEN = r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]"


def typed_host(url: Column) -> Column:
    """The host as written, before anything is decoded; '' where there is none."""
    return F.regexp_extract(F.trim(url), r"(?i)^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@\s]*@)?([^/?#\s:]+)", 1)


def shown_hyphens(url: Column) -> Column:
    """Hyphens that a reader sees: those of the written host, not those of its encoding."""
    return F.regexp_count(typed_host(url), F.lit("-"))


def mixes_scripts(url: Column) -> Column:
    return typed_host(url).rlike(MIXED)


def _is_label(label: str) -> bool:
    return all(c.isalnum() or c in "-_" or unicodedata.category(c)[0] == "M" for c in label)


def ascii_form(host: str) -> str | None:
    """The ASCII form of a host with letters of other scripts; null where it has none."""
    out = []
    for label in unicodedata.normalize("NFKC", host).lower().replace("\u3002", ".").split("."):
        label = "".join(c for c in label if c not in "\u00ad\u200b\u2060\ufeff")
        if not label.isascii():
            if not _is_label(label):
                return None
            label = "xn--" + label.encode("punycode").decode()
        out.append(label)
    return ".".join(out)


def shown_form(host: str) -> str | None:
    """The host with its punycode labels decoded; null where one of them is none."""
    out = []
    for label in host.split("."):
        if label.startswith("xn--"):
            try:
                label = label[4:].encode().decode("punycode")
            except (UnicodeError, ValueError, OverflowError):
                return None
            if not label or label.isascii() or not _is_label(label):
                return None
        out.append(label)
    return ".".join(out)


def _forms(hosts: DataFrame) -> DataFrame:
    """own_host, ascii_host, shown_host of each distinct host that is not plain."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            plain = [ascii_form(h) for h in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string()), pa.array([None if p is None else shown_form(p) for p in plain], pa.string())], ["own_host", "ascii_host", "shown_host"])

    return hosts.distinct().mapInArrow(find, "own_host string, ascii_host string, shown_host string")


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal behind 0, hexadecimal behind 0x; null where it is none."""
    hexa, octal = part.rlike("^0[xX][0-9A-Fa-f]*$"), part.rlike("^0[0-7]+$")
    digits = F.when(hexa, F.concat(F.lit("0"), F.substring(part, F.lit(3), F.length(part)))).otherwise(part)
    size = F.length(F.regexp_replace(digits, "^0+", ""))
    whole = F.when(hexa & (size <= 8), F.conv(digits, 16, 10)).when(octal & (size <= 11), F.conv(digits, 8, 10)).when(part.rlike("^(?:0|[1-9][0-9]*)$") & (size <= 10), digits)
    return whole.cast("bigint")


def parsed(df: DataFrame, url: str) -> DataFrame:
    """Adds valid, scheme, host (ASCII), shown (as a reader sees it), port and path."""
    keep = df.columns
    raw = F.regexp_replace(trimmed(F.coalesce(F.col(url), F.lit(""))), "[\t\r\n]", "")
    out = df.withColumn("own_raw", F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw)))
    out = out.withColumn("own_scheme", F.lower(F.regexp_extract("own_raw", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    rest = F.regexp_extract("own_raw", r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*(.*)$", 1)
    # "http" without a colon is a host that begins so.
    rest = F.when(F.col("own_scheme").isin(*DEFAULT_PORTS), rest).otherwise(F.lit(None).cast("string"))
    out = out.withColumn("own_rest", rest)
    out = out.withColumn("own_authority", F.regexp_extract("own_rest", r"^([^/\\?#]*)", 1)).withColumn("own_path", F.regexp_extract("own_rest", r"^[^/\\?#]*([^?#]*)", 1))
    out = out.withColumn("own_place", F.regexp_replace("own_authority", "^.*@", ""))
    out = out.withColumn("own_port", F.regexp_extract("own_place", r":([^:\]]*)$", 1)).withColumn("own_name", F.regexp_replace("own_place", r":[^:\]]*$", ""))
    decoded = F.try_url_decode(F.replace(F.regexp_replace("own_name", "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    out = out.withColumn("own_host", F.lower(F.coalesce(decoded, F.lit("%"))))
    plain = ~F.col("own_host").rlike(r"[^\x00-\x7F]") & ~F.col("own_host").rlike(r"(?:^|\.)xn--")
    special = out.filter(~plain).select("own_host")
    out = out.join(_forms(special).withColumnRenamed("own_host", "odd_host"), F.col("own_host") == F.col("odd_host"), "left")
    out = out.withColumn("own_ascii", F.regexp_replace(F.when(plain, F.col("own_host")).otherwise(F.col("ascii_host")), r"\.+$", "")).withColumn("own_shown", F.regexp_replace(F.when(plain, F.col("own_host")).otherwise(F.col("shown_host")), r"\.+$", ""))
    # A host that ends in a number is an IPv4 address or nothing.
    parts = F.split("own_ascii", r"\.")
    out = out.withColumn("own_numeric", F.element_at(parts, -1).rlike("^(?:[0-9]+|0[xX][0-9A-Fa-f]*)$")).withColumn("own_numbers", F.when(F.col("own_numeric"), F.transform(parts, _number)))
    n = F.size("own_numbers")
    last = F.element_at("own_numbers", -1)
    fits = (n <= 4) & ~F.exists("own_numbers", lambda x: x.isNull()) & ~F.exists(F.slice("own_numbers", F.lit(1), n - 1), lambda x: x > 255) & (last < F.pow(F.lit(256), 5 - n))
    total = F.aggregate(F.slice("own_numbers", F.lit(1), n - 1), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(3).alias("i")), lambda a, x: F.struct((a["sum"] + x * F.pow(F.lit(256), a["i"]).cast("bigint")).alias("sum"), (a["i"] - 1).alias("i")))["sum"] + last
    out = out.withColumn("own_total", F.when(F.col("own_numeric") & fits, total))
    address = F.concat_ws(".", *(F.pmod(F.floor(F.col("own_total") / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))
    bracketed = F.col("own_ascii").rlike(r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]$")
    named = (F.col("own_ascii") != "") & ~F.col("own_ascii").rlike(_FORBIDDEN) & ~F.col("own_ascii").rlike(r"\.\.|^\.") & F.col("own_shown").isNotNull()
    port = (F.col("own_port") == "") | (F.col("own_port").rlike("^[0-9]{1,9}$") & (F.coalesce(F.expr("try_cast(own_port as bigint)"), F.lit(99_999)) <= 65_535))
    valid = F.coalesce(F.col("own_rest").isNotNull() & port & (bracketed | (named & (~F.col("own_numeric") | F.col("own_total").isNotNull()))), F.lit(False))
    out = out.withColumn("own_valid", valid)
    told = lambda c: F.when(F.col("own_valid"), c)
    usual = F.coalesce(*(F.when((F.col("own_scheme") == s) & (F.expr("try_cast(own_port as int)") == int(p)), True) for s, p in DEFAULT_PORTS.items()), F.lit(False))
    number = F.when((F.col("own_port") != "") & ~usual, F.expr("try_cast(own_port as int)"))
    path = F.regexp_replace(F.translate("own_path", "\\", "/"), "/+", "/")
    final = F.when(F.col("own_numeric"), address).otherwise(F.col("own_ascii"))
    shown = F.when(F.col("own_numeric"), address).otherwise(F.col("own_shown"))
    return out.select(*keep, F.col("own_valid").alias("valid"), told(F.col("own_scheme")).alias("scheme"), told(final).alias("host"), told(shown).alias("shown"), told(number).alias("port"), told(F.when(path == "", "/").otherwise(path)).alias("path"))

