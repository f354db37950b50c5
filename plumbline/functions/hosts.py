"""Host names that stand in prose without a scheme, told apart from words that meet at a full stop.

Places of candidates need offsets, which no column function gives, so one Arrow function finds
them, text by text in one pass; whether a candidate is a host is decided by columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ends of host names that honest brands use; fixed values.
MAINSTREAM = ("com", "net", "org", "co", "io", "app", "info", "biz", "me", "tv", "cc", "au", "uk", "nz", "ie", "ca", "us")
#: Abused ends that are words or file names as well; fixed values.
AMBIGUOUS = ("zip", "mov", "bond", "xin", "icu")
#: Words that stand left of a full stop in prose; fixed values.
PROSE = (
    "a", "an", "the", "and", "or", "but", "so", "as", "at", "by", "in", "on", "of", "to", "up", "for", "from", "with", "is", "are", "was", "were", "be",
    "been", "it", "its", "we", "he", "she", "they", "you", "i", "my", "our", "your", "their", "this", "that", "these", "those", "if", "then", "than",
    "when", "while", "not", "no", "do", "does", "did", "go", "get", "got",
)
#: Letters of labels: those of the scripts that lend look-alikes count, or a host would be cut short.
LABEL = r"A-Za-z0-9\u0370-\u03FF\u0400-\u052F"
SPACE = r" \t\n\x0b\f\r\xa0"
HOST = re.compile(rf"(?<![A-Za-z0-9_@./\\-])((?:[{LABEL}](?:[{LABEL}-]*[{LABEL}])?\.)+[A-Za-z]{{2,24}})(/[^{SPACE}<>\"']*)?")
_SCHEME = re.compile(r"https?://", re.IGNORECASE)
_GOES_ON = re.compile(rf"[{SPACE}]+[A-Za-z]")
_BLANK = re.compile(f"[{SPACE}]")

CANDIDATE = "array<struct<start:int,end:int,host:string,path:string,in_link:boolean,goes_on:boolean>>"


def candidates(texts: DataFrame, text: str, name: str = "candidates") -> DataFrame:
    """Adds what looks like a host: its place, host and path, whether it stands inside a link, and
    whether prose goes on behind it."""

    def look(value: str | None) -> list[dict]:
        out, token, linked = [], 0, False
        for m in HOST.finditer(value or ""):
            # A link reaches from its scheme to the next blank; only what was not yet looked at is searched.
            for blank in _BLANK.finditer(value, token, m.start()):
                token, linked = blank.end(), False
            linked = linked or _SCHEME.search(value, token, m.start()) is not None
            out.append({"start": m.start(), "end": m.end(), "host": m[1], "path": m[2], "in_link": linked, "goes_on": _GOES_ON.match(value, m.end()) is not None})
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("in_link", pa.bool_()), ("goes_on", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(pa.field(name, kind), pa.array([look(t) for t in batch.column(text).to_pylist()], kind))

    return texts.mapInArrow(find, T.StructType([*texts.schema.fields]).add(name, T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("in_link", T.BooleanType()), T.StructField("goes_on", T.BooleanType())]))))


def is_host(c: Column, abused: tuple[str, ...]) -> Column:
    """Whether a candidate is a host rather than prose.

    A label that is capitalised begins a sentence.  A plain word or a prose word with nothing but its
    ending is a sentence's last word when prose goes on.  A mainstream or ambiguous ending alone is a
    mention; a path or www. tells that a host was meant.
    """
    labels = F.split(F.lower(c["host"]), r"\.")
    left, last = labels[0], F.element_at(labels, -1)
    backed = c["path"].isNotNull() | F.lower(c["host"]).startswith("www.")
    sentence = F.regexp_extract(c["host"], r"([^.]*)$", 1).rlike("^[A-Z][a-z]")
    prose = (F.size(labels) == 2) & ~backed & (left.isin(*PROSE) | (left.rlike("^[a-z]+$") & c["goes_on"]))
    flagged = last.isin(*(x.lstrip(".").lower() for x in abused))
    known = flagged | last.isin(*MAINSTREAM)
    alone = ~backed & (~flagged | last.isin(*AMBIGUOUS))
    return known & ~sentence & ~prose & ~alone & ~c["in_link"]


def accepted(found: Column, abused: tuple[str, ...]) -> Column:
    return F.filter(found, lambda c: is_host(c, abused))


def without_link_text(texts: DataFrame, text: str, abused: tuple[str, ...], name: str = "prose") -> DataFrame:
    """Adds the text with links, addresses and accepted hosts as blanks: what rules about prose read."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?i)[a-z][a-z0-9+.-]{0,30}://\S+", " "), r"(?<!\S)\S+@\S+", " ")
    found = candidates(texts.withColumn("own_clean", clean), "own_clean", "own_hosts").withColumn("own_hosts", accepted(F.col("own_hosts"), abused))
    starts = F.concat(F.array(F.lit(0)), F.transform("own_hosts", lambda c: c["end"]))
    ends = F.concat(F.transform("own_hosts", lambda c: c["start"]), F.array(F.length("own_clean")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("own_clean"), a + 1, b - a))
    return found.select(*texts.columns, F.array_join(pieces, " ").alias(name))
