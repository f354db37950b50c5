"""Text functions as column expressions; pandas functions only where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INVISIBLE = "[­​-‏⁠﻿]"
#: Look-alike marks and what they stand for; fixed values.
FOLDED_FROM = "‐‑‒–—−․∕‘’“”"
FOLDED_TO = "------./''\"\""
WORD_EDGE_LEFT, WORD_EDGE_RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def present(text: str | Column) -> Column:
    """The empty string stands for what is absent."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def normalised(text: Column) -> Column:
    """Invisible characters gone, compatibility forms composed, dashes and quotes as ASCII."""
    return F.translate(nfkc(F.regexp_replace(present(text), INVISIBLE, "")), FOLDED_FROM, FOLDED_TO)


def has_confusables(text: Column) -> Column:
    return normalised(text) != present(text)


def refanged(text: Column) -> Column:
    """Defanged links restored: hxxp, bracketed dots, colons and at signs."""
    t = F.regexp_replace(text, r"(?i)\bhxxps(?=:|\[)", "https")
    t = F.regexp_replace(t, r"(?i)\bhxxp(?=:|\[)", "http")
    t = F.regexp_replace(t, r"\[://\]", "://")
    t = F.regexp_replace(t, r"\[\.\]|\(\.\)", ".")
    return F.regexp_replace(F.regexp_replace(t, r"\[:\]", ":"), r"\[@\]", "@")


def defanged(text: Column) -> Column:
    """Links made unclickable."""
    return F.regexp_replace(F.regexp_replace(text, "(?i)http(s?)://", "hxxp$1://"), r"(?<=\w)\.(?=\w)", "[.]")


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the lower-cased text as whole words; one search a word."""
    low = F.lower(text)
    hits = [low.rlike(WORD_EDGE_LEFT + w.replace(" ", r"\s+") + WORD_EDGE_RIGHT).cast("int") for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    alternatives = "|".join(w.replace(" ", r"\s+") for w in words)
    return F.lower(text).rlike(f"{WORD_EDGE_LEFT}(?:{alternatives}){WORD_EDGE_RIGHT}")


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def stop_word_share(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Share of stop words among words, null without words."""
    words = words_of(text)
    hits = F.size(F.filter(words, lambda w: w.isin(*stop_words)))
    return F.when(F.size(words) > 0, hits / F.size(words))


def stemmed(word: Column) -> Column:
    """A cautious stem: ies to y, ed and ing off, a doubled consonant left single but l and s."""
    bare = F.regexp_replace(F.regexp_replace(word, "([^aeiou])ies$", "$1y"), "^(.{3,})(?:ed|ing)$", "$1")
    return F.regexp_replace(bare, r"([b-df-hjkmnp-rtv-z])\1$", "$1")


def channel_of(text: Column) -> Column:
    """url, phone, email or sms, in this order."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^(?i)https?://\S+$"), "url").when(t.rlike(r"^\+?[0-9][0-9 ().-]{5,20}$"), "phone")
        .when(t.rlike(r"(?im)^(from|subject|received):"), "email").otherwise("sms")
    )


def clauses(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?;\n]+"), lambda c: F.trim(c) != "")


PLACEHOLDERS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]"),
    ("phone", r"\+[0-9][0-9 ().-]{6,18}[0-9]", "[phone]"),
    ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ip]"),
    ("card", r"[0-9]{13,19}", "[card]"),
)


def scrubbed(text: Column) -> Column:
    """Personal data replaced by placeholders, kind by kind; earlier kinds win."""
    for _, pattern, holder in PLACEHOLDERS:
        text = F.regexp_replace(text, pattern, holder)
    return text
