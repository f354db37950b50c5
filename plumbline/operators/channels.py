"""The rule sets of e-mail senders and phone numbers; links are in ``query_urls``, messages in ``messages``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import url as U
from .scoring import Rule


# -- e-mail ---------------------------------------------------------------------------------
def header(raw: Column, name: str) -> Column:
    """The first header of a name, unfolded; empty when absent.  Headers end at the first blank line."""
    head = F.regexp_extract(F.replace(raw, F.lit("\r\n"), F.lit("\n")), r"(?s)^(.*?)(?:\n\n|$)", 1)
    flat = F.regexp_replace(head, r"\n[ \t]+", " ")
    return F.trim(F.regexp_extract(flat, rf"(?im)^{name}:[ \t]*(.*)$", 1))


def address(value: Column) -> Column:
    inner = F.regexp_extract(value, r"<([^<>\s]+@[^<>\s]+)>", 1)
    return F.lower(F.when(inner != "", inner).otherwise(F.regexp_extract(value, r"([^\s<>\"]+@[^\s<>\"]+)", 1)))


def domain(addr: Column) -> Column:
    return F.when(F.contains(addr, F.lit("@")), F.substring_index(addr, "@", -1)).otherwise("")


def email_headers(raw: Column) -> Column:
    auth = F.lower(header(raw, "Authentication-Results"))
    result = lambda mech: F.regexp_extract(auth, rf"{mech}=([a-z]+)", 1)
    sender = header(raw, "From")
    return F.struct(
        address(sender).alias("from_address"), F.trim(F.regexp_replace(sender, r"<[^>]*>|\"", "")).alias("display_name"),
        address(header(raw, "Reply-To")).alias("reply_to"), address(header(raw, "Return-Path")).alias("return_path"),
        header(raw, "Subject").alias("subject"), result("spf").alias("spf"), result("dkim").alias("dkim"), result("dmarc").alias("dmarc"),
        F.regexp_extract(auth, r"header\.d=([a-z0-9.-]+)", 1).alias("dkim_domain"),
    )


def identity_rules(h: Column) -> list[Rule]:
    own = domain(h["from_address"])
    brand = F.exists(F.array(*map(F.lit, lexicon.BRANDS)), lambda b: F.contains(F.lower(h["display_name"]), b) & ~F.contains(own, b))
    shown = F.regexp_extract(F.lower(h["display_name"]), r"([^\s]+@[^\s]+)", 1)
    other = lambda c: (c != "") & (U.registrable(domain(c)) != U.registrable(own))
    return [
        Rule("mail.reply_to", (h["reply_to"] != "") & (domain(h["reply_to"]) != own), 40, "sender"),
        Rule("mail.brand_name", brand, 40, "sender"),
        Rule("mail.shown_address", (shown != "") & (shown != h["from_address"]), 35, "sender"),
        Rule("mail.return_path", other(h["return_path"]) & (h["dmarc"] != "pass"), 20, "sender"),
        Rule("mail.spf", h["spf"].isin("fail", "softfail"), 35, "sender"),
        Rule("mail.dmarc", h["dmarc"] == "fail", 40, "sender"),
        Rule("mail.dmarc_none", (h["dmarc"] == "none") & brand, 25, "sender"),
        Rule("mail.dkim_domain", (h["dkim"] == "pass") & (h["dkim_domain"] != "") & (U.registrable(h["dkim_domain"]) != U.registrable(own)), 15, "sender"),
    ]


# -- phone ----------------------------------------------------------------------------------
LEVELS = ("low", "medium", "high", "very_high")
LEVEL_POINTS = {"low": 15, "medium": 30, "high": 55, "very_high": 75}


def phone_digits(number: Column) -> Column:
    return F.regexp_replace(number, "[^0-9]", "")


def calling_code(number: Column) -> Column:
    """code, country and risk of an international number by its longest known prefix; null if none."""
    digits = phone_digits(number)
    known = sorted(lexicon.CALLING_CODES, key=lambda c: (-len(c[0]), c[0]))
    found = None
    for code, country, risk in known:
        value = F.struct(F.lit(code).alias("code"), F.lit(country).alias("country"), F.lit(risk).alias("risk"))
        found = F.when(digits.startswith(code), value) if found is None else found.when(digits.startswith(code), value)
    return found


def phone_risk(number: Column) -> Column:
    """The highest level that any check gives: too short, one digit repeated, the calling code's."""
    digits = phone_digits(number)
    level = lambda name: F.lit(LEVELS.index(name))
    code = calling_code(number)["risk"]
    by_code = F.when(code == "high", level("high")).when(code == "medium", level("medium")).otherwise(level("low"))
    worst = F.greatest(
        F.when(F.length(digits) < 6, level("very_high")).otherwise(level("low")),
        F.when(digits.rlike(r"^([0-9])\1{5,}$"), level("very_high")).otherwise(level("low")),
        F.when(F.startswith(number, F.lit("+")), by_code).otherwise(level("low")),
    )
    return F.get(F.array(*map(F.lit, LEVELS)), worst)


def phone_points(level: Column) -> Column:
    points = F.lit(0)
    for name, value in LEVEL_POINTS.items():
        points = F.when(level == name, value).otherwise(points)
    return points
