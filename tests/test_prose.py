"""Hosts in prose, stems and superseding rules against plain versions and hand-judged cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline import lexicon, query_prose
from plumbline.functions import hosts, stems
from plumbline.operators import supersession

ABUSED = ("top", "xyz", ".TK", "icu", "zip", "live", "work", "online")


def told(spark, texts):
    df = hosts.candidates(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text")
    rows = df.select("id", hosts.accepted(F.col("candidates"), ABUSED).alias("h")).orderBy("id").collect()
    return [[texts[r["id"]][h["start"] : h["end"]] for h in r["h"]] for r in rows]


HOSTS = [
    ("Login at commbank-secure-login.tk/auth now", ["commbank-secure-login.tk/auth"]), ("www.secure.top", ["www.secure.top"]), ("see auspost.com.au/track", ["auspost.com.au/track"]), ("notes.org file", []), ("our team is dev.io", []),
    ("the plumber came by.Work is done", []), ("AUSPOST-TRACK.TOP/verify", ["AUSPOST-TRACK.TOP/verify"]), ("tune in.live for it", []), ("evil.work/login", ["evil.work/login"]), ("i finished early.live music starts", []),
    ("claim now at freemoney.tk", ["freemoney.tk"]), ("claim now at freemoney.tk urgently", []), ("at freemoney.tk, 3 days", ["freemoney.tk"]), ("secure-billing.top now", ["secure-billing.top"]), ("a.b.top now", ["a.b.top"]),
    ("archive.zip", []), ("archive.zip/x", ["archive.zip/x"]), ("in hospital.ICU visiting hours", []), ("a@mail.top", []), ("dir/file.top", []), ("http://evil.top/a?b=other.top/c", []), ("http://evil.top and other.top", ["other.top"]),
    ("www.аuspost.top/pay", ["www.аuspost.top/pay"]), ("Δelta-billing.top", ["Δelta-billing.top"]), ("README.md node.js e.g. No.5", []), ("", []), ("x" * 100_000 + ".top", ["x" * 100_000 + ".top"]), ("tk.tk tk.tk", ["tk.tk"]),
]


def test_hosts_in_prose(spark):
    assert told(spark, [t for t, _ in HOSTS]) == [h for _, h in HOSTS]
    assert told(spark, [None]) == [[]]


def test_what_is_stripped_is_what_is_found(spark):
    texts = ["go to freemoney.tk now.", "pay at freemoney.tk", "a@b.top see https://x.y/z and secure-a.top!", "depоsit.bond ассount.co", "", "by.Work", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["prose"] for r in hosts.without_link_text(rows, "text", ABUSED).orderBy("id").collect()]
    assert got == ["go to freemoney.tk now.", "pay at  ", "  see   and  !", "depоsit.bond ассount.co", "", "by.Work", ""]


def test_every_built_text_has_both_sides(spark):
    found = told(spark, list(query_prose.HOST_TEXTS))
    assert sum(map(bool, found)) >= 6 and sum(not x for x in found) >= 4


# -- stems ----------------------------------------------------------------------------------
STEMS = [
    ("verifies", "verify"), ("applies", "apply"), ("referred", "refer"), ("shipped", "ship"), ("shipping", "ship"), ("spelled", "spelled"), ("crossed", "crossed"), ("paid", "pay"), ("frozen", "freeze"), ("Stolen", "steal"),
    ("shaping", "shaping"), ("offered", "offered"), ("ties", "ty"), ("movies", "movy"), ("agreed", "agreed"), ("added", "added"), ("egged", "egged"), ("put", "put"), ("", ""),
]


def test_stems(spark):
    rows = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(STEMS)], "i int, w string")
    got = [r[0] for r in rows.orderBy("i").select(stems.stem(F.col("w"))).collect()]
    want = [s for _, s in STEMS]
    assert got == want


def test_entries_by_stem(spark):
    texts = [("Please verifies your account now", ["verify"]), ("referred, and committing", ["commit", "refer"]), ("Your invoice was paid in full", []), ("The new shaping tool arrived", []), ("We offered a discount", []), (None, []), ("verifies " * 3, ["verify"])]
    rows = spark.createDataFrame([(i, t, False) for i, (t, _) in enumerate(texts)] + [(90, "verifies", True), (91, "verifies", None)], "id int, text string, foreign boolean")
    entries = spark.createDataFrame([(e,) for e in ("verify", "refer", "commit", "pay", "ship", "gift card", "verify")], "entry string")
    got = sorted((r["id"], r["entry"]) for r in stems.found_by_stem(rows, ["id"], "text", entries, F.col("foreign")).collect())
    assert got == sorted([(i, e) for i, (_, own) in enumerate(texts) for e in own] + [(91, "verify")])


# -- superseding rules ----------------------------------------------------------------------
def plain_survivors(fired, edges):
    live = {(a, b) for a, b in edges if a in fired and b in fired}
    reach = set(live)
    while True:
        more = {(a, d) for a, b in reach for c, d in live if b == c} - reach
        if not more:
            break
        reach |= more
    cyclic, known = {a for a, b in reach if a == b}, {}

    def survives(x):
        if x not in known:
            known[x] = x not in cyclic and not any(survives(a) for a, b in live if b == x and a not in cyclic)
        return known[x]

    return {x for x in fired if survives(x)}, reach


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_survivors_equal_the_plain_version(spark, seed):
    draw = random.Random(seed)
    names = [f"r{i}" for i in range(12)]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(14)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("gone", "r3")]
    sets = {k: draw.sample(names, draw.randrange(1, 12)) for k in range(25)} | {99: names}
    df = spark.createDataFrame([(k, r) for k, own in sets.items() for r in own], "set_id bigint, rule string")
    e = spark.createDataFrame(edges, "a string, b string")
    got = {(r["set_id"], r["rule"]) for r in supersession.survivors(df, e).filter("survives").collect()}
    assert got == {(k, r) for k, own in sets.items() for r in plain_survivors(set(own), edges)[0]}
    whole = {(r["a"], r["b"]) for r in supersession.closure(e).collect()}
    assert whole == plain_survivors({x for pair in edges for x in pair}, edges)[1]


def test_points_are_rounded_together(spark):
    rules = spark.createDataFrame([("a", 0, None, ["body"], {"default": 25.0}, [], ""), ("b", 1, ["email"], ["body"], {"email": 9.0}, ["a"], ""), ("c", 2, None, ["body"], {"email": 1.0}, None, "")], query_prose.RULE_SCHEMA)
    hits = [(1, "sms", "a", 1, 0.5), (1, "sms", "a", 2, 0.5), (1, "sms", "b", 1, None), (1, "sms", "unknown", 1, None), (1, "sms", "c", 1, None), (2, "email", "a", 1, None), (2, "email", "b", 1, None)]
    rows = spark.createDataFrame(hits, "id int, channel string, rule string, nth int, scale double")
    got = sorted((r["id"], r["rule"], r["nth"], r["points"]) for r in supersession.scored(rows, rules, ["id"]).collect())
    assert got == [(1, "a", 1, 13), (1, "a", 2, 12), (1, "c", 1, 0), (2, "b", 1, 9)]


def test_problems_of_a_table(spark):
    rules = [("a", 0, None, ["body"], {"default": 1.0}, ["b"], ""), ("b", 1, None, ["words"], {"sms": 1.0}, ["a", "nowhere"], ""), ("p", 2, ["phone"], ["url", "phone"], {"phone": 1.0}, ["m"], ""), ("m", 3, ["email"], ["headers"], {"email": 0.0}, ["m"], ""), ("a", 4, None, ["body"], {"default": 1.0}, [], "")]
    got = {(r["rule"], r["problem"], r["detail"]) for r in supersession.problems(spark.createDataFrame(rules, query_prose.RULE_SCHEMA)).collect()}
    assert got == {
        ("a", "listed twice", ""), ("b", "unreachable input", "words"), ("p", "unreachable input", "url"), ("b", "no weight", "custom,url,email,phone"), ("b", "supersedes unknown", "nowhere"), ("p", "supersedes apart", "m"),
        ("a", "cycle", ""), ("b", "cycle", ""), ("m", "cycle", ""),
    }


def test_the_engine_table_has_only_its_known_problems(spark):
    """The built table holds one circle and one pair that never meets, on purpose."""
    got = {(r["rule"], r["problem"]) for r in supersession.problems(query_prose.rule_table(spark)).collect()}
    assert got == {("prize.gift", "cycle"), ("prize.cash", "cycle"), ("prize.won", "cycle"), ("call.any", "supersedes apart")}


def test_abused_ends_are_the_lexicons():
    assert all(re.fullmatch("[a-z]+", x) for x in lexicon.ABUSED_TLDS)
