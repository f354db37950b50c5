"""Message, link and number rules on hand-judged texts."""

import pytest
from pyspark.sql import functions as F

from plumbline import lexicon, lures, query_more, query_urls
from plumbline.dialect import SPARK
from plumbline.operators import messages as M


def told(spark, texts, region=None, channel="sms"):
    rows = M.scored(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), "text", region, channel).orderBy("id").collect()
    return [({e.split(":")[0]: int(e.split(":")[1]) for e in r["evidence"].split(",") if e}, r["score"], r["verdict"]) for r in rows]


CASES = [
    ("urgency is capped", "urgent, act now: account locked, final notice, last warning", {"urgency": 35}),
    ("deferred alone", "Australia Post says hello", {}), ("deferred with company", "Australia Post, urgent", {"urgency": 10, "authority": 25}),
    ("official links veto", "Australia Post, urgent: https://auspost.com.au/t", {"urgency": 10, "link": 15}),
    ("a look-alike host is no veto", "Australia Post: https://auspost.com.au.evil.top/t", {"link": 15, "authority": 25}),
    ("a noun claim", "the insurance claim and the claim form", {}), ("negated ask", "We never ask for your password.", {}), ("ask", "Tell us your password", {"sensitive_ask": 15}),
    ("fee above 20", "a fee of $21 is due", {}), ("fee up to 20", "a fee of $20 is due", {"small_fee": 20}), ("one job phrase", "work from home", {}),
    ("accents", "ácт now, úrgent", {"urgency": 10}), ("invisible", "ur​gent", {"urgency": 10}), ("inflected", "lotteries and jackpots", {"reward": 12}),
    ("callback silences", "You were charged $300. If you did not order, call us on +1 (803) 555-0142 now", {"callback": 30}), ("callback vetoed by a link", "You were charged. If you did not, call +1 (803) 555-0142 or see https://a.com", {"link": 15}),
    ("a refusal excuses its own clause only", "Do not wait, send your password and card number now", {"sensitive_ask": 30}), ("a refusal with a turn", "We never ask for codes but send your password", {"sensitive_ask": 15}),
    ("a list behind a refusal", "We will never ask for your password, pin number or security code", {}), ("a refusal far away", "Never mind what the other people at the branch of the bank said, give us your password", {"sensitive_ask": 15}),
    ("local numbers", "Payment of $220.00 has been charged. If you did not authorise this, call 1300 655 505", {"callback": 30}), ("short numbers", "Please call us on 13 24 61 now", {"asks_to_call": 20}),
    ("a price is no number to call", "Please call us now about the $1300.00 you paid", {}), ("pounds", "Fee of £1.50 to release your parcel", {"small_fee": 20}), ("euros", "a fee of € 2,00 is due", {"small_fee": 20}),
    ("a neighbour's post", "Royal Mail delivered your parcel", {}), ("foreign police", "The Chinese embassy says so", {"foreign_authority": 35}),
    ("family needs all three", "Hi mum, this is my new number", {}), ("family", "Hi mum, new number, lend me 50", {"family": 45}), ("nothing", "", {}),
]


@pytest.mark.parametrize("region", ["AU"])
def test_rules_fire_and_vetoes_hold(spark, region):
    got = told(spark, [t for _, t, _ in CASES], region)
    for (name, _, want), (found, score, _) in zip(CASES, got):
        found.pop("spliced_words", None)
        assert found == want, name


def test_regions_differ_by_packs_and_switches(spark):
    text = ["HMRC officer: add us on WhatsApp, urgent", "unverified sender"]
    au, gb, zz = (told(spark, text, r) for r in ("AU", "GB", "ZZ"))
    assert "foreign_authority" not in au[0][0] and "authority_in_chat" in gb[0][0] and "authority" not in zz[0][0]
    assert au[1][0] == {"unverified_sender": 35} and gb[1][0] == {}
    assert told(spark, ["see you at noon"], "ZZ")[0][2] == "unknown" and told(spark, ["see you at noon"], "AU")[0][2] == "safe"
    assert lexicon.pack("XX") == lexicon.pack(lexicon.DEFAULT_REGION)


def test_no_pack_scores_below_none(spark):
    """A pack adds lists and switches, so no built message scores less with it than without any."""
    texts = [t for _, t in lures.MESSAGES]
    none = [score for _, score, _ in told(spark, texts, "ZZ")]
    for region in ("AU", "GB", "US", "DE"):
        weaker = [t for t, (found, score, _), least in zip(texts, told(spark, texts, region), none) if score < least and not any(host in t for host in lexicon.pack(region)["legit"])]
        assert weaker == [], region


def test_every_rule_fires_on_some_built_message(spark):
    fired = set()
    for region in ("AU", "GB"):
        for found, _, _ in told(spark, [t for _, t in lures.MESSAGES], region):
            fired |= set(found)
    assert fired == {r.rule_id for r in M.rules("AU")}


def test_composites_keep_their_weight_in_mail(spark):
    texts = ["Your WhatsApp account will be banned", "Payment of $220.00 has been charged. If you did not authorise this, call 1300 655 505", "urgent"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    full = {c: [r["full_points"] for r in M.scored(df, "text", None, c).orderBy("id").collect()] for c in ("email", "sms")}
    assert full == {"email": [30, 30, 0], "sms": [0, 0, 0]}


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("urgent", 1, 2, "x")], "text string, amount int, t int, raw string")
    row = M.scored(df).first()
    assert (row["amount"], row["t"], row["raw"], row["score"]) == (1, 2, "x", 10)


@pytest.mark.parametrize("host, suffix, registrable", [
    ("www.example.com", "com", "example.com"), ("shop.example.co.uk", "co.uk", "example.co.uk"), ("co.uk", "co.uk", ""), ("a.b.ck", "b.ck", "a.b.ck"), ("b.ck", "b.ck", ""), ("www.ck", "ck", "www.ck"), ("x.www.ck", "ck", "www.ck"),
    ("city.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp"), ("a.b.c.kawasaki.jp", "c.kawasaki.jp", "b.c.kawasaki.jp"), ("me.github.io", "github.io", "me.github.io"), ("com", "com", ""), ("10.0.0.1", "1", ""),
])
def test_public_suffix_rules(spark, host, suffix, registrable):
    row = query_urls.domains(spark.createDataFrame([(host,)], "host string")).first()
    assert (row["suffix"], row["registrable"]) == (suffix, registrable)


@pytest.mark.parametrize("number, kind, level", [
    ("000", "emergency", 0), ("12", "short", 3), ("7777777", "repeated", 3), ("0412 345 678", "mobile", 0), ("61412345678", "mobile", 0), ("+61 2 5550 1234", "fixed", 0), ("1900 123 456", "premium", 3), ("1300 123 456", "shared", 1),
    ("+1 876 555 0101", "international", 3), ("+234 803 555 0101", "international", 2), ("+44 20 7946 0000", "international", 0), ("+61 1", "short", 3), ("0999 999", "invalid", 2),
])
def test_number_ladder(spark, number, kind, level):
    df = spark.createDataFrame([(number,)], "number string")
    for step in query_more._phone_steps(SPARK):
        df = df.selectExpr("*", *step)
    row = df.first()
    assert (row["kind"], row["level"]) == (kind, level)


def test_filters_do_not_blow_up_plans(spark):
    df = spark.createDataFrame([("urgent, act now",)], "text string")
    out = M.scored(df).filter("evidence <> '' AND verdict <> 'safe'").filter(F.col("score") > 5)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 400_000 and out.count() == 1


def test_every_rewriting_changes_rows_and_holds(spark):
    from plumbline import query_messages as Q

    for query in (Q.metamorphic_relations, Q.composite_relations):
        rows = query(spark, "/root/testdata/sf0.01").collect()
        assert all(r["applied"] > 0 and r["violations"] == 0 for r in rows), rows
    assert len(Q._transforms(SPARK)) == 14 and len(Q._stacks()) == 6


def test_packs_add_and_never_take_away(spark):
    from plumbline import query_messages as Q

    rows = {r["region"]: r for r in Q.region_monotonicity(spark, "/root/testdata/sf0.01").collect()}
    assert all(r["weaker"] == 0 for r in rows.values()) and rows["AU"]["stronger"] > 0


def test_every_pack_is_set_beside_none_on_every_message(spark, tmp_path):
    """All packs and all rows, rows without a key or half of one included; their own texts are read."""
    import duckdb

    from plumbline import query_messages as Q
    from plumbline import registry

    rows = [(1, 1, "hello"), (1, 2, None), (None, 1, "Royal Mail: outstanding tax, urgent"), (2, None, "SingPost: urgent, act now"), (None, None, "An Post: act now"), (None, 7, None), (3, 1, "la poste"), (3, 1, "la poste")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").selectExpr("*", "'user' AS role").write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ("region", "n", "stronger", "weaker", "false_alarms")
    got = {r["region"]: tuple(r[c] for c in columns) for r in Q.region_monotonicity(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(registry.SQL["region_monotonicity"]).select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert sorted(got.values()) == sorted(want) and set(got) == set(lexicon.PACKS)
    assert {r[1] for r in got.values()} == {6 + 2 * 2}  # each of two rows of one key is set beside both
    assert got["GB"][2] > got["ZZ"][2] == 0 and got["SG"][2] > 0 and got["IE"][2] > 0


def test_messages_are_dealt_over_tasks(spark):
    """The table is one row group, so without dealing one task would read all texts."""
    from plumbline import query_messages as Q

    rows = Q._messages(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 536 / 2


def test_rewritten_texts_score_as_texts_of_their_own(spark):
    """Signals taken from the row's own text are those that a search would find."""
    from plumbline import query_messages as Q

    texts = [t for _, t in lures.MESSAGES] + ["", None, "urgеnt, act now" + "ж" * 40, "  a  b ", "áct now, re-re https://a.com/pay?x +1 (803) 555-0142", "> hxxp://b[.]top/"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ways = Q._transforms(SPARK) | Q._stacked(SPARK) | {"another": (False, "concat('Lottery: act now, send your password ', coalesce(text, ''))"), "none": (False, "CAST(NULL AS STRING)"), "Cyrillic": (True, "translate(text, 'a', 'а')")}
    got = {(r["id"], r["relation"]): (r["equal_to"], r["before"], r["text"], r["was"], r["score"]) for r in M.rewritten(df, ways, ("id",)).collect()}
    plain = df.select("id", F.col("text").alias("before"), F.explode(F.array(*(F.struct(F.lit(n).alias("relation"), F.lit(eq).alias("equal_to"), F.expr(x).alias("text")) for n, (eq, x) in ways.items()))).alias("r"))
    own = {r["id"]: r["score"] for r in M.scored(df).collect()}
    want = {(r["id"], r["relation"]): (r["equal_to"], r["before"], r["text"], own[r["id"]], r["score"]) for r in M.scored(plain.select("id", "before", "r.*")).collect()}
    assert got == want and len(got) == len(texts) * len(ways)


def test_regions_scored_at_once_equal_regions_scored_alone(spark):
    texts = [t for _, t in lures.MESSAGES] + ["", None, "ж" * 40 + " urgеnt", "HMRC officer: add us on WhatsApp, urgent https://a.com", "unverified sender: Royal Mail, https://auspost.com.au/t call us on 13 24 61"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    regions, columns = ("AU", "GB", "US", "DE", "ZZ"), ("id", "score", "base", "full_points", "pending", "evidence", "verdict", "coverage")
    got = {(r["region"], r["id"]): tuple(r[c] for c in columns) for r in M.scored_by_region(df, regions).collect()}
    want = {(region, r["id"]): tuple(r[c] for c in columns) for region in regions for r in M.scored(df, "text", region).collect()}
    assert got == want and len(got) == len(texts) * len(regions)


def test_signals_that_no_rule_looks_at_change_nothing(spark):
    """Rules over all signals, searched for in every text, give the same scores as rules over the needed ones."""
    texts = [a + ". " + b for _, a in lures.MESSAGES for _, b in lures.MESSAGES[::5]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    for region in ("AU", "GB"):
        found = M.signals(SPARK, region)
        every = [{k: f"({v})" for k, v in found.items() if k not in M.LATE}, {k: f"({found[k]})" for k in M.LATE}]
        whole = df.selectExpr("*", M.readable(SPARK, "raw") + " AS t").selectExpr("*", M.clean_clauses(SPARK) + " AS s")
        for layer in [M._listed(f) for f in every] + M.weighing(SPARK, M.rules(region), "TRUE"):
            whole = whole.selectExpr("*", *layer)
        assert M.scored(df, "raw", region).select("id", "score", "evidence", "verdict").exceptAll(whole.select("id", "score", "evidence", "verdict")).count() == 0


def test_regions_and_flips_read_the_texts_once(spark):
    from plumbline import query_messages as Q

    for query in (Q.region_monotonicity, Q.eval_flips):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1


def test_flips_beside_one_another_equal_joined_flips(spark):
    from plumbline.plans import evaluation as E

    rows = [(1, "a", "x", True), (1, "b", "y", False), (2, "a", "x", True), (2, "b", "x", True), (3, "a", "x", False), (3, "b", "y", False), (4, "a", "x", True), (4, "a", "z", True), (4, "b", "y", False), (4, "b", "y", False), (None, "a", "x", True), (None, "b", "y", False)]
    df = spark.createDataFrame(rows, "k int, scorer string, predicted string, right boolean")
    want = E.flips(df.filter("scorer = 'b'"), df.filter("scorer = 'a'"), ["k"]).select("k", "was", "predicted").collect()
    assert sorted(E.flips_beside(df, ["k"], F.col("scorer") == "a").collect()) == sorted(want) and len(want) == 5


def test_leads_are_beginnings_of_all_matches(spark):
    """A signal is found in no text without a word that begins as its leads say, so gates change nothing."""
    words = ["i have", "it is", "your", "tasks", "task", "re-register your identity", "fees", "the fee", "claims", "hello  mum", "hi dad", "conveyancing", "e-toll", "recovery", "Bank details", "scan this qr code", "new voicemail", "jackpots", "immigration", "não", "ésend me the code", "send\u00a0me", "_fee"]
    phrases = sorted({v for region in lexicon.PACKS for own in M.LISTED.values() for v in lexicon.pack(region)[own]})
    texts = [t for _, t in lures.MESSAGES] + words + phrases + [p + s for p in phrases for s in ("s", "ed", "ing", "é", "_", "x")] + [". ".join(phrases[i::7]) for i in range(7)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string").repartition(4)
    for region in ("AU", "GB"):
        found = M.signals(SPARK, region)
        read = M._stepped(df, [*M.reading("raw", "t"), *M.wording((region,)), [f"{M.clean_clauses(SPARK)} AS all_clauses"]])
        gated = {k: v for k, v in M.searched(found, region).items() if v != found[k]}
        assert len(gated) >= 28
        same = " AND ".join(f"({v}) = ({found[k]})" for k, v in gated.items() if k not in M.IN_CLAUSES)
        in_clauses = " AND ".join(f"({gated[k]}) = ({found[k].replace('(s,', '(all_clauses,')})" for k in M.IN_CLAUSES)
        rows = read.selectExpr("raw", f"{same} AND {in_clauses} AS same", f"t = {M.readable(SPARK, 'raw')} AS alike").collect()
        assert [r["raw"] for r in rows if not (r["same"] and r["alike"])] == [] and len(rows) == len(texts)


def test_texts_are_read_alike_in_steps_and_at_once(spark):
    texts = ["", "a  b\tc", "x\t\ty", "hxxps[:]//b[.]top/", "([.])", "https://a.com./x", "-- forwarded message --\n>hi", "\x01\x02", "\u2018x\u2019 \u201cy\u201d \u2014", "\uff11\uff12", "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0416", "ÁÉ\u0301 ur\u200bgent ß İ \u212a", "\U0001f600 > b", "Begin forwarded message: x"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    rows = M._stepped(df, M.reading("raw", "t")).selectExpr("raw", "t", f"{M.readable(SPARK, 'raw')} AS at_once").collect()
    assert [tuple(r) for r in rows if r["t"] != r["at_once"]] == []


def test_rows_that_keep_their_score_are_not_weighed(spark):
    """The violations are searched for in the rewritten texts that may have other signals, and none is lost."""
    from plumbline import query_messages as Q

    texts = [t for _, t in lures.MESSAGES] + ["", None, "urgеnt, act now", "ж" * 40, "Lottery"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ways = Q._transforms(SPARK) | {"cut": (False, "substring(text, 1, 20)"), "none": (True, "CAST(NULL AS STRING)"), "Cyrillic": (True, "translate(text, 'a', 'а')"), "mixed": (True, "concat(text, ' xж')")}
    every, some = (M.rewritten(df, ways, ("id",), differing=d) for d in (False, True))
    broken = lambda rows: sorted(tuple(r) for r in rows.filter("score <> was").select("id", "relation", "was", "score").collect())
    assert broken(some) == broken(every) and {r[1] for r in broken(every)} >= {"cut", "none", "mixed"}
    assert some.count() < every.count() / 2


def _generated(plan) -> list[int]:
    """Rows that came out of each explode of a plan that has run."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    below = plan.children()
    return own + [n for i in range(below.size()) for n in _generated(below.apply(i))]


def test_each_folded_text_of_a_row_is_searched_once(spark):
    """Ways that lead to the same folded text, and to the row's own, do not have it searched again."""
    from plumbline import query_messages as Q

    texts = [t for _, t in lures.MESSAGES]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ways = Q._stacked(SPARK)
    out = M.rewritten(df, ways, ("id",))
    assert len(out.collect()) == len(texts) * len(ways)
    each = df.select("id", F.explode(F.array(*(F.expr(x) for _, x in ways.values()))).alias("raw"))
    distinct = each.selectExpr("id", M.readable(SPARK, "raw") + " AS t").distinct().count()
    assert min(_generated(out._jdf.queryExecution().executedPlan())) == distinct < len(texts) * len(ways) / 2


def test_texts_with_more_behind_are_read_whole(spark):
    """A forward's head, a link's last dot and runs of blanks may go on in what a rewriting adds."""
    family = "Hi mum, this is my new number, I lost my phone and need to pay a bill"
    texts = ["-- forwarded message", "--", "begin forwarded", "> ", "", " ", "a", "hi", "act", "https://evri-help.xyz.", "URGENT ", "Été ΣΣ", "x (", "> -- original message --> a", "​>’ pay"]
    more = [" -- " + family, " forwarded message -- " + family, " message: " + family, " now", "  now", " .com/ act now", ".)/", " mum, this is my new number, I lost my phone and need to pay a bill", " Σ délivery failed", "́ unpaid toll", "​", "s now"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ways = {str(i): (False, f"concat(text, '{m}')") for i, m in enumerate(more)} | {"q" + str(i): (False, f"concat('>> ', text, '{m}')") for i, m in enumerate(more)}
    got = {(r["id"], r["relation"]): r["score"] for r in M.rewritten(df, ways, ("id",)).collect()}
    plain = df.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("relation"), F.expr(x).alias("text")) for n, (_, x) in ways.items()))).alias("r")).select("id", "r.*")
    whole = plain.selectExpr("id", "relation", M.readable(SPARK, "text") + " AS text")
    for rows in (plain, whole):
        assert got == {(r["id"], r["relation"]): r["score"] for r in M.scored(rows).collect() if (r["id"], r["relation"]) in got}
    assert got[(0, "0")] == 45 and len(set(got.values())) > 4


def test_phrases_by_letter_find_what_lists_find(spark):
    from plumbline.dialect import phrases

    for region in ("AU", "DE"):
        p = lexicon.pack(region)
        own = [p[name] for name in (*M.LISTED.values(), "service", "family", "money_ask", "pretext", "crypto", "no_link_senders", "exchanges")]
        every = sorted({v for values in own for v in values})
        texts = [t.lower() for _, t in lures.MESSAGES] + [v + e for v in every for e in ("", "s", "ed", "x", "é")] + [" ".join(every[i::5]) for i in range(5)] + ["-".join(every[i::3]) for i in range(3)]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        same = " AND ".join(f"{SPARK.every('t', phrases(v, inflected))} = {SPARK.every('t', SPARK.phrases(v, inflected))}" for v in own for inflected in (True,))
        assert df.filter(f"NOT ({same})").count() == 0


def test_every_letter_is_read_as_at_once(spark):
    """One map of letters gives what the steps one after another give, letter by letter and among others."""
    letters = [chr(c) for c in (*range(1, 0x590), *range(0x1E00, 0x2070), 0x212A, 0xFEFF, *range(0xFF00, 0xFF60), 0x1F600)]
    texts = letters + [f"A{c} {c}́BΣ{c}" for c in letters]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    rows = M._stepped(df, M.reading("raw", "t")).selectExpr("raw", "t", f"{M.readable(SPARK, 'raw')} AS at_once")
    assert [tuple(r) for r in rows.collect() if r["t"] != r["at_once"]] == []
