"""Rules, functions, limits and sources on small literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.functions import mime
from plumbline.functions import text as T
from plumbline.functions import url as U
from plumbline.operators import channels as C
from plumbline.operators import logs
from plumbline.operators import scoring as S
from plumbline.plans import evaluation as E
from plumbline.plans import store
from plumbline.sources import readers
from plumbline.streaming import limits

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, clean", [
    ("https://a.com/x?utm_source=1&b=2#f", "https://a.com/x?b=2#f"), ("https://a.com/?UTM_Source=1", "https://a.com/"), ("https://a.com/x", "https://a.com/x"), ("a.com?ref=1&q=", "a.com?q="), ("", ""),
])
def test_tracking_parameters_go(spark, url, clean):
    assert one(spark, U.without_tracking(F.col("u")), u=url) == clean


@pytest.mark.parametrize("url, host, registrable", [
    ("https://User@A.B.Example.COM.:80/x", "a.b.example.com", "example.com"), ("http://shop.example.co.uk/", "shop.example.co.uk", "example.co.uk"), ("http://co.uk/", "co.uk", ""), ("nothing", "", ""),
])
def test_hosts(spark, url, host, registrable):
    assert one(spark, U.host(F.col("u")), u=url) == host
    assert one(spark, U.registrable(U.host(F.col("u"))), u=url) == registrable


def test_typos_are_one_slip_away():
    slips = U.typos("paypal")
    assert {"psypal", "apypal", "ppaypal"} <= set(slips) and "paypal" not in slips


def test_text_functions(spark):
    assert one(spark, T.refanged(F.col("t")), t="hxxps://a[.]b") == "https://a.b"
    assert one(spark, T.normalised(F.col("t")), t="p​ａy‑x") == "pay-x"
    assert one(spark, T.has_confusables(F.col("t")), t="plain") is False
    assert one(spark, T.mentions(F.col("t"), ("caf", "the")), t="café the") == 2  # boundaries are ASCII
    assert one(spark, T.channel_of(F.col("t")), t="From: x\n\nhi") == "email"
    assert one(spark, mime.readable(F.col("t")), t="<p>a &amp;lt; b</p><script>x</script><!-- y -->c") == "a &lt; b\nc"


def rule(i, fires, points, **more):
    return S.Rule(i, F.lit(fires), points, **more)


@pytest.mark.parametrize("rules, want", [
    ([("a", True, 60), ("b", True, 70)], 100), ([("a", False, 60)], 0), ([("a", True, 10)], 10),
])
def test_scores_add_up_and_clamp(spark, rules, want):
    assert one(spark, S.score(S.evidence([rule(*r) for r in rules])), z=1) == want


def test_deferred_rules_need_company(spark):
    alone = [rule("d", True, 0, deferred=25), rule("e", True, 0, deferred=20)]
    assert one(spark, S.score(S.evidence(alone)), z=1) == 0
    assert one(spark, S.score(S.evidence([*alone, rule("a", True, 5)])), z=1) == 50


def test_silenced_rules(spark):
    rules = [rule("weak", True, 20, silenced_by="strong"), rule("strong", True, 30)]
    assert one(spark, S.score(S.evidence(rules)), z=1) == 30
    with pytest.raises(ValueError):
        S.checked([rule("a", True, 1), rule("a", True, 1)])
    with pytest.raises(ValueError):
        S.checked([rule("a", True, 1, silenced_by="nobody")])


def test_discount_of_90_rounds_as_doubles_do(spark):
    assert one(spark, S.discounted(F.lit(90), F.lit(0), 0.7), z=1) == int(90 * 0.7)


def test_covered_verdict(spark):
    assert one(spark, S.covered_verdict(F.lit(0), F.lit(False)), z=1) == "unknown"
    assert one(spark, S.covered_verdict(F.lit(45), F.lit(False)), z=1) == "likely_scam"


def test_email_headers_unfold_and_score(spark):
    raw = "From: \"PayPal\" <a@evil.com>\nReply-To: b@other.com\nAuthentication-Results: mx;\n dkim=pass header.d=evil.com; spf=softfail;\n dmarc=none\n\nReply-To: body@x.com"
    h = one(spark, C.email_headers(F.col("r")), r=raw)
    assert (h["from_address"], h["reply_to"], h["spf"], h["dmarc"], h["display_name"]) == ("a@evil.com", "b@other.com", "softfail", "none", "PayPal")
    found = one(spark, S.evidence(C.identity_rules(C.email_headers(F.col("r")))), r=raw)
    assert {s["rule_id"] for s in found} == {"mail.reply_to", "mail.brand_name", "mail.spf", "mail.dmarc_none"}


@pytest.mark.parametrize("number, country, risk", [("+216 555 0100", "TN", "high"), ("+1 269 555 0100", "US", "low"), ("+20 100 555 0100", "EG", "medium"), ("11111111", "US", "very_high"), ("+12", "US", "very_high")])
def test_phones(spark, number, country, risk):
    assert one(spark, C.calling_code(F.col("n")), n=number)["country"] == country
    assert one(spark, C.phone_risk(F.col("n")), n=number) == risk


def test_wilson_interval(spark):
    assert one(spark, E.wilson(F.lit(24), F.lit(25), False), z=1) == pytest.approx(0.805, abs=1e-3)
    assert one(spark, E.wilson(F.lit(0), F.lit(0), True), z=1) is None


def brute_limit(rows, limit, window):
    taken, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = taken.setdefault(k, [])
        out[i] = len([x for x in own if x > t - window]) < limit
        if out[i]:
            own.append(t)
    return out


def test_rate_limit_is_the_sliding_log(spark):
    rows = [(k, float(t), i) for i, (k, t) in enumerate((k, (t * 37 + len(k)) % 900) for k in ("a", "bb") for t in range(60))]
    df = spark.createDataFrame(rows, "k string, s double, i long")
    got = {r["i"]: r["accepted"] for r in limits.rate_limited(df, "k", "s", "i", 3, 100).collect()}
    assert got == brute_limit(rows, 3, 100) and len(set(got.values())) == 2


def test_first_sighting_is_not_renewed(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate((0.0, 500.0, 650.0, 1200.0))], "k string, s double, i long")
    got = {r["s"]: r["duplicate"] for r in limits.first_seen(df, "k", "s", "i").collect()}
    assert got == {0.0: False, 500.0: True, 650.0: False, 1200.0: True}


def test_queries_without_sql(spark):
    assert queries.rate_limit_accepts(spark, SF).groupBy("accepted").count().count() == 2
    assert queries.ttl_dedupe(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    rungs = {r["rung"] for r in queries.submission_guard(spark, SF).select("rung").distinct().collect()}
    assert "accept" in rungs and rungs <= {"accept", "rate", "duplicate", "missing", "too_long"}


def test_limiter_as_stream(spark, tmp_path):
    spark.createDataFrame([("a", float(t)) for t in range(5)], "k string, s double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, s double").parquet(str(tmp_path / "in"))
    out = limits.rate_limited_stream(stream, "k", "s", 2)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FILTER (WHERE accepted) AS n FROM limited").first()["n"] == 2


def test_a_hot_key_is_decided_in_several_tasks(spark):
    """A key with most of the rows is cut where nothing happens for a window, with the same decisions."""
    rows = [("hot", float(1000 * b + t), 100 * b + t) for b in range(40) for t in range(0, 60, 2)] + [(f"k{i}", float(i * 7 % 50), 10_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s double, i long").repartition(7)
    parts = logs.segments(df, "k", "s", "i", 100)
    assert parts.filter("k = 'hot'").select("segment").distinct().count() == 40
    assert parts.groupBy("segment").agg(F.count_distinct("k").alias("n")).filter("n > 1").count() == 0
    decided = limits.rate_limited(df, "k", "s", "i", 3, 100)
    assert {r["i"]: r["accepted"] for r in decided.collect()} == brute_limit(rows, 3, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        assert limits.rate_limited(df, "k", "s", "i", 3, 100).filter("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_in_logs_of_any_size(spark):
    rows = [("hot", i) for i in range(900)] + [(None, i) for i in range(5)] + [(f"k{i % 50}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(6)
    got = sorted(((r["k"] or "", r["i"], r["nth"], r["report_count"]) for r in store.match_counts(df, "k", "i").collect()))
    want, by = [], {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append(i)
    for k, own in by.items():
        want += [(k or "", i, n, len(own)) for n, i in enumerate(sorted(own), 1)]
    assert got == sorted(want)


def test_asking_records_nothing(spark):
    hits = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 20.0)], "k string, s double")
    asked = spark.createDataFrame([("a", 20.0), ("a", 619.0), ("a", 620.0), ("b", 20.0), ("c", 1.0), ("a", 9.0)], "k string, s double")
    got = {(r["k"], r["s"]): r["allowed"] for r in limits.peeked(hits, asked, "k", "s", 1).collect()}
    assert got == {("a", 20.0): False, ("a", 619.0): False, ("a", 620.0): True, ("b", 20.0): False, ("c", 1.0): True, ("a", 9.0): True}


def test_state_of_the_stream_goes(spark, tmp_path):
    """Once the watermark has passed a key's window, its state is removed."""
    schema = "k string, s double"
    for i, rows in enumerate(([("a", 9000.0), ("b", 9001.0)], [("c", 15000.0)], [("c", 15001.0)], [("c", 15002.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = limits.rate_limited_stream(stream, "k", "s", 2).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        totals = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        if i == 0:
            assert totals[-1] == 2
    assert totals[-1] == 1


def test_sources(spark, tmp_path):
    (tmp_path / "list.csv").write_text('# head\n"1","d","http://Bad.Example/x","online"\n"2","d","http://old.example/","offline"\n"3","d","http://bad.example/y","online"\n')
    hosts = readers.blocklist(spark, str(tmp_path / "list.csv"))
    assert [r["host"] for r in hosts.collect()] == ["bad.example"]
    assert len(readers.hashed(hosts).first()["host_hash"]) == 16
    good = {"id": "1", "type": "sms", "content": "x", "label": "scam", "addedAt": "2026-01-02"}
    (tmp_path / "c.jsonl").write_text("# note\n" + json.dumps(good) + "\n" + json.dumps(good | {"label": "maybe"}) + "\nnot json\n")
    ok, wrong = readers.cases(spark, str(tmp_path / "c.jsonl"))
    assert ok.count() == 1 and wrong.count() == 2
