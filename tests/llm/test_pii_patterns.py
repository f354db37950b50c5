"""Patterns of operator 10 that reach identifiers of forms which no grammar has."""

import hashlib
import random
import re

from plumbline.llm import pii

GIVEN = "/root/testdata/sf0.01/documents.parquet"


def spans_of(spark, rows):
    return {r["doc_id"]: r["spans"] for r in pii.span_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def value(text, spans):
    return [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def seeds(n):
    return [(i, f"please call me on +1 (212) 555-{1000 + i} today") for i in range(n)]


def test_contexts_claim_forms_that_no_seed_has(spark):
    odd = ["0171-555-0199", "555 123 4567", "(0171) 555 0188", "0171 5550177", "GB29 6016 1331 9268 19"]
    rows = seeds(90) + [(100 + i, f"do call me on {v} if late") for i, v in enumerate(odd)]
    rows += [(200, "the part 0171-555-0199x0 is sold"), (201, "serial 555 123 4568 of the unit"), (202, "call me on 12 or 13 May")]
    found = spans_of(spark, rows)
    for i, v in enumerate(odd):
        (kind, got), = value(rows[90 + i][1], found[100 + i])
        assert kind == "phone" and got == v.lstrip("(")
    assert found[200] == found[201] == found[202] == ""


def test_claimed_identifiers_support_patterns_of_the_next_round(spark):
    """'ring our desk' has no seed at all, only numbers that the first round claims, and one that it can't."""
    odd = [f"0171-555-01{i}" for i in range(10, 26)]
    rows = seeds(300) + [(400 + i, f"or call me on {v} now") for i, v in enumerate(odd)]
    rows += [(500 + i, f"ring our desk {v} soon") for i, v in enumerate(odd)] + [(600, "ring our desk 0171/5550/999 soon"), (601, "ring twice 0171/5550/998 soon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r["doc_id"]: r["added"] for r in pii.extract(docs).collect()}
    assert [(s["kind"], rows[-2][1][s["start"] : s["end"]]) for s in added[600]] == [("phone", "0171/5550/999")]
    assert added[601] == [] and all(len(added[400 + i]) == 1 for i in range(len(odd)))


def test_parts_of_numbers():
    found = lambda t: [t[a:b] for _, k, a, b, *_ in pii.instances(t, pii.base_spans(t)) if k is None]
    assert found("on 555 123 4567, 89 or 555  123 4567") == ["555 123 4567", "123 4567"]
    assert found("at 0171 5550177") == ["0171 5550177", "5550177"]
    assert found("at 1234567\n7654321") == ["1234567", "7654321"]
    assert found("10.1.2.3 555 123 4567") == ["555 123 4567"] and found("1 " * 60) == []


def test_spans_of_wholes_and_parts_do_not_overlap(spark):
    rows = seeds(60) + [(100, "call me on 0171 5550177 now")] + [(200 + i, f"call me on 5550177 now {i}") for i in range(3)]
    found = spans_of(spark, rows)
    assert value(rows[60][1], found[100]) == [("phone", "0171 5550177")] and value(rows[61][1], found[200]) == [("phone", "5550177")]


def luhn(digits):
    twice = [int(d) * (2 - (len(digits) - i) % 2) for i, d in enumerate(digits)]
    return sum(n - 9 if n > 9 else n for n in twice) % 10 == 0


def plain_spans(text):
    """The four grammars as plain regular expressions, kind by kind."""
    t, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_counts_and_digests_of_the_given_documents(spark):
    docs = spark.read.parquet(GIVEN)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in pii.span_rows(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        base = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",") if r["spans"] else [])


def test_held_out_secrets_are_found_by_their_context(spark):
    """Half of the given documents' keys are hidden from the seeds; contexts must find them, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text LIKE '%token = %' OR doc_id % 5 = 0")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    half = {"secret": re.compile(r"(?<=\")[0-7][0-9a-f]{39}(?=\")")}
    hidden = {(i, *m.span()) for i, t in texts.items() for m in re.finditer(r"(?<=\")[89a-f][0-9a-f]{39}(?=\")", t)}
    seen = {(i, *m.span()) for i, t in texts.items() for m in half["secret"].finditer(t)}
    added = {(r["doc_id"], s["start"], s["end"]) for r in pii.extract(docs, seeds=half).collect() for s in r["added"]} - seen
    assert len(hidden) > 50
    recall, precision = len(hidden & added) / len(hidden), len(hidden & added) / max(1, len(added))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, sorted(added - hidden)[:5])


def test_held_out_cards_of_a_built_corpus(spark):
    """Numbers without a valid last digit after 'card number' and 'pay with', and others that are no cards."""
    r = random.Random(3)
    words = "please the order is shipped soon and we will pay with card number today thanks again to you".split()
    lead = lambda: " ".join(r.choice(words[:9]) for _ in range(4))
    good = [n for n in (f"4{r.randrange(10**15):015d}" for _ in range(4000)) if luhn(n)]
    bad = [n for n in (f"4{r.randrange(10**15):015d}" for _ in range(400)) if not luhn(n)]
    rows = [(i, f"{lead()} {('card number', 'pay with')[i % 2]} {n} {lead()}") for i, n in enumerate(good[:200])]
    rows += [(1000 + i, f"{lead()} {('card number', 'pay with')[i % 2]} {n} {lead()}") for i, n in enumerate(bad[:12])]
    rows += [(2000 + i, f"{lead()} parcel {n} {lead()}") for i, n in enumerate(bad[20:60])]
    found = spans_of(spark, rows)
    caught = sum(found[1000 + i].startswith("card:") for i in range(12))
    assert caught == 12 and not any(found[2000 + i] for i in range(40))


def test_nothing_is_cut(spark):
    """Long words, long gaps and long shapes around an identifier."""
    far, wide = " " * 500, "x1-" * 60
    rows = [(i, f"my desk{far}{wide}{far}phone +1 (212) 555-{1000 + i}") for i in range(60)] + [(90, f"my desk{far}{wide}{far}phone 0171-555-0199"), (91, f"my desk{far}{wide}y{far}fax 0171-555-0198")]
    found = spans_of(spark, rows)
    assert value(rows[60][1], found[90])[-1] == ("phone", "0171-555-0199")
    assert ("phone", "0171-555-0198") not in value(rows[61][1], found[91])
