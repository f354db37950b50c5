"""The operators against brute force on rows with nulls, ties, copies, near copies and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, exact_dedup, jaccard, license_scan, packing, pii, quality, sharding, substring_dedup, token_orc
from plumbline.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, rows = text(70), []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            t = text(r.randint(5, 300))
        elif kind == 1:
            t = text(30) + "\n" + shared + "\n\t" + text(30)
        elif kind == 2:
            own = rows[-2][1].split(" ")
            own[len(own) // 2] = "changed"
            t = " ".join(own)
        elif kind == 3:
            t = rows[-3][1].upper() if r.random() < 0.5 else rows[-3][1]
        elif kind == 4:
            t = f"MIT License call +1 (269) 555-3296 or a.b@c.example.com, 10.1.2.3 card 4111 1111 1111 1111 {text(40)}"
        else:
            t = " ".join([text(9)] * 12)
        rows.append((i, t))
    return rows + [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "One TWO"), (105, "x" * 5000), (106, text(20000)), (107, "it's 12 don't <|endoftext|> ÀÉ 東京 🎉"), (107, "a second row of 107"), (None, shared), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names clash with the operators' own must not matter.
    rows = [(i, t, "x", 1, 2) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, node string, rank int, shard int").repartition(3).cache()


def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs):
    got = exact_dedup.deduplicate(docs).collect()
    norm = [(i, (t or "").translate(LOWER)) for i, t in corpus()]
    sizes, keep = Counter(t for _, t in norm), {}
    for i, t in norm:
        keep[t] = max([keep.get(t), i], key=lambda x: -1 if x is None else x)
    want = Counter((i, keep[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(sizes)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(sizes)


def test_exact_dedup_checks_whole_texts(docs):
    """With a digest that always collides the answer is the same."""
    got = exact_dedup.deduplicate(docs, digest=lambda body: F.substring(F.sha2(body.cast("binary"), 256), 1, 1)).filter("kept").count()
    assert got == len({(t or "").translate(LOWER) for _, t in corpus()})


def test_exact_dedup_checks_texts_without_repeating_digests(spark):
    """The check of full bytes repeats no digest for each part and broadcasts nothing; a lone text is no fault."""
    rows = [(i, "a", "copy") for i in range(100)] + [(i, "b", f"text {i % 2}") for i in range(2, 100, 48)] + [(None, "c", "x"), (7, "c", "y"), (8, "d", "alone")]
    texts = spark.createDataFrame(rows, "doc_id bigint, digest string, body string")
    shared = exact_dedup._shared_digests(texts)
    plan = shared._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    assert sorted(r["digest"] for r in shared.collect()) == ["c"]
    assert sorted(r["digest"] for r in exact_dedup._shared_digests(texts.withColumn("body", F.concat("body", F.expr("IF(doc_id IN (3, 50), 'z', '')")))).collect()) == ["a", "b", "c"]


def test_sharding(docs):
    rows = sharding.shard(docs, 24).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sizes
    moved = sharding.jump_hash(np.arange(20000), 24) != sharding.jump_hash(np.arange(20000), 25)
    assert 0.03 < moved.mean() < 0.05


def test_license_scan(docs):
    found = {(r["doc_id"], r["n_words"]): r for r in license_scan.scan(docs).collect()}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, t in corpus():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = found[i, len(w)]
        places = [k for k, _ in at]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(at), min(places, default=None), max(places, default=None))
        base = {label for _, label in at}
        assert r["base_labels"] == ",".join(sorted(base)) and base <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_substring_dedup(docs):
    rank = lambda i: -(2**63) if i is None else i
    words = [(rank(i), WORD.findall(t or "")) for i, t in corpus()]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[None if i == -(2**63) else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.digest_rows(docs).collect()) == want
    assert sum(k[2] for k in want) > 500


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(docs, tokenizer):
    want = Counter()
    for i, t in corpus():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digest_rows(docs).collect()) == want


def test_packing_loses_no_id(docs, tokenizer):
    rows = packing.pack(docs, window=256).collect()
    want = Counter()
    for i, t in corpus():
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:
        assert r["sequence_id"] * 256 + r["offset"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["length"]
    got, held = Counter(), []
    for r in stream:
        held += np.frombuffer(r["ids"], "<u4").tolist()
        if r["start"] + r["length"] == r["doc_tokens"]:
            got[r["doc_id"], tuple(held)] += 1
            held = []
    assert got == want


def test_token_orc(docs, tokenizer):
    rows = sorted(token_orc.round_trip(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    want = Counter()
    for i, t in corpus():
        x = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_quality(docs):
    rows = quality.judged(docs.select("doc_id", "text")).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    want = Counter()
    for i, t in corpus():
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        n = len(covered)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, n, len(w) < 20 or 100 * n > 30 * len(w)] += 1
    assert got == want and all(not (r["kept"] and r["base_failed"]) for r in rows)


def sets_of(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(docs):
    rows = [(i, sets_of(t)) for i, t in corpus() if i is not None and t != "a second row of 107"]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            n = len(a & b)
            if n and 100 * n >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    want = {(i, len(s), find(i)) for i, s in rows}
    own = docs.filter("doc_id IS NOT NULL AND (text IS NULL OR text <> 'a second row of 107')")
    assert {tuple(r)[:3] for r in jaccard.classes_of(own).collect()} == want
    assert jaccard.classes_of(docs).count() == len(corpus())


def test_pii_spans_are_exact(docs):
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.span_rows(docs).collect())
    want = Counter((i, *([1, 1, 1, 1] if t and t.startswith("MIT License") else [0] * 4)) for i, t in corpus())
    copies = [i for i, t in corpus() if t and t.startswith("MIT LICENSE")]
    assert {k: v for k, v in got.items() if k[0] not in copies} == {k: v for k, v in want.items() if k[0] not in copies}
    assert pii.base_spans("a@b.c.d@e.f 1.2.3.4.5 999.1.1.1") == [("email", 0, 7), ("ip", 12, 19)]


def test_patterns_find_unseen_identifiers(spark):
    """A card number with a wrong digit is found where right ones stand; the same number elsewhere is not."""
    valid = [str(n) for n in range(4000000000000000, 4000000000000300) if pii.base_spans(str(n))][:20]
    rows = [(i, f"please pay with {n} now") for i, n in enumerate(valid)]
    rows += [(50, "please pay with 4999999999999999 now"), (51, "order number 4999999999999998 shipped"), (52, "version 2.0 of 2024 is fine")]
    found = {r["doc_id"]: r for r in pii.span_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i]["n_card"] == 1 for i in range(20))
    assert found[50]["n_card"] == 0 and found[50]["spans"] == "card:16:32"
    assert found[51]["spans"] == "" and found[52]["spans"] == ""


def test_word_hashes_tell_words_apart():
    w = W.split(["a b a", None, "é" * 100 + " " + "é" * 99 + "e"])
    h = w.hashes.tolist()
    assert h[0] == h[2] and len(set(h)) == 4 and w.bounds.tolist() == [0, 3, 3, 5]
    v = np.array([5, 1, 4, 1, 9, 0, 3], np.uint64)
    assert W.window_minima(v, 3).tolist() == [1, 1, 3, 5, 5]


@pytest.mark.parametrize("operator", [
    exact_dedup.deduplicate, lambda d: sharding.shard(d, 24), license_scan.scan, substring_dedup.digest_rows, bpe.digest_rows,
    quality.judged, packing.pack, jaccard.classes_of, token_orc.round_trip, pii.span_rows,
])
def test_empty_tables(docs, operator):
    assert operator(empty(docs)).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, docs, tmp_path):
    (tmp_path / "in").mkdir()
    docs.select("doc_id", "text").withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(str(tmp_path / "in/documents.parquet"))
    left = spark.read.parquet(str(tmp_path / "in/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, "")
        assert after.columns == left.columns
        left = after
    texts = [r["text"] for r in left.collect()]
    assert not any("@c.example.com" in t for t in texts)
    for x, a in enumerate(texts):
        for b in texts[:x]:
            s, t = sets_of(a), sets_of(b)
            assert a == b == "" or 100 * len(s & t) < 80 * len(s | t)
    pieces = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in left.collect()}
