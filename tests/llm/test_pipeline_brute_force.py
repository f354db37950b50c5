"""The whole pipeline against the same stages in plain Python, on whole rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import exact_dedup, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PRIVATE = {"mail me at kim.{0}@mail.example.com": "mail me at <EMAIL>", "ring +1 (212) 555-71{0} first": "ring <PHONE> first", "host 10.1.2.{0} is": "host <IP> is", "charge 4111 1111 1111 1111 for {0}": "charge <CARD> for {0}"}


def corpus():
    """Rows, and the redacted text of those that hold personal data."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randint(3, 8))) for _ in range(500)]
    text = lambda n: " ".join("the" if i % 9 == 4 else r.choice(vocabulary) for i in range(n))
    rows, clean = [], {}

    def changed(t, places):
        own = t.split(" ")
        for at in places:
            own[at] = "changed"
        return " ".join(own)

    for i in range(12):
        base = text(100)
        rows += [(10 * i + 5, base), (10 * i + 7, base.upper()), (10 * i + 2, base)]
        # Of 96 shingles two changes keep 86 of 106, which is a link; three keep 81 of 111, just too few.
        near, far = text(100), text(100)
        rows += [(1000 + i, near), (999 - i, changed(near, (20, 60))), (2000 + i, far), (2100 + i, changed(far, (20, 50, 80)))]
    for i, (private, cleaned) in enumerate([*PRIVATE.items()] * 2):
        a, b = text(30), text(30)
        t = f"{a} {private.format(20 + i)} {b}"
        rows.append((3000 + i, t))
        clean[t] = f"{a} {cleaned.format(20 + i)} {b}"
    # Neighbours share 76 of 96 shingles, the ends of the chain 66 of 106: all three are one component.
    chain = text(120).split(" ")
    rows += [(4000 + i, " ".join(chain[10 * i : 10 * i + 90])) for i in (2, 0, 1)]
    whole = text(100)
    rows += [(5000, whole), (None, changed(whole, (50,))), (None, text(60))]
    line = text(8)
    rows += [(6000, "too short"), (6001, None), (6002, ""), (6003, "\n".join([line] * 9)), (6004, " ".join(w + "#" for w in text(50).split(" "))), (6005, text(50).replace("the", "xyz")), (6006, " ".join(w + "!!" for w in text(50).split(" "))), (6007, " ".join("the" + c * 20 for c in "abcdefghijklmnopqrstuvw") + " the")]
    rows += [(7000, text(9000)), (7001, text(40) + " order 1234567 left")]
    return rows, clean


def passes(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    many = Counter(windows)
    repeated = len({k + d for k, x in enumerate(windows) if many[x] > 1 for d in range(8)})
    n, stop = len(w), sum(x.lower() in quality.STOP_WORDS for x in w)
    return (
        n >= 20 and 100 * repeated <= 30 * n and 200 * n <= 100 * sum(map(len, w)) <= 1200 * n
        and 100 * sum(c in quality.SYMBOLS for c in t) <= 40 * n and 100 * (len(lines) - len(set(lines))) <= 40 * len(lines)
        and 100 * stop >= n and 100 * sum(x.endswith("!!") for x in w) <= 40 * n
    )


def survivors(rows):
    rank = lambda i: -1 if i is None else i
    best = {}
    for i, t in rows:
        if passes(t):
            key = t.translate(LOWER)
            best[key] = max(best.get(key, (i, t)), (i, t), key=lambda x: rank(x[0]))
    left = [*best.values()]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (WORD.findall(t.translate(LOWER)) for _, t in left)]
    group = list(range(len(left)))
    for x in range(len(left)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if 100 * n >= 75 * len(sets[x] | sets[y]):
                group = [group[y] if g == group[x] else g for g in group]
    first = {}
    for g, row in zip(group, left):
        first[g] = min(first.get(g, row), row, key=lambda x: 1 << 60 if x[0] is None else x[0])
    return [*first.values()], len(left)


def test_pipeline_equals_plain_python(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows, clean = corpus()
    left, after_exact = survivors(rows)
    assert len(left) < after_exact < sum(passes(t) for _, t in rows) < len(rows) and {t for _, t in left} > set(clean)

    path = str(tmp_path / "in")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    want = Counter((i, *tokenizer.encode(clean.get(t, t), add_special_tokens=False).ids, 2) for i, t in left)
    pieces = sorted(corpus_pipeline.run(spark, path).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    # A document's pieces follow each other in the stream, so its rows are known by its first token's place.
    at, runs = 0, []
    for r in pieces:
        assert r["sequence_id"] * 4096 + r["offset"] == at
        at += r["length"]
        runs += [[]] if r["start"] == 0 else []
        runs[-1].append(r)
    assert len(runs) == len(left) and any(len(run) > 1 for run in runs)

    def fits(ids, run):
        if any((r["doc_id"], r["doc_tokens"]) != (ids[0], len(ids) - 1) for r in run):
            return False
        own = np.array(ids[1:], "<u4")
        return sum(r["length"] for r in run) == own.size and all(zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in run)

    for run in runs:
        found = next((ids for ids in want if fits(ids, run)), None)
        assert found is not None, run
        want -= Counter([found])
    assert not want


def test_exact_stage_sends_no_repeated_digests_through_the_driver(spark, monkeypatch):
    """Whatever Spark's broadcast threshold, the stage's check of full bytes repeats and broadcasts no digests."""
    checks, own = [], exact_dedup._shared_digests
    monkeypatch.setattr(exact_dedup, "_shared_digests", lambda *given: checks.append(own(*given)) or checks[-1])
    docs = spark.createDataFrame([(i, f"Text {i % 7}", "x") for i in range(40)] + [(None, "TEXT 1", "y"), (50, None, "z")], "doc_id bigint, text string, source string")
    kept = corpus_pipeline.exact_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [33, 34, 35, 36, 37, 38, 39, 50]
    plans = [c._jdf.queryExecution().toString() for c in checks]
    assert len(plans) == 1 and "Generate" not in plans[0] and "Broadcast" not in plans[0]
