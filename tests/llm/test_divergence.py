"""The audit against plain counting: nulls, groups without terms, ties, repeated rows, odd letters, clashing names."""

import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import divergence

TERM = re.compile(r"[A-Za-z\x80-\U0010FFFF]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term string, shard int"


def plain(rows, least=10, reported=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= reported]
    return sorted(out)


def rows_of(seed, n=300):
    draw = random.Random(seed)
    words = ["Alpha", "alpha", "beta", "Été", "été", "東京", "don't", "x1y", "rare" + "z" * 500] + [f"w{chr(97 + i)}" for i in range(14)]
    rows = []
    for i in range(n):
        source = draw.choice(["hot", "hot", "b", "é", "z", None, ""])
        lang = draw.choice(["en", "en", "fr", None])
        k = {"hot": 30, "b": 8}.get(source, 4)
        rows.append((i, draw.choice([None, "", "12 34"]) if draw.random() < 0.1 else " ".join(draw.choice(words) for _ in range(draw.randrange(k))), lang, source))
    return rows + rows[:5] + [(900, None, "de", "only"), (901, "few terms", "it", "a"), (902, "few terms", "it", "b"), (None, "alpha " * 100_000, "en", "long")]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_plain_counting(spark, seed, monkeypatch):
    if seed == 2:  # many slices and shards
        monkeypatch.setattr(divergence, "SHARD_ROWS", 20)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r[:2], *r[2:], 1, "t", 7) for r in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs).collect())
    assert got == plain(rows)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
