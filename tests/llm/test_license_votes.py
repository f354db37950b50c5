"""Diagonal voting against a plain version that looks at every row, template and diagonal."""

import re
from collections import Counter

import pytest

from plumbline.llm import license_scan as L

PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """n_words, n_base, first and last place, base labels, all labels and score of a text."""
    w = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    texts = [(label, t.split()) for label, ts in L.TEMPLATES.items() for t in ts]
    grams = [[tuple(t[p : p + 3]) for p in range(len(t) - 2)] for _, t in texts]
    spans = []
    for n, own in enumerate(grams):
        lines = {}
        for p, g in enumerate(own):
            for i in at.get(g, ()):
                lines.setdefault(i - p, set()).add(p)
        merged = {d: [(p + e, p) for e in lines if abs(e - d) <= L.DRIFT for p in lines[e]] for d in lines}
        size = {d: len({p for _, p in m}) for d, m in merged.items()}
        others = [set(g) for k, g in enumerate(grams) if texts[k][0] != texts[n][0]]
        for d, m in merged.items():
            if any(abs(e - d) <= L.DRIFT and (size[e], -e) > (size[d], -d) for e in lines):
                continue
            hit = {p for _, p in m}
            similar = [o for o in others if 0 < sum(g not in o for g in own) <= (1 - L.COVERAGE) * len(own)]
            if len(hit) / len(own) >= L.COVERAGE and all(any(own[p] not in o for p in hit) for o in similar):
                spans.append((texts[n][0], min(i for i, _ in m), max(i for i, _ in m) + 2, len(hit) / len(own), len(hit)))
    best = {}
    for label, a, b, c, k in spans:
        for i in range(a, b + 1):
            best[i] = max(best.get(i, (0, 0)), (c, k))
    won = {(i, label) for label, a, b, c, k in spans for i in range(a, b + 1) if (c, k) == best[i]}
    kept = [s for s in spans if all((i, s[0]) in won for i in range(s[1], s[2] + 1))]
    base, at = sorted({label for _, label in places}), sorted(i for i, _ in places)
    score = max([s[3] for s in kept] + [1.0 if places else 0.0])
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(base), ",".join(sorted({*base, *(s[0] for s in kept)})), round(score, 9)


def corpus():
    mit = L.TEMPLATES["mit"][1]
    dropped = " ".join(x for i, x in enumerate(mit.split()) if i % 17 != 9)
    lgpl = L.TEMPLATES["lgpl"][0]
    return [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "This work is licensed under the GNU General Public License, version 2."),
        (3, "This work is licensed under the GNU General Public License, version 1."),
        (4, "license version 2 and licensed under the"), (4, "released under the MIT License"),
        (5, "licensed under CC BY 4.0"), (6, "licensed under cc by 4 0" + " cc by 4 0" * 5), (7, "licensed under CC-BY-NC 4.0"),
        (None, "released under the"), (None, "under the MIT license"), (None, None), (8, ""), (9, "one two"),
        (10, "intro " * 40 + mit + " outro" * 40), (11, dropped), (12, mit.upper() + " " + mit), (13, lgpl), (14, L.TEMPLATES["gpl-3.0"][1]),
        (15, L.TEMPLATES["apache-2.0"][1] + ". " + L.TEMPLATES["bsd"][0]), (16, "cc by " * 3000 + mit), (16, "cc by " * 3000 + mit),
        (17, L.TEMPLATES["agpl-3.0"][0]), (18, L.TEMPLATES["isc"][0] + " " + L.TEMPLATES["zlib"][0]), (19, "ünïcode license é MIT license"),
    ]


def shown(rows):
    return Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in rows)


def test_labels_and_scores_equal_the_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, template int, label string").repartition(3)
    got = L.scan(docs)
    assert shown(got.collect()) == Counter((i, *plain(t)) for i, t in rows)


def test_versions_mixed_rows_and_long_runs():
    labels = [plain(t)[5] for _, t in corpus()]
    assert labels[0] == "gpl,gpl-3.0" and labels[1] == "gpl,gpl-2.0" and labels[2] == "gpl"
    assert labels[3] == "" and labels[4] == "mit" and labels[5] == labels[6] == "cc-by,cc-by-4.0"
    assert plain("released under the")[6] == 0.0 and plain(corpus()[16][1])[5] == "lgpl"


@pytest.mark.parametrize("label", sorted(L.TEMPLATES))
def test_every_template_is_its_own_label(label):
    for text in L.TEMPLATES[label]:
        found = set(plain(text)[5].split(","))
        assert label in found and found - {label} <= {"gpl", "apache", "cc-by", "mit"}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert shown(L.scan(docs).collect()) == Counter((r["doc_id"], *plain(r["text"])) for r in docs.collect())
