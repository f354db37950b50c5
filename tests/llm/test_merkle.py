"""Manifests against a plain tree: nulls, ties, repeated rows, lone leaves and groups, clashing names."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from plumbline.llm.common import Tables

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, idx int, run string, grp string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    i, text, lang, source, n = row
    return sha("".join(map(field, (i, source, lang, n, text))))


def climb(nodes, at):
    """The root over some nodes and, level by level, what stands before and after one of them."""
    path = []
    while len(nodes) > 1:
        first = at // 3 * 3
        run = nodes[first : first + 3]
        path.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        nodes, at = [sha("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)], at // 3
    return nodes[0], path


def plain(rows):
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    groups = [sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for _, g in groupby(sorted(rows, key=key), key)]
    subroots, out = [climb([leaf(r) for r in g], 0)[0] for g in groups], []
    for k, g in enumerate(groups):
        leaves = [leaf(r) for r in g]
        root, above = climb(subroots, k)
        for j, r in enumerate(g):
            path = climb(leaves, j)[1] + above
            text = r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")
            fold = leaf((r[0], text, *r[2:]))
            for before, after in path:
                fold = sha(before + fold + after)
            out.append((r[0], leaves[j], subroots[k], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


def rows_of(groups, seed=3):
    r, rows = random.Random(seed), []
    for source, n in groups:
        for _ in range(n):
            text = r.choice([None, "", "\n", "a\nb", "é\n東京", f"{r.random()}\n"])
            rows.append((r.choice([None, r.randrange(-5, 500)]), text, r.choice(["en", None, ""]), source, r.choice([None, 7])))
    return rows + rows[:2]


@pytest.mark.parametrize("groups", [[("a", 1)], [("a", 3)], [("a", 4), (None, 1), ("", 2)], [("a", 90), ("b", 28), (None, 10), ("", 1), ("é", 3), ("B", 9), ("=", 1)]])
def test_manifest_equals_the_plain_trees(spark, groups):
    rows = rows_of(groups)
    rows = rows[:1] if groups == [("a", 1)] else rows
    rows += [(77, "x\n" * 200_000, "en", "a", 1)] * (len(rows) > 20)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.manifest(docs).collect()]
    order = lambda x: str(x)
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_untouched_rows_verify_and_any_change_shows(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", i) for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    for changed, holds in ((None, 50), (F.col("doc_id") == 7, 49)):
        found = merkle.proofs(docs, Tables(spark), changed=changed, changes={"lang": F.lit("xx")})
        assert found.filter(merkle.folded(F.col("checked"), F.col("path")) == F.col("root")).count() == holds
