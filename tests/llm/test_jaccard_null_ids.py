"""Null ids in the Jaccard join: near copies without an id are linked, and so is what only they connect."""

from collections import Counter

from plumbline.llm import jaccard

LENGTH, STEP = 120, 10


def texts():
    """Each of a chain shares LENGTH - STEP words with the next: neighbours are linked, others are not."""
    w = [f"w{i}" for i in range(400)]
    chain = [" ".join(w[i * STEP : i * STEP + LENGTH]) for i in range(3)]
    lone = " ".join(f"v{i}" for i in range(LENGTH))
    return chain, lone, lone.replace("v60", "other"), " ".join(f"u{i}" for i in range(30))


def rows():
    (a, bridge, c), lone, near, alone = texts()
    return [(1, a), (None, bridge), (3, c), (None, lone), (None, near), (None, near.upper()), (None, alone), (None, ""), (None, None), (9, "")]


def test_chain_is_linked_by_its_middle_only():
    (a, bridge, c), *_ = texts()
    s = [set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, bridge, c)]
    share = lambda x, y: len(x & y) / len(x | y)
    assert share(s[0], s[1]) >= 0.75 and share(s[1], s[2]) >= 0.75 and share(s[0], s[2]) < 0.75


def test_null_ids_keep_their_links(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in jaccard.classes_of(docs).collect())
    assert got == Counter({(1, True, 1): 1, (None, True, 1): 1, (3, True, 1): 1, (None, True, None): 4, (None, False, None): 2, (9, False, 9): 1})


def test_one_row_of_each_group_stays_without_ids(spark):
    (a, bridge, c), lone, near, alone = texts()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows()], "doc_id long, text string, node int").repartition(3)
    kept = jaccard.kept_rows(docs)
    assert kept.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    of_group = [x for x in left.elements() if x[1] in (lone, near, near.upper())]
    assert len(of_group) == 1
    assert left == Counter([(1, a), (None, alone), (None, ""), (None, None), (9, ""), of_group[0]])
