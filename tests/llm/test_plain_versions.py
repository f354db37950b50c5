"""Sharding, ORC files and clashing column names against plain versions."""

import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, jaccard, license_scan, packing, pii, quality, sharding, substring_dedup, token_orc, bpe
from plumbline.llm import oracles

MASK = (1 << 64) - 1


def spread(key):
    x = ((-(2**63) if key is None else key) + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def jump(key, shards):
    """Jump consistent hash, one key at a time."""
    state, here, ahead = spread(key), -1, 0
    while ahead < shards:
        here = ahead
        state = (state * 2862933555777941757 + 1) & MASK
        ahead = int((here + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return here


def test_shards_and_slots_equal_the_plain_version(spark):
    rows = [(i * 7 - 300, None if i % 50 == 0 else "é" * (i % 9)) for i in range(1500)] + [(None, "a"), (None, None), (0, "b"), (0, "b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, slot int").repartition(5)
    got = sharding.shard(docs, 24).collect()
    want, places = [], {}
    order = lambda r: (jump(r[0], 24), r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    for i, t in sorted(rows, key=order):
        s, raw = jump(i, 24), (t or "").encode()
        places[s] = places.get(s, -1) + 1
        want.append((i, len(raw) + 8, zlib.crc32(raw), "key", s, places[s], jump(i, 25)))
    key = lambda x: (x[4], x[5])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)


def rows_read(df):
    """Rows that leave the scan when the plan runs."""
    df._jdf.queryExecution()
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaf = plan
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """Files hold several stripes with run lengths; readers skip rows by index and by Bloom filter."""
    from pyarrow import orc

    rows = [(2 * i, f"the word number {i}" + " again" * 60) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_orc.write(docs.coalesce(1), path, stripe_bytes=1 << 16, index_rows=1000)
    files = sorted((tmp_path / "ids").glob("*.orc"))
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == len(rows)
    assert max(orc.ORCFile(str(f)).nstripes for f in files) > 1
    raw = sum(4 * r["n_tokens"] for r in token_orc.read(spark, path).collect())
    assert sum(f.stat().st_size for f in files) < raw / 2
    found = token_orc.read(spark, path)
    assert found.filter("doc_id = 12346").count() == 1
    assert rows_read(found.filter("doc_id = 12346").select("n_tokens")) <= 1000
    assert rows_read(found.filter("doc_id >= 0").select("n_tokens")) == len(rows)
    # Odd ids lie between the written ones: only the Bloom filter can tell that none is there.
    misses = [rows_read(found.filter(f"doc_id = {2 * i + 1}").select("n_tokens")) for i in range(500, 19_000, 1850)]
    assert sum(m == 0 for m in misses) >= len(misses) - 1
    plain = str(tmp_path / "plain")
    found.write.options(**{"orc.row.index.stride": "1000"}).orc(plain)
    assert rows_read(token_orc.read(spark, plain).filter("doc_id = 1001").select("n_tokens")) > 0


CLASHING = ["row_no", "own_row", "own_id", "own_text", "own_sha", "own_name", "node", "digest", "kept", "n_words", "n_lines", "q_words", "hundred", "spans", "hit_id", "rank", "task", "before", "ids", "shard", "label", "words", "component", "n_tokens", "start", "slot", "text_hash", "first", "row_key", "seeds"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"the first text of {i} is on line " + " ".join(f"w{i}x{j} and" for j in range(25)), *[i] * len(CLASHING)) for i in range(6)]
    rows += [(9, rows[0][1].upper(), *[7] * len(CLASHING)), (None, None, *[None] * len(CLASHING))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING))


@pytest.mark.parametrize("operator", [
    exact_dedup.deduplicate, lambda d: sharding.shard(d, 24), license_scan.scan, substring_dedup.digest_rows, bpe.digest_rows, quality.judged,
    packing.pack, jaccard.classes_of, token_orc.round_trip, pii.span_rows,
])
def test_clashing_names_change_nothing(clashing, operator):
    names = [c for c in operator(clashing.select("doc_id", "text")).columns if c != "text"]
    count = lambda df: sorted((str(tuple(r)) for r in operator(df).select(names).collect()))
    assert count(clashing) == count(clashing.select("doc_id", "text"))


@pytest.mark.parametrize("operator", [exact_dedup.kept_rows, quality.kept_rows, jaccard.kept_rows, lambda d: pii.redacted(d)])
def test_kept_rows_keep_clashing_columns(clashing, operator):
    out = operator(clashing)
    assert out.columns == clashing.columns
    own = {(r["doc_id"], r["kept"], r["own_row"], r["row_no"]) for r in clashing.collect()}
    assert {(r["doc_id"], r["kept"], r["own_row"], r["row_no"]) for r in out.collect()} <= own


def test_sql_of_sharding_and_quality(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    from plumbline.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    for name in ("op2_sharding", "op6_quality"):
        got = queries.queries()[name](spark, path)
        want = con.execute(oracles.SQL[name]).df().astype(object).to_dict("records")
        order = sorted(got.columns)
        shown = lambda rows: sorted(str([r[c] for c in order]) for r in rows)
        assert shown(r.asDict() for r in got.collect()) == shown(want)
