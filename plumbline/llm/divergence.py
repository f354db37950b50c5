"""Audit of how far the sources of a language diverge in their words (operator 13).

The terms of every text are counted in three steps, the first two of them with vectorized DuckDB SQL
inside Spark's tasks:

1. Each task counts the terms of its own documents by (lang, source, term), a slice of text at a time,
   so a term or a source that fills a third of the input sends one row from each slice.
2. Rows are dealt to shards by hash of (lang, term); no language and no source is in one place.  A
   shard has all rows of its terms, so it adds up their counts, drops terms in too few documents
   of the language, and names what is left.  Spark adds up the totals of groups and languages.
3. The same shards then get the totals of their groups and sum what each pair of sources differs by over
   the shard's terms; Spark adds the partial sums up and ranks them.  Terms that two sources lack
   differ by the same amount, which is multiplied, not summed; for terms that one of them lacks,
   occurrences are counted by their number first.  So work follows the sources that do have a term.

Shares, differences and sums are integers throughout, the larger products in 128 bits.

Defined cases: null text, lang and source count as ''; rows that repeat an id are documents of their own;
a language none of whose terms is frequent gives pairs of value 0 and no terms; a group without terms is
compared like any other; ties rank by the item's UTF-8 bytes; texts of any length are read whole; an
empty table gives no rows; columns other than the three named may have any name.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, empty_if_null, slices

#: A run of letters: A-Z, a-z and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language in which a term must be, and terms that a report names.
LEAST_DOCUMENTS, REPORTED = 10, 10
SCALE = 1_000_000_000
#: Bytes of text counted at a time, rows that a shard holds on average, and memory of a task's SQL.
SLICE, SHARD_ROWS, MEMORY = 32_000_000, 400_000, "400MB"


def _session(folder: str) -> duckdb.DuckDBPyConnection:
    """A database in memory that spills into a folder of the task's own."""
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})


def share(count: str, total: str, terms: str) -> str:
    """SQL of a term's smoothed share, scaled to an integer; the product needs 128 bits."""
    return f"(1 + CAST(({SCALE}::HUGEINT * ({count} + 2)) // ({total} + 2 * {terms}) AS BIGINT))"


def differs(p: str, q: str) -> str:
    """SQL of what two shares differ by."""
    return f"((({p} - {q}) * ({p} - {q})) // ({p} + {q}))"


COUNTED = "lang string, source string, term string, n bigint, docs bigint"
_COUNT = f"""SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs
FROM (SELECT lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM texts)
GROUP BY lang, source, term"""


def counted(rows: DataFrame) -> DataFrame:
    """Counts by (lang, source, term) of each slice of text: occurrences and documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            for batch in _gathered(slices(batches, "text", SLICE)):
                with _session(folder) as con:
                    con.register("texts", batch.append_column("row", pa.array(range(batch.num_rows), pa.int64())))
                    yield from _plain(con.sql(_COUNT).to_arrow_table()).to_batches()

    return rows.mapInArrow(count, COUNTED)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold a slice's bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > SLICE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _plain(table: pa.Table) -> pa.Table:
    """The table with the string type that Spark expects back."""
    return table.cast(pa.schema([(f.name, pa.string() if f.type in (pa.large_string(), pa.string_view()) else f.type) for f in table.schema]))


def _rows(con: duckdb.DuckDBPyConnection, name: str, batches: Iterator[pa.RecordBatch]) -> None:
    """The batches as a table of the database, one after another: none waits in Python."""
    for i, batch in enumerate(batches):
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute(f"INSERT INTO {name} SELECT * FROM batch" if i else f"CREATE TABLE {name} AS SELECT * FROM batch").fetchall()
        con.unregister("batch")


def _is_empty(con: duckdb.DuckDBPyConnection) -> bool:
    return not con.execute("SELECT count(*) FROM duckdb_tables()").fetchall()[0][0]


KEPT = "shard int, lang string, source string, term string, n bigint, first int"
_KEEP = """SELECT shard, lang, source, term, CAST(sum(n) AS BIGINT) AS n,
 CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS INTEGER) AS first
FROM counts GROUP BY shard, lang, source, term QUALIFY sum(sum(docs)) OVER (PARTITION BY lang, term) >= {least}"""


def kept_terms(counts: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The counts of each group's terms that are in enough documents of the language; of each
    language's term one row is marked as first.  A task has one shard."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder, _session(folder) as con:
            _rows(con, "counts", batches)
            if not _is_empty(con):
                yield from _plain(con.sql(_KEEP.format(least=least)).to_arrow_table()).to_batches()

    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    dealt = counts.select(shard.alias("shard"), "*").repartitionById(shards, "shard")
    return dealt.mapInArrow(keep, KEPT)


PARTIAL = "kind string, lang string, a string, b string, term string, value bigint"
#: Counts with the shares of their group, and what a share is where the term is missing.
_SHARES = f"""CREATE TEMP TABLE c AS SELECT c.lang, c.source, c.term, c.n, g.p0, {share("c.n", "g.total", "g.terms")} AS p, g.terms, g.lang_total
FROM mixed c JOIN mixed g ON c.term IS NOT NULL AND g.term IS NULL AND c.lang = g.lang AND c.source = g.source"""
_BOTH = f"""SELECT x.lang, x.source AS a, y.source AS b, sum({differs("x.p", "y.p")} - {differs("x.p", "y.p0")} - {differs("x.p0", "y.p")} + {differs("x.p0", "y.p0")}) AS value
FROM c x JOIN c y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY x.lang, x.source, y.source"""
_ONE = f"""SELECT o.lang, least(o.source, g.source) AS a, greatest(o.source, g.source) AS b, sum(o.k * ({differs("o.p", "g.p0")} - {differs("o.p0", "g.p0")})) AS value
FROM (SELECT lang, source, p, p0, count(*) AS k FROM c GROUP BY lang, source, p, p0) o JOIN mixed g ON g.term IS NULL AND g.lang = o.lang AND g.source <> o.source GROUP BY ALL"""
_PAIR = f"SELECT 'pair' AS kind, lang, a, b, NULL::VARCHAR AS term, CAST(sum(value) AS BIGINT) AS value FROM ({_BOTH} UNION ALL {_ONE}) GROUP BY lang, a, b"
_TERM = f"""SELECT 'term' AS kind, lang, source AS a, NULL::VARCHAR AS b, term, {differs("p", "q")} AS value
FROM (SELECT lang, source, term, p, {share("sum(n) OVER (PARTITION BY lang, term)", "lang_total", "terms")} AS q FROM c) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {differs("p", "q")} DESC, term) <= {{reported}}"""


def partial_sums(kept: DataFrame, groups: DataFrame, shards: int, reported: int = REPORTED) -> DataFrame:
    """Each shard's share of what pairs of sources differ by, and its foremost terms of each group.

    ``groups`` has lang, source, total, terms, p0 and lang_total; a shard's task gets all of them, as rows without a term.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder, _session(folder) as con:
            _rows(con, "mixed", batches)
            if not _is_empty(con):
                con.execute(_SHARES).fetchall()
                yield from _plain(con.sql(f"{_PAIR} UNION ALL ({_TERM.format(reported=reported)})").to_arrow_table()).to_batches()

    every = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "*")
    mixed = kept.drop("first").unionByName(every, allowMissingColumns=True)
    return mixed.repartitionById(shards, "shard").mapInArrow(add, PARTIAL)


def groups_of(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs with total (occurrences of kept terms), terms (kept in the
    language), p0 (the share of a term that it lacks) and lang_total."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    every = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    every = every.na.fill(0, ["total", "terms", "lang_total"])
    return every.withColumn("p0", F.when(F.col("terms") > 0, F.expr(f"1 + {2 * SCALE}L div (total + 2 * terms)")))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, reported: int = REPORTED, tables: Tables | None = None) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from each other source of
    its language, and the terms by which it exceeds the language most."""
    tables = tables or Tables(docs.sparkSession)
    rows = docs.select(empty_if_null(lang).alias("lang"), empty_if_null(source).alias("source"), empty_if_null(text).alias("text"))
    counts = tables.write(counted(rows), "counts")
    shards = max(1, -(-counts.count() // SHARD_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = tables.write(kept_terms(counts, shards, least), "kept-terms")
    tables.drop(counts)
    groups = tables.write(groups_of(rows.select("lang", "source"), kept), "groups")
    partial = tables.write(partial_sums(kept, groups, shards, reported), "partial-sums")
    tables.drop(kept)
    return ranked(partial, groups, reported)


def ranked(partial: DataFrame, groups: DataFrame, reported: int = REPORTED) -> DataFrame:
    """Sums of all shards, in both directions of each pair, and the foremost terms of all shards."""
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}_p0"), "terms")
    pairs = side("a").join(side("b").drop("terms"), "lang").filter("a < b")
    sums = partial.filter("kind = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("summed"))
    both_lack = F.expr("terms * ((a_p0 - b_p0) * (a_p0 - b_p0) div (a_p0 + b_p0))")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce(both_lack, F.lit(0)) + F.coalesce("summed", F.lit(0)))
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    pairs = pairs.select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = partial.filter("kind = 'term'").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # A shard has named ten terms of a group at most, and a source has as many pairs as there are other sources.
    ranks = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranks(pairs).unionByName(ranks(terms).filter(F.col("rank") <= reported))
