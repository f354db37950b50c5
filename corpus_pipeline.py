"""From raw documents to packed token sequences: filters, deduplication, redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Between stages
rows are written as Parquet in the cluster's shared folder and read again, so a lost executor costs
one stage's tasks at most.  A stage begins by deleting what its predecessor wrote for itself, which
nothing reads any more once that stage's rows are written; what the last stage reads stays, as its
rows may be read at any time.

Defined cases, stage by stage as its operator defines them: null, empty and word-less texts fail the quality
rules and go; of equal texts the largest id stays, null ids being the smallest; of near copies the smallest
id, null ids last; ties leave one row; texts of any length are read whole; an empty table packs into no
rows; extra columns are kept up to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, jaccard, packing, pii, quality
from plumbline.llm.common import Tables


#: What the latest call of each stage has written for itself, by session and stage.
_HELD: dict[tuple[str, str], Tables] = {}


def _tables(spark: SparkSession, docs: DataFrame, stage: str, before: str) -> Tables:
    """Tables of a stage that begins; those of the stage before it go, but for what its input reads."""
    session = spark.sparkContext.applicationId
    if (session, before) in _HELD:
        _HELD.pop((session, before)).close(docs)
    _HELD[session, stage] = Tables(spark)
    return _HELD[session, stage]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_rows(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.kept_rows(docs, tables=_tables(spark, docs, "exact", ""))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard.kept_rows(docs, tables=_tables(spark, docs, "near", "exact"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is replaced by its kind."""
    return pii.redacted(docs, length="n_chars" if "n_chars" in docs.columns else None, tables=_tables(spark, docs, "personal", "near"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of 4096 tokens."""
    return packing.pack(docs, tables=_tables(spark, docs, "packed", "personal")).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("packing", packed),
]

#: SQL can't encode text into tokens; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
