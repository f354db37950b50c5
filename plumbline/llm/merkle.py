"""Merkle manifest of a dataset, with a proof for every row (operator 11).

Each row is a leaf; the leaves of a group (source) make a tree of runs of three, and the roots of the
groups, in the order of the groups, make a tree of the same kind.  Both are built by levels: a window
over (group, parent) collects the run of each node in order, which is the preimage of the parent and
holds the node's siblings; of each run the first node goes on as the parent.  Every level is a third
of the one below and is written once.

Proofs go the other way, from the top down: a run hands the siblings above it to its nodes, so a level
is joined with a third as many rows above it, and no leaf is ever joined level by level.  Digests are
moved as 32 bytes and turned to text where they are hashed.

Places in a group are prefix sums over ranges of (group, id), so a group that holds a third of all
rows is spread over tasks; all later steps deal by (group, parent), that is by runs of three.

Defined cases: a null field counts as ``-``; a null group comes before all others; null ids come
first in their group and are not tampered with; rows that repeat an id are ordered by their leaves (equal
rows have equal leaves); a lone leaf is its group's root, and a lone group's root is the root; texts of
any length are hashed whole; an empty table gives no rows; columns beside the five may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, prefix_sums

#: Nodes of a run.
FAN = 3
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in fields)).cast("binary"), 256))


def hexed(digests: Column) -> Column:
    """Lowercase hex of one digest or of several in a row."""
    return F.lower(F.hex(digests))


def digest_of(digests: Column) -> Column:
    """The digest of digests as hex text."""
    return F.unhex(F.sha2(hexed(digests).cast("binary"), 256))


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the groups do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _joined(run: Column, wanted: Callable[[Column], Column]) -> Column:
    """The digests of a run at the places wanted, one after another."""
    none = F.lit(b"")
    return F.concat(*(F.when(wanted(F.lit(i)), F.coalesce(F.get(run, F.lit(i)), none)).otherwise(none) for i in range(FAN)))


@dataclass
class Tree:
    """Levels of the trees of all groups: grp, idx, n (nodes of the group at the level), digest and run;
    ``tops`` has grp, digest and height of each group's root."""

    levels: list[DataFrame]
    tops: DataFrame


def _parents(level: DataFrame) -> DataFrame:
    """One row for each run: its first node goes on as the parent."""
    first = level.filter(F.col("idx") % FAN == 0)
    return first.select("grp", F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), digest_of(_joined(F.col("run"), lambda i: i >= 0)).alias("digest"))


def build(nodes: DataFrame, tables: Tables) -> Tree:
    """The trees of all groups over (grp, idx, n, digest) and whatever other columns the leaves have."""
    widest = nodes.agg(F.max("n")).first()[0] or 0
    top = lambda df, height: df.filter("n = 1").select("grp", "digest", F.lit(height).alias("height"))
    levels, tops, above = [], top(nodes, 0), nodes
    while widest > 1:
        runs = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        active = above.filter("n > 1").withColumn("parent", F.floor(F.col("idx") / FAN))
        levels.append(tables.write(active.withColumn("run", F.collect_list("digest").over(runs)), "level"))
        above, widest = _parents(levels[-1]), -(-widest // FAN)
        tops = tops.unionByName(top(above, len(levels)))
    return Tree(levels, tables.write(tops, "tops"))


PATH = "array<struct<before:binary,after:binary>>"


def paths(tree: Tree, leaves: DataFrame, above: DataFrame, carried: list[str], tables: Tables) -> DataFrame:
    """The leaves with their path: siblings before and after each node from the leaf to the root.

    ``above`` has grp, height, the path from the group's root on, and the columns ``carried``.
    """
    up = lambda df, idx: df.select(F.col("grp").alias("up"), idx.alias("up_idx"), F.col("path").alias("path_above"), *carried)
    place, known = F.col("idx") % FAN, None
    own = F.struct(_joined(F.col("run"), lambda i: i < place).alias("before"), _joined(F.col("run"), lambda i: i > place).alias("after"))
    for height in range(len(tree.levels), 0, -1):
        level = tree.levels[height - 1]
        # The last run of a group hangs below its root, all other runs below a node of the level above.
        over = up(above.filter(F.col("height") == height), F.lit(0).cast("bigint"))
        over = over if known is None else over.unionByName(up(known, F.col("idx")))
        met = level.withColumn("own", own).join(over, (F.col("grp") == F.col("up")) & (F.col("parent") == F.col("up_idx")))
        met = met.withColumn("path", F.concat(F.array("own"), "path_above")).drop("own", "run", "path_above", "parent", "up", "up_idx")
        if height > 1:
            met = tables.write(met.select("grp", "idx", "path", *carried), "paths")
            tables.drop(known, level)
        known = met
    lone = leaves.filter("n = 1").join(up(above.filter("height = 0"), F.lit(0)), F.col("grp") == F.col("up")).drop("up", "up_idx").withColumnRenamed("path_above", "path")
    return lone if known is None else known.unionByName(lone)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, start, lambda at, step: digest_of(F.concat(step["before"], at, step["after"])))


def proofs(docs: DataFrame, tables: Tables, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", changed: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """Every row's key, leaf, subroot, root and path; ``checked`` is the leaf of the row with
    ``changes`` made where ``changed`` holds, else the leaf itself."""
    own = {c: F.col(c) for c in fields}
    plain = leaf([own[c] for c in fields])
    other = plain if changed is None else F.when(F.coalesce(changed, F.lit(False)), leaf([(changes or {}).get(c, own[c]) for c in fields])).otherwise(plain)
    rows = docs.select(group_key(F.col(group)).alias("grp"), F.col(key).cast("bigint").alias("key"), plain.alias("digest"), other.alias("checked"), F.lit(1).cast("bigint").alias("one"))
    steps = Tables(docs.sparkSession)
    placed = prefix_sums(rows, ["grp", "key", "digest"], "one", "idx", within="grp", total="n", tables=steps)
    leaves = tables.write(placed.drop("one"), "leaves")
    steps.close()
    trees = build(leaves, tables)
    numbered = prefix_sums(trees.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("height").alias("own_height"), F.lit(1).cast("bigint").alias("one")), ["grp", "name"], "one", "idx", within="grp", total="n", tables=steps)
    groups = steps.write(numbered.drop("one"), "groups")
    crown = build(groups, steps)
    top = crown.tops.select("digest").first()
    root = F.lit(bytes(top[0]) if top else None).cast("binary")
    start = crown.tops.select("grp", "height", F.array().cast(PATH).alias("path"))
    above = paths(crown, groups, start, [], steps).select(F.col("name").alias("grp"), F.col("own_height").alias("height"), "path", F.col("digest").alias("subroot"))
    above = tables.write(above, "above")
    steps.close()
    tables.drop(trees.tops)
    found = paths(trees, leaves, above, ["subroot"], tables)
    return found.select("key", F.col("digest").alias("leaf"), "checked", "subroot", root.alias("root"), "path")


def manifest(docs: DataFrame, tables: Tables | None = None, group: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: leaf, subroot, root, digest of its proof, and whether the proof
    holds for the row as an audit finds it: line ends taken out of the texts of half of the keys."""
    tables = tables or Tables(docs.sparkSession)
    fields = tuple({"source": group, "doc_id": key, "text": text}.get(c, c) for c in FIELDS)
    half = F.crc32(F.col(key).cast("bigint").cast("string").cast("binary")) % 2 == 0
    found = proofs(docs, tables, fields, group, key, half, {text: F.translate(F.col(text), "\n", "")})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "")
    fold = folded(F.col("checked"), F.col("path"))
    out = found.select(F.col("key").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), hexed(fold).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
