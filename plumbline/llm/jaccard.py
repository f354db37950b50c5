"""Exact n-gram Jaccard join with skipping by set relations (operator 8).

Documents are sets of word shingles.  Equal sets are one node, and a node's text stands once in a table
that is dealt by node, so that no later join moves texts that it does not need.  The join finds the
links between nodes in two rounds that lean on relations between sets:

1. Leaders.  Nodes that agree in half of eight min-hashes are grouped under leaders taken at random;
   members that the bitmaps below do not rule out are compared with their leader.  Where members stay
   unlinked, the member nearest to the leader takes over and all are compared with it: copies of one
   original are nearer to it than to each other, so this finds the original.  Groups of near
   copies, however large, become one component here with two comparisons per member.

2. Block-skipping index.  Every node lists its shingles in one global order (rising counts in
   the cells of a counting sketch over all documents) and indexes the first quarter, as prefix filtering
   asks.  Index lists are cut into blocks by set size and by position: two entries of a list can
   only belong to a link when i + j <= (1/t - 1) * min(|x| - i, |y| - j), so entries behind a
   seventh of their set never meet each other and those blocks are skipped.  Lists whose nodes are all
   of one component are skipped as a whole.  Entries of the lists that are left get a bitmap of their
   set, each bit the parity of the shingles that fall on it: bitmaps differ in no more bits than their
   sets do in shingles, so pairs whose bitmaps differ too much don't meet.  And they get the set's
   entries just before their own in such lists: where one of them is also just before the other entry, the pair
   has met in that list, and this later meeting is skipped.
   First leaders are compared with leaders.  Then the answers of the others are derived from a
   similar set's computed answers: with x = L - A + B and y = M - C + D for leaders L and M whose
   intersection was counted, |x & y| <= |L & M| + |B| + |D|; where that is too little for a link the pair is
   done, and members of components that have met are done too.  Only what is left is compared.

Links are exact: an ``intersection`` is counted over whole sets, and no cap or sample is used anywhere.
Long lists are salted: one side is dealt to parts, the other repeated for them.  Comparisons of a node
with very many partners are dealt to parts in the same way.

Defined cases: null and word-less texts are empty sets, linked with nothing (component: their own
id); texts with fewer words than a shingle are one shingle made of all; rows that repeat an id
with different texts are placed each by its own text; null ids stay null when linked with nothing
and take the component's smallest id otherwise; very long texts are read whole; an empty table gives
no rows; columns other than the two named may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import Tables, release, slices

SHINGLE = 5
THRESHOLD = Fraction(3, 4)
MIN_HASHES = 8
#: Min-hashes in which a node and a leader must agree.
AGREEMENT = 4
#: Cells of the counting sketch: 16 MB of counts per task, whatever the input.
CELL_BITS = 22
BLOCK = 1 << 12
#: 64-bit words of a set's parity bitmap.
LANES = 8
#: Earlier shingles of its set that an index entry carries.
BEFORE = 3
#: Parts to which the comparisons of one node are dealt, and entries of a list that meet in one part.
PARTS, LIST_PART = 128, 1000
#: Nodes that a task remembers in order not to send a text twice.
REMEMBERED = 1 << 20
#: Bytes of text that a task holds as sets at a time.
SLICE = 4_000_000
_SEEDS = W.mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# -- sets -----------------------------------------------------------------------------------
def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, one text after another, and bounds."""
    w = W.split(texts, lower=True)
    counts = np.diff(w.bounds)
    grams = W.grams(w.hashes, k)
    owner = w.text_of()
    whole = owner[: grams.size] == owner[k - 1 : k - 1 + grams.size] if grams.size else np.zeros(0, bool)
    values, own = grams[whole], owner[: grams.size][whole]
    few = np.nonzero((counts > 0) & (counts < k))[0]
    if few.size:
        short = W.run_hashes(w.hashes, w.bounds[few], w.bounds[few + 1])
        values, own = np.concatenate([values, short]), np.concatenate([own, few])
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    new = np.ones(values.size, bool)
    new[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    values, own = values[new], own[new]
    return values, np.searchsorted(own, np.arange(len(texts) + 1))


def _set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, 0 for the empty ones."""
    ids = W.run_hashes(W.mix(values), bounds[:-1], bounds[1:]).view(np.int64)
    return np.where(np.diff(bounds) > 0, np.where(ids == 0, 1, ids), 0)


def _min_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Smallest value of each set under each permutation; zeros for empty sets."""
    filled = np.nonzero(np.diff(bounds) > 0)[0]
    out = np.zeros((bounds.size - 1, MIN_HASHES), np.uint64)
    if filled.size:
        for i, seed in enumerate(_SEEDS):
            out[filled, i] = np.minimum.reduceat(W.mix(values ^ seed), bounds[filled])
    return out.view(np.int64)


def _bitmaps(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set the parities of its shingles' numbers on each of 64 * LANES bits."""
    filled = np.nonzero(np.diff(bounds) > 0)[0]
    out = np.zeros((bounds.size - 1, LANES), np.uint64)
    if filled.size:
        bit = np.uint64(1) << (values & np.uint64(63))
        lane = (values >> np.uint64(6)) % np.uint64(LANES)
        for i in range(LANES):
            out[filled, i] = np.bitwise_xor.reduceat(np.where(lane == i, bit, np.uint64(0)), bounds[filled])
    return out.view(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """A block of the sketch in as few bytes a cell as its counts need."""
    most = counts.max()
    return counts.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<i8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<{'i' if len(raw) == 8 * BLOCK else 'u'}{len(raw) // BLOCK}").astype(np.int64)


PROFILE = "doc_id bigint, node bigint, n_shingles bigint, text_hash bigint, first boolean, mins array<bigint>, bits array<bigint>, block int, counts binary"


def profiles(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """Every row as own_row with its number, node and set size; the first of each node in a task also has
    min-hashes and a bitmap.  Rows without a number hold the task's share of the counting sketch in blocks."""
    body = F.col(text).cast("string")
    rows = docs.select(F.struct("*").alias("own_row"), F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("text_hash"), F.monotonically_increasing_id().alias("row_no"), body.alias("text"))
    names = ["own_row", "row_no", *(x.split()[0] for x in PROFILE.split(", "))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known, own_type = np.zeros(1 << CELL_BITS, np.int32), set(), None
        for batch in slices(batches, "text", SLICE):
            own_type = batch.schema.field("own_row").type
            values, bounds = shingle_sets(batch.column("text").to_pylist(), k)
            np.add.at(cells, (values >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            ids, first = _set_ids(values, bounds), []
            if len(known) > REMEMBERED:
                known.clear()
            for i in ids.tolist():
                first.append(i != 0 and i not in known)
                known.add(i)
            n, skipped = batch.num_rows, ~np.array(first, bool)
            lists = [pa.array([None if no else r for r, no in zip(x.tolist(), skipped)], pa.list_(pa.int64())) for x in (_min_hashes(values, bounds), _bitmaps(values, bounds))]
            yield pa.RecordBatch.from_arrays([batch.column("own_row"), batch.column("row_no"), batch.column("doc_id"), pa.array(ids), pa.array(np.diff(bounds), pa.int64()), batch.column("text_hash"), pa.array(first), *lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        used = [b for b in range(cells.size // BLOCK) if cells[b * BLOCK : (b + 1) * BLOCK].any()]
        if used:
            m = len(used)
            blocks = pa.array([_packed(cells[b * BLOCK : (b + 1) * BLOCK]) for b in used], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, own_type), *[pa.nulls(m, pa.int64())] * 5, pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.list_(pa.int64()))] * 2, pa.array(used, pa.int32()), blocks], names)

    fields = [rows.schema["own_row"], rows.schema["row_no"], *T.StructType.fromDDL(PROFILE)]
    return rows.mapInArrow(find, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))


def frequency_classes(found: DataFrame) -> np.ndarray:
    """For each cell of the sketch its count on a log scale; 4 MB on the driver, whatever the input.
    Counts are over all documents and only order the shingles, rare cells first: any order is exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                own = _unpacked(raw)
                held[b] = held[b] + own if b in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array(map(_packed, held.values()), pa.binary())], ["block", "counts"])

    blocks = found.filter("block IS NOT NULL").select("block", "counts")
    # Tasks add up their own shares first, so that a block meets one row from each task.
    sums = blocks.mapInArrow(add, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for row in sums.collect():  # one row for each block: 1024
        cells[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = _unpacked(row["counts"])
    return np.minimum(10 * np.log2(1 + cells), 255).astype(np.uint8)


def nodes_of(found: DataFrame, text: str, tables: Tables) -> DataFrame:
    """node, text, n_shingles, mins and bits of every set that is not empty, dealt by node.

    Tasks have sent each of their nodes once, so copies of one text, however many, are as many
    rows as tasks at most; of those one stays.
    """
    own = found.filter("first").select("node", "n_shingles", F.col("own_row").getField(text).cast("string").alias("text"), "mins", "bits")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # of one partition
        for batch in batches:
            keep = []
            for i in batch.column("node").to_pylist():
                keep.append(i not in known)
                known.add(i)
            yield batch.filter(pa.array(keep, pa.bool_()))

    buckets = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.write_bucketed(own.repartition(buckets, "node").mapInArrow(once, own.schema), "nodes", "node")


# -- comparing ------------------------------------------------------------------------------
def compare(pairs: DataFrame, nodes: DataFrame, k: int = SHINGLE) -> DataFrame:
    """a, b with sizes and the exact intersection of their sets, for distinct pairs.

    Both texts travel to a pair.  A node's comparisons are dealt to parts, and its text is sent to
    each part once; it is repeated only while a task streams over the part.
    """
    part = lambda other: F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int")
    dealt = pairs.select("a", "b", part("b").alias("part_a"), part("a").alias("part_b"))

    def texts(side: str) -> DataFrame:
        ends = dealt.select(F.col(side).alias("node"), f"part_{side}").distinct()
        return nodes.select("node", "text").join(ends.hint("shuffle_hash"), "node").select(F.col("node").alias(side), f"part_{side}", F.col("text").alias(f"text_{side}"))

    both = dealt.join(texts("a"), ["a", "part_a"]).join(texts("b"), ["b", "part_b"]).select("a", "b", "text_a", "text_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}

        def sets(texts: list[str]) -> list[np.ndarray]:
            new = [t for t in dict.fromkeys(texts) if t not in kept]
            values, bounds = shingle_sets(new, k)
            fresh = {t: values[bounds[i] : bounds[i + 1]] for i, t in enumerate(new)}
            out = [fresh[t] if t in fresh else kept[t] for t in texts]
            kept.clear()
            kept.update(zip(texts[-1:], out[-1:]))  # a leader goes on into the next batch
            return out

        for batch in slices(batches, "text_a", SLICE, "text_b"):
            n = batch.num_rows
            found = sets(batch.column("text_a").to_pylist() + batch.column("text_b").to_pylist())
            out = np.zeros((n, 3), np.int64)
            for i, (sx, sy) in enumerate(zip(found[:n], found[n:])):
                at = np.searchsorted(sy, sx)
                at[at == sy.size] = 0
                out[i] = sx.size, sy.size, (sy[at] == sx).sum()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c) for c in out.T.copy())], ["a", "b", "size_a", "size_b", "shared"])

    return both.mapInArrow(count, "a bigint, b bigint, size_a bigint, size_b bigint, shared bigint")


def linked(threshold: Fraction = THRESHOLD) -> Column:
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return threshold.denominator * F.col("shared") >= threshold.numerator * union


def distance() -> Column:
    return 1.0 - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))


# -- components -----------------------------------------------------------------------------
def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node, root for every node of some edge: the smallest node that edges reach.

    Each round hangs roots that meet on an edge below the smaller one and then halves the paths, so
    rounds grow with the logarithm of a component's width.  Groups are minima, so a node with very
    many edges sends one row from each task.
    """
    ends = tables.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    state = tables.write(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "roots")
    while True:
        root = state.select(F.col("node").alias("at"), F.col("root").alias("above"))
        short = state.join(root, state["root"] == root["at"], "left").select("node", F.coalesce("above", "root").alias("root"))
        short = tables.write(short, "short")
        low = short.select(F.col("node").alias("b"), F.col("root").alias("low"))
        seen = ends.join(low, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        met = tables.write(short.join(seen, "node").select("node", "root", F.least("root", "low").alias("low")), "met")
        # The root itself moves below the smallest root that any of its nodes has met.
        hang = met.groupBy("root").agg(F.min("low").alias("down")).filter("down < root").select(F.col("root").alias("top"), "down")
        hang = tables.write(hang, "hang")
        after = met.join(hang, met["root"] == hang["top"], "left").select("node", F.least(F.col("low"), F.coalesce("down", "low")).alias("root"))
        after = tables.write(after, "roots")
        changed = after.withColumnRenamed("root", "new").join(state, "node").filter("new <> root").limit(1).count()
        tables.drop(state, short, met, hang)
        state = after
        if not changed:
            tables.drop(ends)
            return state


# -- index ----------------------------------------------------------------------------------
BITS = [f"bits_{i}" for i in range(LANES)]
EARLIER = [f"before_{i}" for i in range(1, BEFORE + 1)]
ENTRY = "token bigint, node bigint, size int, at int"


def index_entries(nodes: DataFrame, classes: np.ndarray, k: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The index prefix of every set: token, node, size and position, counted from 0."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            values, bounds = shingle_sets(batch.column("text").to_pylist(), k)
            size = np.diff(bounds)
            own = np.repeat(np.arange(size.size), size)
            order = np.lexsort((values, classes[(values >> np.uint64(64 - CELL_BITS)).astype(np.int64)], own))
            at = np.arange(values.size) - bounds[own]
            least = -(-size * threshold.numerator // threshold.denominator)
            in_prefix = at <= (size - least)[own]
            own, at, token = own[in_prefix], at[in_prefix], values[order[in_prefix]].view(np.int64)
            ids = np.asarray(batch.column("node"))
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids[own]), pa.array(size[own], pa.int32()), pa.array(at, pa.int32())], ["token", "node", "size", "at"])

    return nodes.select("node", "text").mapInArrow(find, ENTRY)


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries of the lists that hold two nodes or more.

    Lists come one after another in sorted partitions and are streamed; a task holds one batch and
    the list's first entry, never a list.
    """

    def only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last = (None, None)
        told = None
        for batch in batches:
            token = np.asarray(batch.column("token"))
            node = np.asarray(batch.column("node"))
            if not token.size:
                continue
            new = np.ones(token.size, bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            new[0] = (token[0], node[0]) != last
            last = (token[-1], node[-1])
            part = batch.filter(pa.array(new))
            if not part.num_rows:
                continue
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            t = np.asarray(part.column("token"))
            same = t[1:] == t[:-1]
            keep = np.zeros(t.size, bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= told is not None and t[0] == told
            # The last entry waits for what follows it, unless its list is known to be shared.
            held = None
            if keep[-1]:
                told = t[-1]
            else:
                held, told = part.slice(t.size - 1), None
            out = part.filter(pa.array(keep))
            if out.num_rows:
                yield out

    dealt = entries.repartition("token").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(only_shared, ENTRY)


def open_entries(entries: DataFrame, nodes: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Entries of the lists that several components have, with what tells pairs apart before they meet:
    the block of the set's size, the parts of a long list, the entries before and the bitmap.

    ``entries`` has token, node, size, at and component.
    """
    many = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    own = entries.join(many.select("token", F.ceil(F.col("n") / LIST_PART).cast("int").alias("parts")), "token")
    # A node's entries are a quarter of its own shingles at most.
    order = Window.partitionBy("node").orderBy("at")
    own = own.select("*", *(F.lag("token", i + 1).over(order).alias(c) for i, c in enumerate(EARLIER)), size_block(F.col("size"), threshold).alias("size_block"))
    return own.join(nodes.select("node", *(F.col("bits")[i].alias(b) for i, b in enumerate(BITS))), "node")


def size_block(size: Column, threshold: Fraction) -> Column:
    """Blocks of set sizes, in which sizes grow by two factors of 1/t."""
    return F.floor(F.log(size) / (2 * np.log(1 / float(threshold)))).cast("int")


def partner_blocks(threshold: Fraction) -> Column:
    """The blocks of the sizes that a partner of a front entry may have.

    Linked sets meet at the first shingle they share, so all that they share stands from there on:
    t / (1 + t) * (|x| + |y|) <= |x| - i; and |y| >= t * |x|.
    """
    t = float(threshold)
    least, most = t * F.col("size"), (1 + t) / t * (F.col("size") - F.col("at")) - F.col("size")
    low, high = size_block(least * (1 - 1e-9), threshold), size_block(most * (1 + 1e-9), threshold)
    return F.sequence(low, F.greatest(low, high))


def candidates(open_: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Pairs a < b of different components that meet in blocks of some list which positions allow."""
    t = float(threshold)
    sides = ("node", "size", "at", "component", *EARLIER, *BITS)
    # i + j <= (1/t - 1) * min(|x| - i, |y| - j), so one of a pair has (2/t - 1) * i <= (1/t - 1) * |x|.
    front = open_.filter((2 / t - 1) * F.col("at") <= (1 / t - 1) * F.col("size") + 1e-6)
    x = front.select("token", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(f"x_{c}") for c in sides), F.explode(partner_blocks(threshold)).alias("size_block"))
    y = open_.select("token", *(F.col(c).alias(f"y_{c}") for c in sides), "size_block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = x.join(y, ["token", "size_block", "part"])
    rest = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    possible = (F.col("x_component") != F.col("y_component")) & (F.col("x_at") + F.col("y_at") <= (1 / t - 1) * rest + 1e-6)
    possible = possible & (F.least("x_size", "y_size") >= t * F.greatest("x_size", "y_size") - 1e-6)
    possible = possible & (differing_bits("x_{}", "y_{}") <= most_differing("x_size", "y_size", threshold))
    # Linked sets meet at the first shingle they share, where nothing before it is shared.
    for i in EARLIER:
        for j in EARLIER:
            possible = possible & ~F.coalesce(F.col(f"x_{i}") == F.col(f"y_{j}"), F.lit(False))
    pair = met.filter(possible).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    return pair.distinct()


def differing_bits(x: str, y: str) -> Column:
    """The bits in which two bitmaps differ: no more than the shingles in which their sets do."""
    return sum((F.bit_count(F.col(x.format(b)).bitwiseXOR(F.col(y.format(b)))) for b in BITS), F.lit(0))


def most_differing(x_size: str, y_size: str, threshold: Fraction) -> Column:
    """|x Δ y| <= (1 - t) / (1 + t) * (|x| + |y|) for linked sets."""
    t = float(threshold)
    return (1 - t) / (1 + t) * (F.col(x_size) + F.col(y_size)) + 1e-6


def prefix_tokens(entries: DataFrame) -> DataFrame:
    """Of each node the shared entries of its prefix, as one list."""
    return entries.groupBy("node").agg(F.collect_set("token").alias("tokens"), F.first("size").alias("size"))


def possible_by_prefix(pairs: DataFrame, lists: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Pairs whose index prefixes share as much as those of linked sets must.

    Up to the smaller of both last prefix entries all that the sets share is in both prefixes, and at
    most |x| - o entries there are not shared, o being the least overlap of a link; only entries that
    several nodes have are looked at.
    """
    num, den = threshold.numerator, threshold.denominator
    one = lambda side: lists.select(F.col("node").alias(side), F.col("tokens").alias(f"{side}_tokens"), F.col("size").alias(f"{side}_size"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    overlap = F.ceil((F.col("a_size") + F.col("b_size")) * num / (num + den) - 1e-6)
    prefix = lambda s: F.col(s) - F.ceil(F.col(s) * num / den - 1e-6) + 1
    needed = F.least(*(prefix(s) - (F.col(s) - overlap) for s in ("a_size", "b_size")))
    return both.filter(F.size(F.array_intersect("a_tokens", "b_tokens")) >= needed).select("a", "b")


# -- the join -------------------------------------------------------------------------------
def leaders(nodes: DataFrame, tables: Tables, threshold: Fraction = THRESHOLD) -> DataFrame:
    """a, b: a node and the leader to which most of its min-hashes point, unless bitmaps rule out a link.

    Nodes that agree in two neighbouring min-hashes are a group, led by its smallest and its largest
    digest, which is to say by members taken at random.
    """
    slots = F.transform(F.sequence(F.lit(0), F.lit(MIN_HASHES - 1)), lambda i: F.xxhash64(i, F.get(F.col("mins"), i), F.get(F.col("mins"), F.pmod(i + 1, F.lit(MIN_HASHES)))))
    own = tables.write(nodes.select("node", F.explode(slots).alias("key")), "groupings")
    groups = own.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    met = own.join(groups, "key").select("node", F.explode(F.array("low", "high")).alias("lead")).filter("node <> lead").distinct()
    met = tables.write(met, "offers")
    tables.drop(own)
    names = ["mins", "n_shingles", *BITS]
    flat = nodes.select("node", "mins", "n_shingles", *(F.col("bits")[i].alias(b) for i, b in enumerate(BITS)))
    side = lambda name: flat.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in names))
    wide = met.join(side("node"), "node").join(side("lead"), "lead")
    agree = F.size(F.filter(F.arrays_zip(F.col("node_mins").alias("own"), F.col("lead_mins").alias("other")), lambda z: z["own"] == z["other"]))
    likely = (agree >= AGREEMENT) & (differing_bits("node_{}", "lead_{}") <= most_differing("node_n_shingles", "lead_n_shingles", threshold))
    best = wide.filter(likely).groupBy("node").agg(F.max(F.struct(agree.alias("agree"), F.col("lead").alias("lead"))).alias("offer"))
    out = tables.write(best.select(F.col("node").alias("a"), F.col("offer.lead").alias("b")), "proposals")
    tables.drop(met)
    return out


def hubs(led: DataFrame) -> DataFrame:
    """b, hub: for each leader b with unlinked members, the member that is nearest to it and linked."""
    near = F.min(F.when(F.col("link"), F.struct("distance", "a"))).alias("near")
    groups = led.groupBy("b").agg(near, F.count_if(~F.col("link")).alias("unlinked"))
    return groups.filter("unlinked > 0 AND near IS NOT NULL").select("b", F.col("near.a").alias("hub"))


def _with_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    own = roots.select(F.col("node").alias("known"), "root")
    return rows.join(own, rows["node"] == own["known"], "left").select(*rows.columns, F.coalesce("root", "node").alias("component"))


ANSWER = ["a", "b", "size_a", "size_b", "shared", "distance", "link"]


def _led(nodes: DataFrame, tables: Tables, k: int, threshold: Fraction) -> DataFrame:
    """The answers of all nodes about their leaders: a, b and what was counted; a hub leads where it took over."""
    told = lambda pairs: compare(pairs, nodes, k).withColumn("distance", distance()).withColumn("link", linked(threshold))
    proposals = leaders(nodes, tables, threshold)
    first = tables.write(told(proposals), "led")
    over = tables.write(first.join(hubs(first), "b", "left"), "taken-over")
    asked = tables.write(over.filter("a <> hub").select("a", F.col("hub").alias("b")).distinct(), "proposals")
    again = told(asked)
    # A leader becomes a member of the hub that takes over.
    is_hub = F.coalesce(F.col("a") == F.col("hub"), F.lit(False))
    swap = lambda x, y: F.when(is_hub, F.col(y)).otherwise(F.col(x)).alias(x)
    turned = over.select(swap("a", "b"), swap("b", "a"), swap("size_a", "size_b"), swap("size_b", "size_a"), "shared", "distance", "link")
    out = tables.write(turned.unionByName(again.select(ANSWER)), "led")
    tables.drop(proposals, first, over, asked)
    return out


def connect(found: DataFrame, text: str, tables: Tables, k: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """node, root for the nodes that have links, from the rows' profiles."""
    spark = found.sparkSession
    classes = frequency_classes(found)
    nodes = nodes_of(found, text, tables)
    release(spark)
    led = _led(nodes, tables, k, threshold)
    links = tables.write(led.filter("link").select("a", "b"), "links")
    roots = components(links, tables)
    # Members hang below the nearest leader they are linked with; all others stand for themselves.
    nearest = led.filter("link").groupBy("a").agg(F.min(F.struct("distance", "b", (F.col("size_a") - F.col("shared")).alias("own"))).alias("lead"))
    member = tables.write(nearest.select(F.col("a").alias("member"), F.col("lead.b").alias("leader"), F.col("lead.own").alias("own")), "members")
    tables.drop(led)
    release(spark)

    lists = tables.write(shared_entries(index_entries(nodes, classes, k, threshold)), "index")
    release(spark)
    prefixes = tables.write(prefix_tokens(lists), "prefixes")
    top = tables.write(open_entries(_with_component(lists.join(member.select("member"), F.col("node") == F.col("member"), "left_anti"), roots), nodes, threshold), "leader-lists")
    met = tables.write(candidates(top, threshold), "met")
    pairs = tables.write(possible_by_prefix(met, prefixes, threshold), "pairs")
    tables.drop(top, met)
    answers = tables.write(compare(pairs, nodes, k).withColumn("link", linked(threshold)), "answers")
    tables.drop(pairs)
    release(spark)
    more = tables.write(links.unionByName(answers.filter("link").select("a", "b")), "links")
    tables.drop(links, roots)
    links, roots = more, components(more, tables)

    rest = tables.write(open_entries(_with_component(lists, roots), nodes, threshold), "open-lists")
    tables.drop(lists)
    met = tables.write(candidates(rest, threshold).join(answers.select("a", "b"), ["a", "b"], "left_anti"), "met")
    tables.drop(rest)
    pairs = possible_by_prefix(_not_derived(met, member, answers, prefixes, threshold), prefixes, threshold)
    pairs = tables.write(pairs, "pairs")
    tables.drop(met, prefixes, member, answers)
    more = tables.write(compare(pairs, nodes, k).filter(linked(threshold)).select("a", "b"), "links")
    tables.drop(pairs, nodes)
    if more.take(1):
        every = tables.write(links.unionByName(more), "links")
        tables.drop(roots)
        roots = components(every, tables)
        tables.drop(every)
    tables.drop(more, links)
    release(spark)
    return roots


def _not_derived(pairs: DataFrame, member: DataFrame, answers: DataFrame, sizes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs that the answer of their leaders does not already rule out: of what a and b share, all but
    the shingles that they have and their leaders don't is shared by the leaders too."""
    num, den = threshold.numerator, threshold.denominator
    lead = lambda side: member.select(F.col("member").alias(f"{side}_member"), F.col("leader").alias(f"{side}_leader"), F.col("own").alias(f"{side}_own"))
    wide = pairs.join(lead("a"), F.col("a") == F.col("a_member"), "left").join(lead("b"), F.col("b") == F.col("b_member"), "left")
    wide = wide.select("a", "b", F.coalesce("a_leader", "a").alias("la"), F.coalesce("b_leader", "b").alias("lb"), (F.coalesce("a_own", F.lit(0)) + F.coalesce("b_own", F.lit(0))).alias("own"))
    wide = wide.select("a", "b", F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high"), "own")
    told = answers.select(F.col("a").alias("low"), F.col("b").alias("high"), "shared")
    size = lambda side: sizes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"))
    out = wide.join(told, ["low", "high"], "left").join(size("a"), "a").join(size("b"), "b")
    most = F.col("shared") + F.col("own")
    ruled_out = F.coalesce((num + den) * most < num * (F.col("a_size") + F.col("b_size")), F.lit(False))
    return out.filter(~ruled_out).select("a", "b")


def _placed(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows' numbers, ids, set sizes, nodes and components."""
    own = found.filter("row_no IS NOT NULL").select("row_no", "doc_id", "n_shingles", "node", "text_hash")
    return _with_component(own, roots)


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: Fraction = THRESHOLD, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and node (the set's digest) of every row."""
    tables = tables or Tables(docs.sparkSession)
    found = tables.write(profiles(docs.select(key, text), key, text, k), "profiles")
    roots = connect(found, text, tables, k, threshold)
    placed = tables.write(_placed(found, roots), "placed")
    tables.drop(found, roots)
    ids = placed.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    apart = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return placed.join(ids, "component", "left").select("doc_id", "n_shingles", apart.alias("component_id"), "node")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """One row of each group of linked documents, with its own columns: that of the smallest id, null
    ids last; of rows that repeat this id one stays.  Documents without words are groups of their own."""
    tables = tables or Tables(docs.sparkSession)
    found = tables.write(profiles(docs, key, text), "profiles")
    roots = connect(found, text, tables)
    placed = tables.write(_placed(found, roots), "placed")
    tables.drop(roots)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "row_no")
    filled = placed.filter("n_shingles > 0")
    first = filled.groupBy("component").agg(F.min(order).alias("first")).select("first.row_no")
    # Those that go are fewer than those that stay; while they are few, whole rows need not be moved.
    gone = tables.write(filled.select("row_no").join(first, "row_no", "left_anti"), "gone")
    tables.drop(placed)
    return found.filter("row_no IS NOT NULL").join(gone, "row_no", "left_anti").select("own_row.*")
