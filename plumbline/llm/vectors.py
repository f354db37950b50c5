"""Near-duplicate embeddings by randomised-rotation binary codes (operator 12).

A unit vector x is turned by a random rotation P; its code is the signs of Px, that is the corner c of a
cube nearest to it, and the stored correction factor is <c, Px>.  For any unit vector y, rotated alike and
rounded at random to four bits a dimension, <c, Py> / <c, Px> is an unbiased estimate of <x, y>; what it errs by
is sqrt(1 - <x, y>^2) times a sum of many small terms that the factor scales, so a confidence bound
is known for each pair from the two stored rows.  Estimates are counts of common bits.

1. Index.  Further rotations give each vector many short runs of signs.  Vectors at the limit of a link
   agree in a run with known probability; so many runs are drawn that all but ``MISS`` of such pairs
   meet in one at least, whatever the data, and closer pairs more surely.  Runs grow with the logarithm of the rows.
2. Balls.  Of those it meets in some runs, a vector joins the one with the smallest number within half
   the angle of a link, checked exactly.  Members of a ball are all linked with each other without being
   compared, however many they are: a third of all rows around one point is one ball.
3. Pairs of balls that meet in a run are estimated from the codes of their centres; where the upper
   confidence bound is below the cosine that a link would need, the pair is dismissed.  All others are
   computed again from the vectors in double precision.  By the centres' angle and the balls' radii
   all members of two balls are linked, or none, or they are compared in blocks of bounded size.

So links are counted without listing pairs, none below the threshold is ever counted, and long runs are dealt
to parts.  Components are those of balls.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components are linked with nothing;
vectors of different lengths are not linked with each other; equal vectors are linked; rows that repeat an id
are vectors of their own; null ids stay null when linked with nothing and take the component's smallest
id otherwise (null where all are null); ``kept`` is null-safe equality; an empty table gives no rows; columns
beside the two named may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import Tables
from .jaccard import components

THRESHOLD = 0.9
#: Share of the pairs just at the threshold that may meet in no run.
MISS = 1e-4
#: Bits to which a rotated vector is rounded, and standard deviations of the confidence bound.
LEVELS, SURE = 4, 6.0
#: Bits that a code has at least: short vectors are rotated several times.
CODE_BITS = 64
#: Runs by which vectors look for a ball, entries of a run in a part, members of a ball in a block.
OFFERS, RUN_PART, BLOCK = 8, 1000, 512
#: What rounding can move an angle by.
MARGIN = 1e-7
SEED = 20_231


# -- rotations ------------------------------------------------------------------------------
@lru_cache(maxsize=4)
def rotations(dim: int, count: int, stream: int) -> np.ndarray:
    """Random rotations one below the other: (count * dim, dim), the same in every task."""
    draw = np.random.default_rng([SEED, stream, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(draw.standard_normal((dim, dim)))
        out.append((q * np.where(np.diag(r) < 0, -1.0, 1.0)).T)
    return np.concatenate(out)


def run_plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Signs in a run, and runs, for so many rows: random pairs seldom meet, those at the threshold do."""
    agree = 1 - math.acos(threshold) / math.pi
    signs = max(6, math.ceil(math.log2(max(rows, 2))) - 2)
    return signs, math.ceil(math.log(miss) / math.log1p(-(agree**signs)))


def code_rotations(dim: int) -> int:
    """Rotations that give a code of enough bits."""
    return max(1, -(-CODE_BITS // dim))


def _words(bits: np.ndarray, lanes: int) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    wide = np.zeros((bits.shape[0], lanes * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<i8")


def codes(unit: np.ndarray, lanes: int) -> dict[str, np.ndarray]:
    """Codes of unit vectors of one length and what estimates need, by column."""
    n, dim = unit.shape
    times = code_rotations(dim)
    width = times * dim
    turned = unit @ rotations(dim, times, 0).T / math.sqrt(times)
    bits = turned >= 0
    out = {f"code_{i}": c for i, c in enumerate(_words(bits, lanes).T)}
    out["factor"] = np.abs(turned).sum(1) / math.sqrt(width)
    # The part of a code that is beside its vector points anywhere among dim - 1 directions, once for each rotation.
    out["spread"] = np.sqrt(np.maximum(1 / out["factor"] ** 2 - 1, 0) / max(times * (dim - 1), 1))
    low, top = turned.min(1), (1 << LEVELS) - 1
    step = np.maximum((turned.max(1) - low) / top, 1e-12)
    dither = np.random.default_rng([SEED, 1, dim]).random(width)
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, top).astype(np.uint8)
    for j in range(LEVELS):
        out |= {f"plane_{j}_{i}": c for i, c in enumerate(_words(level >> j & 1, lanes).T)}
    out |= {"low": low, "step": step, "total": step * level.sum(1) + low * width, "root": np.full(n, math.sqrt(width))}
    return out


def runs(unit: np.ndarray, signs: int, count: int) -> np.ndarray:
    """(vectors, runs) of 64-bit numbers; those of different lengths or runs never agree."""
    n, dim = unit.shape
    times = -(-signs * count // dim)
    bits = (unit @ rotations(dim, times, 1).T >= 0)[:, : signs * count].reshape(n, count, signs)
    value = np.zeros((n, count), np.uint64)
    for s in range(signs):
        value = value << np.uint64(1) | bits[:, :, s].astype(np.uint64)
    return W.mix(value ^ W.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))).view(np.int64)


# -- vectors --------------------------------------------------------------------------------
VALID = "node bigint, dim int, vector binary"


def vectors(rows: DataFrame) -> DataFrame:
    """node, dim and unit vector (doubles) of each row that can be linked; dim 0 for all others.
    Nodes are the rows' numbers, mixed, so that the smallest of some is one taken at random."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = W.mix(np.asarray(batch.column("row_no")).astype(np.uint64) + np.uint64(1)).view(np.int64)
            dims, raw = [], []
            for v in batch.column("value"):
                x = np.array([np.nan if e is None else e for e in v.as_py()] if v.is_valid else [], np.float64)
                top = np.abs(x).max(initial=0.0)
                ok = x.size and np.isfinite(x).all() and top > 0
                # Scaled first, so that squares neither vanish nor overflow.
                dims.append(x.size if ok else 0)
                raw.append((u := x / top, (u / np.sqrt((u * u).sum())).tobytes())[1] if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "node", "dim", "vector"])

    return rows.mapInArrow(find, "id bigint, " + VALID)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of a batch's rows, one length after another."""
    dims = np.asarray(batch.column("dim"))
    raw = batch.column("vector")
    for dim in np.unique(dims[dims > 0]).tolist():
        at = np.nonzero(dims == dim)[0]
        yield at, np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), np.float64).reshape(at.size, dim)


def with_runs(valid: DataFrame, signs: int, count: int) -> DataFrame:
    """node, run (its number as an item of the index), one row for each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _by_length(batch):
                found = runs(unit, signs, count)
                node = np.asarray(batch.column("node"))[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, count)), pa.array(found.ravel())], ["node", "run"])

    return valid.mapInArrow(find, "node bigint, run bigint")


def code_columns(lanes: int) -> tuple[list[str], list[str]]:
    """Columns of a pair's second side (codes) and first side (rounded vectors)."""
    planes = [f"plane_{j}_{i}" for j in range(LEVELS) for i in range(lanes)]
    return [*(f"code_{i}" for i in range(lanes)), "factor", "spread"], [*planes, "low", "step", "total", "root"]


def with_codes(valid: DataFrame, lanes: int) -> DataFrame:
    """node and all columns of its code."""
    code, rounded = code_columns(lanes)
    names = code + rounded
    kinds = {c: pa.int64() if c.startswith(("code_", "plane_")) else pa.float64() for c in names}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _by_length(batch):
                own = codes(unit, lanes)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("node"))[at]), *(pa.array(np.ascontiguousarray(own[c]), kinds[c]) for c in names)], ["node", *names])

    return valid.mapInArrow(find, "node bigint, " + ", ".join(f"{c} {'bigint' if kinds[c] == pa.int64() else 'double'}" for c in names))


# -- estimates ------------------------------------------------------------------------------
def estimate(lanes: int) -> Column:
    """The unbiased estimate of <x, y> from x's rounded vector and y's code."""
    common = sum(((1 << j) * F.bit_count(F.col(f"y_code_{i}").bitwiseAND(F.col(f"x_plane_{j}_{i}"))) for j in range(LEVELS) for i in range(lanes)), F.lit(0))
    ones = sum((F.bit_count(f"y_code_{i}") for i in range(lanes)), F.lit(0))
    return (2 * (F.col("x_step") * common + F.col("x_low") * ones) - F.col("x_total")) / F.col("x_root") / F.col("y_factor")


def may_reach(cosine: Column, lanes: int) -> Column:
    """Whether the upper confidence bound of the estimate lets a pair reach a cosine."""
    beside = 1 - cosine * cosine
    rounding = F.col("x_step") / 2 / F.col("y_factor")
    error = F.sqrt(F.greatest(beside, F.lit(0.0)) * F.col("y_spread") * F.col("y_spread") + rounding * rounding)
    return estimate(lanes) >= cosine - SURE * error


def _named(df: DataFrame, side: str, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(f"{side}_{c}") for c in columns))


def cosines(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Pairs a, b (and what else they have) with their cosine from the vectors in double precision."""
    side = lambda s: valid.select(F.col("node").alias(s), F.col("vector").alias(f"vector_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    keep = pairs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("vector_a").to_pylist(), batch.column("vector_b").to_pylist()):
                x, y = np.frombuffer(a, np.float64), np.frombuffer(b, np.float64)
                out.append(float(x @ y) if x.size == y.size else -1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "cosine"])

    return both.mapInArrow(find, T.StructType([*pairs.schema.fields]).add("cosine", "double"))


# -- balls ----------------------------------------------------------------------------------
def balls(valid: DataFrame, coded: DataFrame, indexed: DataFrame, lanes: int, threshold: float, tables: Tables) -> DataFrame:
    """node, ball (its centre) and the cosine to the centre: half the angle of a link at most."""
    tight = math.cos(math.acos(threshold) / 2 - MARGIN)
    code, rounded = code_columns(lanes)
    least = indexed.groupBy("run").agg(F.min("node").alias("lead"), F.max("node").alias("most")).filter("lead < most").select("run", "lead")
    offers = tables.write(indexed.join(least, "run").filter("node <> lead").select("node", "lead").distinct(), "offers")
    x = _named(coded, "x", rounded, ("node",))
    y = _named(coded.withColumnRenamed("node", "lead"), "y", code, ("lead",))
    likely = offers.join(x, "node").join(y, "lead").filter(may_reach(F.lit(tight), lanes)).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    near = cosines(likely, valid).filter(F.col("cosine") >= tight)
    best = near.groupBy("a").agg(F.min(F.struct("b", "cosine")).alias("best")).filter(F.col("best.b") < F.col("a"))
    best = best.select(F.col("a").alias("joined"), F.col("best.b").alias("centre"), F.col("best.cosine").alias("near"))
    own = valid.select("node")
    out = own.join(best, own["node"] == best["joined"], "left").select("node", F.coalesce("centre", "node").alias("ball"), F.coalesce("near", F.lit(1.0)).alias("near"))
    out = tables.write(out, "balls")
    tables.drop(offers)
    return out


def sizes(ball_of: DataFrame) -> DataFrame:
    """ball, members, radius; a ball that is just its centre has radius 0."""
    alone = F.min(F.when(F.col("node") == F.col("ball"), 1).otherwise(0))
    out = ball_of.groupBy("ball").agg(F.count("*").alias("members"), F.min("near").alias("near"), alone.alias("alone"))
    return out.select("ball", "members", F.when(F.col("alone") == 1, 0.0).otherwise(F.acos(F.least(F.col("near"), F.lit(1.0)))).alias("radius"))


def meetings(entries: DataFrame, lanes: int, threshold: float) -> DataFrame:
    """Pairs a < b of balls that meet in a run and whose estimate does not rule out a link of members.

    ``entries`` has run, ball, radius and all columns of the centre's code.
    """
    many = entries.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run", F.ceil(F.col("n") / RUN_PART).cast("int").alias("parts"))
    code, rounded = code_columns(lanes)
    x = entries.join(many, "run").select("run", F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int").alias("part"), F.col("ball").alias("a"), F.col("radius").alias("x_radius"), *(F.col(c).alias(f"x_{c}") for c in rounded))
    y = entries.join(many, "run").select("run", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("ball").alias("b"), F.col("radius").alias("y_radius"), *(F.col(c).alias(f"y_{c}") for c in code))
    needed = F.cos(F.least(F.lit(math.acos(threshold)) + F.col("x_radius") + F.col("y_radius"), F.lit(math.pi)))
    met = x.join(y, ["run", "part"]).filter((F.col("a") < F.col("b")) & may_reach(needed, lanes))
    return met.select("a", "b").distinct()


def members_compared(open_: DataFrame, ball_of: DataFrame, size: DataFrame, valid: DataFrame, threshold: float) -> DataFrame:
    """a, b, node, links: the links that members of two balls have with members of the other one.

    Members of each ball are dealt to blocks, and each pair of blocks is multiplied once in a task; what
    leaves it is one count for each member that has links.
    """
    blocks = lambda name: size.select(F.col("ball").alias(name), F.ceil(F.col("members") / BLOCK).cast("int").alias(f"blocks_{name}"))
    met = open_.join(blocks("a"), "a").join(blocks("b"), "b")
    met = met.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("block_a"), "blocks_a", "blocks_b")
    met = met.select("a", "b", "block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("block_b"))
    dealt = ball_of.join(size.select("ball", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "ball")
    dealt = dealt.select("ball", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).join(valid.select("node", "vector"), "node")
    key = ["a", "b", "block_a", "block_b"]
    side = lambda s: met.join(dealt.select(F.col("ball").alias(s), F.col("block").alias(f"block_{s}"), "node", "vector"), [s, f"block_{s}"]).select(*key, F.lit(s == "a").alias("is_a"), "node", "vector")

    def count(key: tuple, both: pa.Table) -> pa.Table:
        left, right = both.filter(both.column("is_a")), both.filter(pc.invert(both.column("is_a")))
        x, y = (np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in (left, right))
        linked = x @ y.T >= threshold if x.size and y.size and x.shape[1] == y.shape[1] else np.zeros((x.shape[0], y.shape[0]), bool)
        n = np.concatenate([linked.sum(1), linked.sum(0)]).astype(np.int64)
        node = np.concatenate([np.asarray(t.column("node").combine_chunks(), np.int64) for t in (left, right)])
        own = n > 0
        return pa.table({"a": pa.array([key[0].as_py()] * int(own.sum()), pa.int64()), "b": pa.array([key[1].as_py()] * int(own.sum()), pa.int64()), "node": pa.array(node[own]), "links": pa.array(n[own])})

    return side("a").unionByName(side("b")).groupBy(*key).applyInArrow(count, "a bigint, b bigint, node bigint, links bigint")


# -- the join -------------------------------------------------------------------------------
def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, tables: Tables | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept and ball of every row."""
    tables = tables or Tables(rows.sparkSession)
    numbered = rows.select(F.col(key).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row_no"), F.col(vector).cast("array<double>").alias("value"))
    every = tables.write(vectors(numbered), "vectors")
    width = F.ceil(F.ceil(CODE_BITS / F.col("dim")) * F.col("dim") / 64)
    count, lanes = every.filter("dim > 0").agg(F.count("*"), F.max(width)).first()
    valid = every.filter("dim > 0")
    signs, number = run_plan(count, threshold, miss)
    lanes = int(lanes or 1)
    coded = tables.write(with_codes(valid, lanes), "codes")
    ball_of = balls(valid, coded, with_runs(valid, signs, min(OFFERS, number)), lanes, threshold, tables)
    size = tables.write(sizes(ball_of), "sizes")

    # A ball is in the runs of all its members: members that would meet make their balls meet.
    places = with_runs(valid, signs, number).join(ball_of.select("node", "ball"), "node").select("run", "ball").distinct()
    entries = tables.write(places.join(coded.withColumnRenamed("node", "ball"), "ball").join(size.select("ball", "radius"), "ball"), "entries")
    pairs = tables.write(cosines(meetings(entries, lanes, threshold), valid), "pairs")
    tables.drop(entries, coded)

    own = lambda s: size.select(F.col("ball").alias(s), F.col("members").alias(f"members_{s}"), F.col("radius").alias(f"radius_{s}"))
    wide = pairs.join(own("a"), "a").join(own("b"), "b")
    reach, angle, limit = F.col("radius_a") + F.col("radius_b"), F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0))), math.acos(threshold)
    between = F.when(reach == 0, F.when(F.col("cosine") >= threshold, "all").otherwise("none")).when(angle + reach <= limit - MARGIN, "all").when(angle - reach > limit + MARGIN, "none").otherwise("open")
    judged = tables.write(wide.withColumn("between", between).filter("between <> 'none'").select("a", "b", "members_a", "members_b", "between"), "judged")
    tables.drop(pairs)
    some = tables.write(members_compared(judged.filter("between = 'open'").select("a", "b"), ball_of, size, valid, threshold), "some")
    whole = judged.filter("between = 'all'")
    roots = components(whole.select("a", "b").unionByName(some.select("a", "b").distinct()), tables)

    # What all members of a ball have: links with each other and with the whole balls that are linked.
    ends = whole.select(F.col("a").alias("end"), F.col("members_b").alias("more")).unionByName(whole.select(F.col("b").alias("end"), F.col("members_a").alias("more")))
    more = ends.groupBy("end").agg(F.sum("more").alias("more"))
    known = roots.select(F.col("node").alias("known"), "root")
    each = size.join(more, F.col("ball") == F.col("end"), "left").join(known, F.col("ball") == F.col("known"), "left")
    each = each.select("ball", (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("shared_links"), F.coalesce("root", "ball").alias("root"))
    placed = every.join(ball_of.select("node", "ball"), "node", "left")
    ids = placed.filter("ball IS NOT NULL").groupBy("ball").agg(F.min("id").alias("least")).join(each, "ball")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    each = tables.write(ids.drop("least").join(least, "root").drop("root"), "per-ball")
    tables.drop(size, judged, roots)
    counted = some.groupBy("node").agg(F.sum("links").alias("own_links"))
    out = placed.join(each, "ball", "left").join(counted, "node", "left")
    component = F.when(F.col("ball").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias("vec_id"), (F.coalesce("shared_links", F.lit(0)) + F.coalesce("own_links", F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"), "ball")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "ball")
