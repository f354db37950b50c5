"""Personal data by bootstrapped contextual extraction (operator 10).

Seeds are the entities that four fixed grammars find, e-mail addresses, IP addresses, payment cards
and phone numbers, and those of ``SEEDS``, quoted keys of hexadecimal digits.  Every identifier-like run of a text, seed or not, is an instance that stands in
lexical patterns: one or two words before it, or the words on both sides, each with and without its own
shape; patterns without the shape reach identifiers of a form that no seed has.  Spark holds the graph
of patterns and instances as a table of edges and scores it in rounds, as bootstrapped extraction
does, until no score rises any more: a pattern's confidence is the share of its instances, by score, that are of its kind, where unknown instances
count little and a prior counts against it, and an instance's score the chance that at least one of its patterns is right (noisy or).  Patterns of high
confidence and enough distinct instances of the kind (seeds, and claimed ones by score) then claim the
unseen identifiers that stand in them, and claimed instances support further patterns in the next round.

The graph only has identifier-like runs (an ``@``, or ``min_digits`` digits, by which this operator defines
what an identifier is), not all words.  Number-like
runs with single blanks between them are also one run as a whole; where the whole is claimed its parts are not.
Patterns are grouped by key with partial sums, so a context as frequent as a third of all rows sends
one row from each task.

Defined cases: null counts as empty; spans are in code points, end exclusive; a candidate that fails
its check (card digits, Luhn, address parts, phone digits) is dropped without a retry; found spans
never overlap the grammars' spans; rows without id and rows that repeat an id and text get equal spans; an empty table
gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, slices

KINDS = ("email", "ip", "card", "phone")
#: An unseen run must have an ``@`` or this many digits to be an identifier at all.
MIN_DIGITS = 7
#: A number written with blanks has no more digits than this, which no account number exceeds.
MAX_DIGITS = 34
#: A score that rises by no more than this has settled.
SETTLED = 1e-3
#: A pattern extracts when its confidence reaches this and its instances' scores add up to this support.
CONFIDENCE, SUPPORT = 0.9, 3
#: An instance of no known kind speaks against a pattern by this share of what one of another kind does,
#: and every pattern starts with this much against it, so that a few seeds by chance are not enough.
UNKNOWN, PRIOR = 0.1, 1.0
#: Words and shapes of more characters stand in a pattern by their digest.
LONG = 40
#: Seeds of kinds that the four grammars don't have; their spans are the method's own.
SEEDS = {"secret": re.compile(r"(?<=[\"'])(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?=[\"'])")}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
#: A part of a number that is written with blanks; letters of a country may come first.
_PART = re.compile(r"(?:[A-Z]{2})?[+(]*[0-9](?:[0-9().+/-]*[0-9])?")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`()[]{}<>,;:!?."

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address starts where the run of local characters before its @ starts."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """What the four grammars find, by kind and then by place."""
    if not text:
        return []
    out: list[Span] = []
    if "@" in text:
        out += (("email", a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            parts = (p.lstrip("0") for p in m.group().split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


_BLANKS = {c: " " for c in range(0x09, 0x0E)}


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of characters other than white space that hold a digit or an @."""
    flat, end = text.translate(_BLANKS), 0
    while m := _MARK.search(flat, end):
        start = max(end, flat.rfind(" ", end, m.start()) + 1)
        end = flat.find(" ", m.end())
        end = len(flat) if end < 0 else end
        yield start, end


def _named(part: str) -> str:
    return part if len(part) <= LONG else hashlib.blake2b(part.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _shape(value: str) -> str:
    """The run's build: digits as 9, letters as a, repeats as one; lengths of digit runs by size."""
    s = re.sub(r"[0-9]+", lambda m: "9" * min(4, 1 + len(m.group()) // 4), value)
    return _named(re.sub(r"[^\W\d_]+", "a", s))


def _words_before(flat: str, end: int) -> Iterator[str]:
    """Words to the left, nearest first; punctuation is no word."""
    while end > 0:
        while end > 0 and flat[end - 1] == " ":
            end -= 1
        start = flat.rfind(" ", 0, end) + 1
        if word := flat[start:end].strip(_EDGE):
            yield word
        end = start


def _words_after(flat: str, start: int) -> Iterator[str]:
    while start < len(flat):
        end = flat.find(" ", start)
        end = len(flat) if end < 0 else end
        if word := flat[start:end].strip(_EDGE):
            yield word
        start = end + 1


def _context(flat: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before and the word after, ``^`` and ``$`` where the text ends."""
    plain = lambda w: _named(_DIGIT.sub("9", w.lower()))
    before = _words_before(flat, start)
    last = next(before, None)
    second = next(before, None) if last else None
    after = next(_words_after(flat, end), None)
    return plain(second) if second else "^", plain(last) if last else "^", plain(after) if after else "$"


def _patterns(flat: str, start: int, end: int) -> list[str]:
    second, last, after = _context(flat, start, end)
    shape = _shape(flat[start:end])
    out = [f"L2 {second} {last} {shape}", f"LR {last} {after} {shape}"]
    # Without the shape a pattern needs a word; the text's ends alone say nothing.
    if last != "^":
        out += [f"C1 {last}", f"C2 {second} {last}"]
    if (last, after) != ("^", "$"):
        out.append(f"CR {last} {after}")
    return out


def _identifier(value: str, min_digits: int) -> bool:
    return "@" in value[1:-1] or sum(map(str.isdigit, value)) >= min_digits


def _candidates(text: str, taken: list[tuple[int, int]], min_digits: int) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Place of every identifier-like run clear of the taken places, and of the whole number that it is a part of."""
    chains: list[list[tuple[int, int]]] = []
    i, behind = 0, None  # behind: where the last run ended, if a number may go on there
    for first, end in _runs(text):
        a, b = first, end
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            behind = None
            continue
        number = _PART.fullmatch(text, a, b)
        if number and behind == first - 1 and text[behind] in " \t" and not text[first:a].strip("("):
            chains[-1].append((a, b))
        else:
            chains.append([(a, b)])
        behind = end if number and not text[b:end].strip(")") else None
    for parts in chains:
        whole = (parts[0][0], parts[-1][1])
        if len(parts) > 1 and min_digits <= sum(map(str.isdigit, text[slice(*whole)])) <= MAX_DIGITS:
            yield *whole, None
        else:
            whole = None
        for a, b in parts:
            if _identifier(text[a:b], min_digits):
                yield a, b, whole


def seed_spans(text: str | None, base: list[Span], seeds: dict[str, re.Pattern] | None = None) -> list[Span]:
    """Seeds of further kinds, clear of the grammars' spans."""
    if not text:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in taken], [0, *itertools.accumulate((b for _, b in taken), max)]
    out = []
    for kind, grammar in (SEEDS if seeds is None else seeds).items():
        for m in grammar.finditer(text):
            if furthest[bisect.bisect_left(starts, m.end())] <= m.start():
                out.append((kind, *m.span()))
    return out


def instances(text: str | None, spans: list[Span], min_digits: int = MIN_DIGITS) -> list[tuple[str, str | None, int, int, list[str], str | None]]:
    """value, kind of a seed, place, patterns and whole number of every identifier-like run and every seed."""
    if not text:
        return []
    found = [(kind, a, b, None) for kind, a, b in spans]
    found += [(None, *c) for c in _candidates(text, sorted((a, b) for _, a, b in spans), min_digits)]
    flat = text.translate(_BLANKS)
    return [(text[a:b], kind, a, b, _patterns(flat, a, b), whole and text[slice(*whole)]) for kind, a, b, whole in found]


_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row_key", T.LongType()),
    *(T.StructField(name, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))) for name in ("spans", "seeds")),
    T.StructField("instances", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("whole", T.StringType())]))),
])
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_INSTANCE_TYPE = pa.list_(pa.struct([("value", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("whole", pa.string())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", min_digits: int = MIN_DIGITS, seeds: dict[str, re.Pattern] | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """The grammars' spans, further seeds and instances of every row; row_key is a digest of its text.
    Columns named in ``beside`` come first, as they are."""
    body = F.col(text).cast("string")
    rows = docs.select(*beside, F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("row_key"), body.alias("text"))
    listed = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans, more, found = [], [], []
            for t in batch.column("text").to_pylist():
                own = base_spans(t)
                further = seed_spans(t, own, seeds)
                spans.append(listed(own))
                more.append(listed(further))
                found.append([{"value": v, "kind": k, "start": a, "end": b, "patterns": p, "whole": w} for v, k, a, b, p, w in instances(t, own + further, min_digits)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in beside), batch.column("doc_id"), batch.column("row_key"), pa.array(spans, _SPAN_TYPE), pa.array(more, _SPAN_TYPE), pa.array(found, _INSTANCE_TYPE)], [*beside, "doc_id", "row_key", "spans", "seeds", "instances"])

    return rows.mapInArrow(find, T.StructType([*(rows.schema[c] for c in beside), *_FOUND]))


def score(found: DataFrame, tables: Tables, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """value, kind of the unseen identifiers that trusted patterns claim.

    Edges join a distinct value with a distinct pattern.  A seed value scores 1 for its kind for good;
    others start at 0 and are scored anew in each round.  Scores only rise from round to round, so
    rounds end, which they do when no score has risen by more than ``SETTLED``.
    """
    each = found.select(F.explode("instances").alias("i")).select("i.value", "i.kind", F.explode("i.patterns").alias("pattern"))
    edges = tables.write(each.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "edges")
    # A score is 1 at most, so patterns of fewer values can't be trusted in any round.
    total = tables.write(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support), "patterns")
    live = tables.write(edges.join(total, "pattern"), "live-edges")
    tables.drop(edges, total)
    seeded = live.groupBy("pattern").agg(F.max("n").alias("n"), F.count("seed").alias("n_seeds"))
    known = tables.write(live.filter("seed IS NOT NULL").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("sure")), "seed-support")
    seeded = tables.write(seeded, "seeded")
    claimed = tables.write(live.select("value", F.lit("").alias("kind"), F.lit(0.0).alias("score")).limit(0), "claimed")
    while True:
        learnt = live.filter("seed IS NULL").join(claimed, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("learnt"))
        both = known.join(learnt, ["pattern", "kind"], "full").select("pattern", "kind", F.coalesce("sure", F.lit(0.0)).alias("sure"), F.coalesce("learnt", F.lit(0.0)).alias("learnt")).join(seeded, "pattern")
        against = F.col("n_seeds") - F.col("sure") + UNKNOWN * (F.col("n") - F.col("n_seeds") - F.col("learnt")) + PRIOR
        by_kind = both.withColumn("support", F.col("sure") + F.col("learnt")).withColumn("trust", F.col("support") / (F.col("support") + against))
        trusted = tables.write(by_kind.filter((F.col("trust") >= confidence) & (F.col("support") >= support)).select("pattern", "kind", "trust"), "trusted")
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6))))
        scored = tables.write(live.filter("seed IS NULL").join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score")), "claimed")
        before = claimed.withColumnRenamed("score", "before")
        rising = scored.join(before, ["value", "kind"], "left").filter(F.col("score") - F.coalesce("before", F.lit(0.0)) > SETTLED).limit(1).count()
        tables.drop(trusted, claimed)
        claimed = scored
        if not rising:
            break
    best = claimed.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).filter(F.col("best.score") >= confidence)
    out = tables.write(best.select("value", F.col("best.kind").alias("kind")), "identifiers")
    tables.drop(live, known, seeded, claimed)
    return out


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, min_digits: int = MIN_DIGITS, seeds: dict[str, re.Pattern] | None = None) -> DataFrame:
    """doc_id, row_key, the grammars' spans and the spans that the method adds (further seeds and what patterns claim), for every row."""
    tables = Tables(docs.sparkSession)
    found = tables.write(scan(docs, key, text, min_digits, seeds), "instances")
    claimed = score(found, tables, confidence, support)
    unseen = found.select("doc_id", "row_key", F.explode("instances").alias("i")).filter("i.kind IS NULL").select("doc_id", "row_key", "i.value", "i.start", "i.end", "i.whole")
    told = unseen.join(claimed, "value").join(claimed.select(F.col("value").alias("whole")), "whole", "left_anti")
    added = told.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    added = added.select(F.col("doc_id").alias("added_id"), F.col("row_key").alias("added_key"), "added")
    same = found["doc_id"].eqNullSafe(added["added_id"]) & found["row_key"].eqNullSafe(added["added_key"])
    kind = found.schema["spans"].dataType
    return found.select("doc_id", "row_key", "spans", "seeds").join(added, same, "left").select("doc_id", "row_key", "spans", F.concat("seeds", F.coalesce("added", F.array().cast(kind))).alias("added"))


def _listed(spans: Column) -> Column:
    """Spans as text: the listed kinds first and in their order, then further ones by name."""
    place = lambda kind: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0)), F.lit(len(KINDS) + 1))
    order = F.transform(spans, lambda s: F.struct(place(s["kind"]).alias("rank"), F.when(place(s["kind"]) > len(KINDS), s["kind"]).otherwise("").alias("name"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts by kind, the digest of the grammars' spans and all spans as text."""
    found = extract(docs, key, text)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select("doc_id", *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("spans", "added")).alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, tables: Tables | None = None) -> DataFrame:
    """The input's rows and columns, every span replaced by its kind in angle brackets; ``length``
    names a column that holds the text's number of characters.

    Rows are written beside their spans.  Only rows with an unseen identifier wait for what patterns claim
    and are joined with it; all others are never moved.
    """
    tables = tables or Tables(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("own_row"), F.monotonically_increasing_id().alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = tables.write(scan(packed, beside=("own_row",)), "rows-and-instances")
    claimed = score(found, tables)
    waits = F.exists("instances", lambda i: i["kind"].isNull())
    unseen = found.filter(waits).select("doc_id", F.explode("instances").alias("i")).filter("i.kind IS NULL").select("doc_id", "i.value", "i.start", "i.end", "i.whole")
    told = unseen.join(claimed, "value").join(claimed.select(F.col("value").alias("whole")), "whole", "left_anti")
    added = told.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    own = F.concat("spans", "seeds")
    none = F.array().cast(found.schema["spans"].dataType)
    still = found.filter(~waits).select("own_row", own.alias("hit_spans"))
    moved = found.filter(waits).select("doc_id", "own_row", own.alias("known")).join(added, "doc_id", "left").select("own_row", F.concat("known", F.coalesce("added", none)).alias("hit_spans"))
    rows = still.unionByName(moved).select("own_row", F.col("own_row").getField(text).cast("string").alias("own_text"), "hit_spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own_text"):
            texts = []
            for t, spans in zip(batch.column("own_text").to_pylist(), batch.column("hit_spans").to_pylist()):
                texts.append(replaced(t, [(s["kind"], s["start"], s["end"]) for s in spans or ()]))
            yield pa.RecordBatch.from_arrays([batch.column("own_row"), pa.array(texts, pa.string())], ["own_row", "new_text"])

    schema = T.StructType([T.StructField("own_row", rows.schema["own_row"].dataType), T.StructField("new_text", T.StringType())])
    out = rows.mapInArrow(clean, schema)
    kind = {f.name: f.dataType for f in docs.schema.fields}
    new = {text: F.col("new_text")} | ({length: F.length("new_text").cast(kind[length])} if length else {})
    return out.select(*(new[c].alias(c) if c in new else F.col("own_row").getField(c).alias(c) for c in docs.columns))


def replaced(text: str | None, spans: list[Span]) -> str | None:
    """The text with spans, which may overlap, replaced; an overlap is replaced once, by its first kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])
