"""Quality rules as one projection (operator 6).

``RULES`` is a threshold table; it is compiled into a single Spark projection of counts, ratios and
verdicts made of built-in functions only.

Words are runs of characters other than blank and U+0009 to U+000D.  Repeated words are those inside
an eight-word window that occurs twice or more in the text; windows are told apart by a 64-bit
hash over the hashes of their words.

Defined cases: null text has no words and fails; empty texts fail; repeated rows get a verdict each;
an empty table gives no rows; a text of any length is read whole; input columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of ten languages; fixed values.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by at this from are or an "
    "le la les de des et en un une que qui est pour dans du au avec sur "
    "der die das und zu den von im ist mit ein eine auf dem nicht als für "
    "el los las del y es por con para una se no lo "
    "il di che è non per sono gli della "
    "o os um uma não com mais dos ao "
    "het een van dat niet zijn voor met "
    "och att det som på är inte av "
    "w i na nie z się jest że do "
    "и в не на что с по как это"
).split()


@dataclass(frozen=True)
class Rule:
    """A row fails when 100 * numerator lies outside low and high times denominator."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: What makes a text junk; both base rules come first.
BASE_RULES = (
    Rule("too_short", "n_words", "hundred", low=20),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
    Rule("shouted_ends", "n_double_marks", "n_words", high=40),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _counts(text: Column) -> dict[str, Column]:
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) != "")
    return {"words": words, "lines": lines}


def _once(value: Column) -> Column:
    """The same value, but computed once for all that refer to it.  The row number (never below 0)
    keeps the optimizer from copying the expression into every place that uses it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _from(column: str, start: int) -> Column:
    return F.slice(column, F.lit(start + 1), F.greatest(F.size(column) - start, F.lit(0)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """own_row (the input's row) with the counts that rules refer to."""
    t = F.coalesce(F.col("own_text"), F.lit(""))
    c = _counts(t)
    df = docs.select(F.struct("*").alias("own_row"), F.col(text).cast("string").alias("own_text"))
    df = df.withColumns({"q_words": _once(c["words"]), "q_lines": _once(c["lines"])})
    df = df.withColumns({
        "n_words": F.size("q_words").cast("bigint"),
        "word_chars": F.length(_without(t, BLANKS)).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("bigint"),
        "n_lines": F.size("q_lines").cast("bigint"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"),
        "n_stop_words": F.size(F.filter("q_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        "n_double_marks": F.size(F.filter("q_words", lambda w: w.endswith("!!"))).cast("bigint"),
        "hundred": F.lit(100).cast("bigint"),
        "q_hash": _once(F.transform("q_words", lambda w: F.xxhash64(w))),
    })
    # One hash for each window, from pairs of pairs of pairs.
    for step in (1, 2, 4):
        size = F.greatest(F.size("q_hash") - step, F.lit(0))
        df = df.withColumn("q_hash", _once(F.zip_with(F.slice("q_hash", F.lit(1), size), _from("q_hash", step), lambda a, b: F.xxhash64(a, b))))
    # Most texts repeat no window: those are told by one count of distinct hashes.
    sorted_ = F.sort_array(F.transform("q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("q_again", _once(F.when(F.size(F.array_distinct("q_hash")) < F.size("q_hash"), sorted_)))
    near = lambda x, k: F.coalesce(F.get(F.col("q_again"), k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("q_places", _once(F.sort_array(F.transform(F.filter("q_again", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))))
    gaps = F.zip_with("q_places", _from("q_places", 1), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    repeated = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", _once(F.coalesce(repeated, F.lit(0)).cast("bigint"))).drop("own_text", "q_words", "q_lines", "q_hash", "q_again", "q_places")


def fails(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression for a whole threshold table."""
    out = F.lit(False)
    for r in rules:
        x, d = 100 * F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            out = out | (x < r.low * d)
        if r.high is not None:
            out = out | (x > r.high * d)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_double_marks", "n_repeat_words")


def _judged(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    df = measured(docs, text)
    return df.withColumn("base_failed", fails(BASE_RULES)).withColumn("kept", ~(F.col("base_failed") | fails(rules)))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's rows with counts, base_failed and kept; these take the place of input columns of the same name."""
    found = (*COUNTS, "base_failed", "kept")
    own = [F.col("own_row").getField(c).alias(c) for c in docs.columns if c not in found]
    return _judged(docs, text, rules).select(*own, *found)


def kept_rows(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns only, whatever those are called."""
    return _judged(docs, text, rules).filter("kept").select("own_row.*")
