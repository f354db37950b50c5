"""A cautious stemmer for English verbs as a column expression, and entries found by it.

It reaches what a list of endings cannot: irregular forms, ies for y, and consonants doubled before ed and ing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Irregular forms and their verbs; fixed values.
IRREGULAR = {
    "paid": "pay", "froze": "freeze", "frozen": "freeze", "sent": "send", "gave": "give", "given": "give", "took": "take", "taken": "take", "held": "hold", "told": "tell",
    "sold": "sell", "bought": "buy", "caught": "catch", "spent": "spend", "lost": "lose", "stolen": "steal", "stole": "steal", "won": "win", "sought": "seek",
}
#: Words and entries of so many letters or fewer are left alone: their forms are other words.
SHORT = 4


def stem(word: Column) -> Column:
    """The stem of a word; one that nothing applies to is its own, in lower case."""
    low = F.lower(word)
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    bare = F.regexp_replace(low, r"([b-df-hjkmnp-rtv-z])\1(?:ed|ing)$", "$1")
    # The doubling is undone only behind consonant, vowel, consonant.
    undone = (bare != low) & bare.rlike("[^aeiou][aeiou][^aeiou]$")
    return F.coalesce(F.try_element_at(table, low), F.when(low.rlike("[^aeiou]ies$"), F.regexp_replace(low, "ies$", "y")), F.when(undone, bare), low)


def found_by_stem(texts: DataFrame, keys: list[str], text: str, entries: DataFrame, foreign: Column) -> DataFrame:
    """The keys and the entries (column ``entry``) of which a text has another form with the same stem.

    Every distinct word is stemmed once, whatever the number of texts; words that have the stem of an entry, few
    of all, are joined with the texts' words.  ``foreign`` marks texts that are not read as English.
    """
    words = texts.filter(~F.coalesce(foreign, F.lit(False))).select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    words = words.filter(F.length("word") > SHORT)
    known = entries.filter(F.col("entry").rlike("^[A-Za-z]+$") & (F.length("entry") > SHORT)).select("entry", stem(F.col("entry")).alias("stem")).distinct()
    forms = words.select("word").distinct().withColumn("stem", stem(F.col("word"))).join(known, "stem").select("word", "entry")
    return words.join(forms, "word").select(*keys, "entry").distinct()
