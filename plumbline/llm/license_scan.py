"""License detection by diagonal voting (operator 3), with DataFrame functions only.

Every rolling hash of three consecutive words of every text is joined to the positions of the same
hash in the license templates.  Hits vote for their diagonal, the text position less the template
position.  Each diagonal is merged with its neighbours a few words apart, so inserted and dropped words do
not break a match and a merged span is never much longer than its template; of neighbouring spans the
best covered stays.  A span is verified: enough of the template's positions were hit (the first word of each hit is
compared as text), and so was something that each similar template of another label does not have.
Where verified spans of several labels overlap, the best covered wins.

Defined cases: null text counts as empty and has no labels; rows are told apart by id and text, so rows
that repeat an id, or have none, are labelled each by its own text, and equal rows alike; an empty table
gives no rows; texts of any length are read whole; columns other than the two named may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import empty_if_null, lower_ascii

K = 3
#: Words of insertion or loss that a match may contain between two hits.
DRIFT = 4
#: The least share of a template's k-grams that a span must hit.
COVERAGE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are always looked for; fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates of up to this many k-grams in all are sent to every task; more are joined by a shuffle.
BROADCAST_GRAMS = 100_000
#: Texts, notices and statements of common public licenses; fixed values.
TEMPLATES = {
    "agpl-3.0": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "boost-1.0": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by-4.0": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc0-1.0": [
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
    ],
    "gpl-2.0": [
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
}


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def template_rows(templates: dict[str, list[str]]) -> tuple[list[tuple], list[tuple]]:
    """The k-grams (template, position, words) and the templates (template, label, number of k-grams,
    and for each similar template of another label the positions of what that one does not have)."""
    numbered = [(label, [w for w in re.split(SEPARATORS, text.lower()) if w]) for label, texts in templates.items() for text in texts]
    grams = [[tuple(words[p : p + K]) for p in range(len(words) - K + 1)] for _, words in numbered]
    for (label, words), own in zip(numbered, grams):
        if not own:
            raise ValueError(f"a template of {label} has under {K} words")
    apart = []
    for i, own in enumerate(grams):
        without = [[p for p, g in enumerate(own) if g not in set(other)] for j, other in enumerate(grams) if numbered[j][0] != numbered[i][0]]
        apart.append([ps for ps in without if 0 < len(ps) <= (1 - COVERAGE) * len(own)])
    return [(i, p, *g) for i, own in enumerate(grams) for p, g in enumerate(own)], [(i, numbered[i][0], len(grams[i]), apart[i]) for i in range(len(grams))]


def _small(df: DataFrame, rows: list) -> DataFrame:
    return F.broadcast(df) if len(rows) <= BROADCAST_GRAMS else df


def hits(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """All places where a text's k-gram occurs in a template: doc_id, row_key, at, template, template_at."""
    body = empty_if_null(F.col(text).cast("string"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("row_key"), _words(body).alias("words"))
    grams = F.transform("words", lambda w, i: F.struct(F.xxhash64(w, *(F.get(F.col("words"), i + j) for j in range(1, K))).alias("gram"), w.alias("word")))
    each = rows.select("doc_id", "row_key", F.posexplode(grams).alias("at", "g")).select("doc_id", "row_key", "at", "g.gram", "g.word")
    positions, _ = template_rows(templates or TEMPLATES)
    names = [f"t{i}" for i in range(K)]
    places = docs.sparkSession.createDataFrame(positions, "template int, template_at int, " + ", ".join(f"{n} string" for n in names))
    places = places.select("template", "template_at", "t0", F.xxhash64(*names).alias("gram"))
    return each.join(_small(places, positions), (each["gram"] == places["gram"]) & (each["word"] == places["t0"])).select("doc_id", "row_key", "at", "template", "template_at")


def spans(found: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Merged and verified spans: doc_id, row_key, label, template, first and last word, n_covered, coverage."""
    positions, known = template_rows(templates or TEMPLATES)
    about = _small(found.sparkSession.createDataFrame(known, "template int, label string, n_grams int, apart array<array<int>>"), known)
    row = ["doc_id", "row_key"]
    lines = found.groupBy(*row, "template", (F.col("at") - F.col("template_at")).alias("diagonal")).agg(F.collect_set("template_at").alias("covered"), F.min("at").alias("first"), F.max("at").alias("last"))
    near = Window.partitionBy(*row, "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    merged = lines.select(*row, "template", "diagonal", F.array_distinct(F.flatten(F.collect_list("covered").over(near))).alias("covered"), F.min("first").over(near).alias("first"), F.max("last").over(near).alias("last"))
    merged = merged.withColumn("n_covered", F.size("covered"))
    # Of neighbouring diagonals the best covered one speaks for all; among equals the first.
    best = merged.withColumn("best", F.max(F.struct("n_covered", -F.col("diagonal"))).over(near))
    chosen = best.filter((F.col("best.n_covered") == F.col("n_covered")) & (F.col("best.col2") == -F.col("diagonal")))
    told = chosen.join(about, "template").withColumn("coverage", F.col("n_covered") / F.col("n_grams"))
    told = told.filter((F.col("coverage") >= COVERAGE) & F.forall("apart", lambda ps: F.arrays_overlap(ps, F.col("covered"))))
    told = told.withColumn("last", F.col("last") + K - 1)
    # At each word the best covered span wins; a span that loses a word to another label goes.
    rank = F.struct("coverage", "n_covered")
    cells = told.select(*row, "label", "template", "diagonal", "first", "last", "n_covered", "coverage", F.explode(F.sequence("first", "last")).alias("word"))
    top = Window.partitionBy(*row, "word")
    cells = cells.withColumn("wins", rank >= F.max(rank).over(top))
    same = Window.partitionBy(*row, "word", "label")
    cells = cells.withColumn("wins", F.max("wins").over(same))
    kept = cells.groupBy(*row, "label", "template", "diagonal", "first", "last", "n_covered", "coverage").agg(F.min("wins").alias("wins")).filter("wins")
    return kept.drop("wins", "diagonal")


def phrase_places(words: Column) -> dict[str, Column]:
    """For each phrase, the positions where its words stand one after another."""
    out = {}
    for phrase in PHRASES:
        out[phrase] = F.filter(F.transform(words, _stands(words, phrase)), lambda p: p.isNotNull())
    return out


def _stands(words: Column, phrase: str):
    first, *rest = phrase.split()

    def at(w: Column, i: Column) -> Column:
        same = w == first
        for j, r in enumerate(rest, 1):
            same = same & (F.get(words, i + j) == r)
        return F.when(same, i)

    return at


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Every row with its phrase counts, its labels and the best coverage as score."""
    body = empty_if_null(F.col(text).cast("string"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("row_key"), _words(body).alias("words"), F.rlike(lower_ascii(body), F.lit("license|cc[^a-z0-9]+by")).alias("likely"))
    rows = rows.select("doc_id", "row_key", F.size("words").cast("bigint").alias("n_words"), F.when(F.col("likely"), F.col("words")).otherwise(F.array().cast("array<string>")).alias("words"))
    places = phrase_places(F.col("words"))
    names = {p: f"places_{i}" for i, p in enumerate(PHRASES)}
    rows = rows.select("doc_id", "row_key", "n_words", *(c.alias(names[p]) for p, c in places.items()))
    every = F.array_sort(F.flatten(F.array(*names.values())))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(names[p]) > 0, F.lit(label)) for p, label in PHRASES.items())))))
    rows = rows.select("doc_id", "row_key", "n_words", every.alias("places"), base.alias("base"))
    verified = spans(hits(docs, key, text, templates), templates)
    labelled = verified.groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage")).withColumnsRenamed({"doc_id": "found_id", "row_key": "found_key"})
    out = rows.join(labelled, rows["doc_id"].eqNullSafe(labelled["found_id"]) & (rows["row_key"] == labelled["found_key"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.get("places", F.lit(0)).cast("bigint").alias("first_word"), F.try_element_at("places", F.lit(-1)).cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )
