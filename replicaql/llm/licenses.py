"""License scans (7), native: a positional rare-token index over licence texts.

The licence texts are indexed by word: postings of a word name the texts and positions where it stands. Every file becomes
lower-case words, and the positions of licence words are kept. For each licence text the words of highest inverse document
frequency (counted over all files) that a file shares with it are looked up in the postings of all licences; each hit proposes where the licence would start, and the hits are
counted by file, licence and start. A start on which two different words agree must show the licence's key phrase, word by
word, at its place; its score is the share of the licence's weight (inverse document frequency) that stands in place there, so a
text with words put in or left out is found by its parts, with a lower score.

Only positions of licence words leave a file, in files that hold the longest word of some key phrase; all joins are by (file, start) or (file,
position), so a file that repeats a notice is spread and costs time in proportion to its length.

Defined results: a null or empty text has no words, no labels and score 0; rows are independent, so repeated rows and
null ids stay as they are; extra columns pass through, but those of scan()'s results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, small, table, written

WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Words of a licence that are looked up in a file: its rarest that the file holds.
RARE = 4
#: (label, phrase) counted as base places.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Fixed values: (label, licence text or notice, key phrase).
TEXTS = (
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc", "creative commons attribution", "creative commons attribution"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "permission is hereby granted free of charge"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "permission to use copy modify"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", "redistribution and use in source"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "under the apache license version 2"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "terms of the gnu general public license"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", "terms of the gnu lesser general public license"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "terms of the mozilla public license"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unencumbered software released"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""", "alter it and redistribute it freely"),
)


def _words(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


TEMPLATES = tuple((label, _words(text), _words(key)) for label, text, key in TEXTS)
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t} | {w for _, p in BASE for w in p.split()})
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _key_at(words: list[str], key: list[str]) -> int:
    return next(j for j in range(len(words)) if words[j : j + len(key)] == key)


def index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, with row (a number of its own), n_words, present (the licence words that it holds) and occ (their
    positions, where a key phrase can stand); written."""
    # a text without the longest word of each key phrase matches no licence: its positions are not needed
    needed = sorted({max(k, key=len) for _, _, k in TEMPLATES} | {max(p.split(), key=len) for _, p in BASE} | {"cc"})
    found = docs.drop(*RESULTS, "row", "present", "occ").withColumn("_words", F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(WORDS), F.lit(1)))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    found = found.withColumn("n_words", F.size("_words").cast("long")).withColumn("present", F.array_intersect(vocabulary, F.col("_words")))
    places = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(w.alias("w"), i.cast("int").alias("p")))), lambda x: x.isNotNull())
    possible = F.arrays_overlap("present", F.array(*[F.lit(w) for w in needed]))
    return written(found.withColumn("occ", F.when(possible, places)).drop("_words", text_col).withColumn("row", F.monotonically_increasing_id()), "licence-index")


def weights(indexed: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all texts; at most len(VOCABULARY) rows reach the driver."""
    n = indexed.count()
    seen = {r["w"]: r["n"] for r in indexed.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in VOCABULARY}


def _postings(spark: SparkSession, idf: dict[str, float]) -> DataFrame:
    """licence, at, w, weight (its share of the licence's), key (whether it belongs to the key phrase): one row for each word of a licence text."""
    rows = []
    for n, (_, words, key) in enumerate(TEMPLATES):
        total, first = sum(idf[w] for w in words), _key_at(words, key)
        rows += [(n, j, w, idf[w] / total, first <= j < first + len(key)) for j, w in enumerate(words)]
    return F.broadcast(spark.createDataFrame(rows, "licence int, at int, w string, weight double, key boolean"))


def _rarest(idf: dict[str, float]) -> Column:
    """A file's words to look up: of each licence its RARE words of highest weight that the file holds."""
    parts = []
    for _, words, _ in TEMPLATES:
        order = sorted(set(words), key=lambda w: (-idf[w], w))
        parts.append(F.slice(F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("present")), 1, RARE))
    return F.array_distinct(F.flatten(F.array(*parts)))


def notices(indexed: DataFrame, idf: dict[str, float]) -> DataFrame:
    """row, licence (its place in TEXTS), start (in words), share: every place where a licence's key phrase stands."""
    postings = _postings(indexed.sparkSession, idf)
    some = indexed.where(F.size("occ") > 0)
    # exploded, so that the list is made once a file and not once a word
    hits = some.select("row", "occ", F.explode(F.array(_rarest(idf))).alias("rare")).select("row", F.explode(F.filter("occ", lambda x: F.array_contains("rare", x["w"]))).alias("x"))
    starts = hits.select("row", "x.w", "x.p").join(postings, "w").select("row", "licence", (F.col("p") - F.col("at")).alias("start"), "w").where("start >= 0")
    starts = starts.groupBy("row", "licence", "start").agg(F.min("w").alias("one"), F.max("w").alias("other")).where("one <> other").select("row", "licence", "start")
    places = some.select("row", F.explode("occ").alias("x")).select("row", "x.w", "x.p")

    def placed(at: DataFrame, words: DataFrame) -> DataFrame:
        wanted = at.join(words, "licence").select("row", "licence", "start", "w", (F.col("start") + F.col("at")).alias("p"), "weight")
        return wanted.join(places, ["row", "p", "w"]).groupBy("row", "licence", "start")

    lengths = [len(key) for _, _, key in TEMPLATES]
    length = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("licence") + 1)
    sure = placed(starts, postings.where("key")).agg(F.count("*").alias("n")).where(F.col("n") == length).select("row", "licence", "start")
    return placed(sure, postings).agg(F.sum("weight").alias("share"))


def _starts(word: str, offset: int) -> Column:
    """Where a phrase would start for word to stand at its offset."""
    return F.transform(F.filter("occ", lambda x: x["w"] == word), lambda x: x["p"] - offset)


def _phrase(phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    starts = reduce(F.array_intersect, [_starts(w, i) for i, w in enumerate(phrase.split())])
    return F.when(F.size("occ") > 0, starts).otherwise(F.array().cast("array<int>"))


def scan(indexed: DataFrame, idf: dict[str, float]) -> DataFrame:
    """The columns of index() but present and occ, and n_base, first_word, last_word, base_labels, labels and score (the best share, 0.5 for a base
    place without one)."""
    out = indexed.withColumns({f"_b{i}": _phrase(phrase) for i, (_, phrase) in enumerate(BASE)})
    bases = F.filter(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE)]), lambda x: x.isNotNull())
    out = out.withColumn("_base", bases).withColumn("_all", F.concat(*[F.col(f"_b{i}") for i in range(len(BASE))])).drop("present", "occ", *[f"_b{i}" for i in range(len(BASE))])
    label = F.element_at(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("licence") + 1)
    found = notices(indexed, idf).groupBy("row").agg(F.collect_set(label).alias("_found"), F.max("share").alias("_share"))
    found = written(found, "notices")
    out = out.join(small(found, F.lit(24) + 16 * F.size("_found")), "row", "left")
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.withColumns({
        "n_base": F.size("_all").cast("long"), "first_word": F.array_min("_all").cast("long"), "last_word": F.array_max("_all").cast("long"), "base_labels": named(F.col("_base")),
        "labels": named(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))),
        "score": F.least(F.lit(1.0), F.greatest(F.coalesce("_share", F.lit(0.0)), F.when(F.size("_all") > 0, 0.5).otherwise(0.0))),
    }).drop("row", "_all", "_base", "_found", "_share")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scan(indexed, weights(indexed)).select("doc_id", *RESULTS)


QUERIES = {"op7_licenses": op7_licenses}
ORACLE_SQL: dict[str, str] = {}
