"""License scans by diagonal voting: word k-grams of every text are joined to the positions they have in license templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import identified, table

#: A word of the scan, after A-Z are lower-cased: a longest run of digits, letters a-z and characters beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram: of phrases, which must stand whole, and of texts, which may differ in places.
PHRASE_GRAM, TEXT_GRAM = 2, 4
#: Diagonals of one text template so many words apart or fewer are one span (words inserted or left out).
SLACK = 12
#: Least share of a text template's words that a span's verified grams cover, and least share of the span that they are.
COVER, DENSE = 0.75, 0.6
#: Templates of more positions than this are joined by a shuffle instead of a broadcast.
BROADCAST_POSITIONS = 200_000

# Fixed values of the contract: phrase, label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Further phrases with labels of their own.
PHRASES = (
    ("gnu general public license version 2", "gpl-2"), ("gnu general public license version 3", "gpl-3"), ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"), ("apache license version 2 0", "apache-2"),
    ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("bsd license", "bsd"), ("isc license", "isc"), ("boost software license", "bsl"), ("creative commons attribution", "cc-by"), ("cc by nc", "cc-by-nc"), ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"), ("cc by nc sa", "cc-by-nc-sa"), ("cc by nc nd", "cc-by-nc-nd"), ("cc0 1 0 universal", "cc0"),
)
# License texts and notices as they are published, without names of holders.
TEXTS = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gpl-3"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", "cc-by"),
)

Template = tuple[str, str, bool, bool]
#: (text, label, whether it must stand whole, whether it is of the contract's base)
TEMPLATES: tuple[Template, ...] = tuple((p, label, True, True) for p, label in BASE) + tuple((p, label, True, False) for p, label in PHRASES) + tuple((t, label, False, False) for t, label in TEXTS)


def license_words(text: Column | str) -> Column:
    """Words of a text after A-Z are lower-cased; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER), F.lit(LICENSE_WORD), F.lit(0))


def _positions(spark: SparkSession, templates: Sequence[Template], phrases: bool, gram: int) -> tuple[DataFrame, int]:
    """One row for each gram of the templates: its hash and the places (template, offset, words) where it stands; and how many places there are."""
    given = spark.createDataFrame([(i, text) for i, (text, _, whole, _) in enumerate(templates) if whole == phrases], "t int, text string")
    words = given.select("t", license_words("text").alias("w")).where(F.size("w") >= gram)
    at = words.select("t", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - gram + 1), lambda i: F.slice("w", i, F.lit(gram)))).alias("o", "g"))
    places = at.select(F.xxhash64(*[F.col("g")[i] for i in range(gram)]).alias(f"_h{gram}"), F.struct("t", "o", F.lit(gram).alias("k"), F.array_join("g", " ").alias("g")).alias("p"))
    return places.groupBy(f"_h{gram}").agg(F.collect_list("p").alias(f"_p{gram}")), sum(len(t[0].split()) for t in templates)


def votes(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Votes by diagonal: _rid, doc_id, n_words, t (template), diagonal and os (template offsets of the grams that stand on it).

    Every rolling gram of every text meets the template positions of its hash in a broadcast join; equal hashes count only if
    the words are equal. A text's grams lie in one task, so votes are counted before the shuffle, and a
    diagonal has at most as many as its template has words. Each text also gives a row with t null where its first gram has no hit.
    """
    spark = docs.sparkSession
    words = identified(docs.select("doc_id", "text")).select("_rid", "doc_id", license_words("text").alias("w"))
    later = [F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(TEXT_GRAM)]
    rows = words.select("_rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*later)).alias("at", "g"))
    hashed = rows
    for k in (PHRASE_GRAM, TEXT_GRAM):
        hashed = hashed.withColumn(f"_h{k}", F.when(F.col(f"g.w{k - 1}").isNotNull(), F.xxhash64(*[F.col(f"g.w{i}") for i in range(k)])))
    for k, phrases in ((PHRASE_GRAM, True), (TEXT_GRAM, False)):
        places, n = _positions(spark, templates, phrases, k)
        hashed = hashed.join(F.broadcast(places) if n <= BROADCAST_POSITIONS else places, f"_h{k}", "left")
    none = F.array().cast("array<struct<t:int,o:int,k:int,g:string>>")
    said = lambda p: F.when(p["k"] == PHRASE_GRAM, F.concat_ws(" ", "g.w0", "g.w1")).otherwise(F.concat_ws(" ", "g.w0", "g.w1", "g.w2", "g.w3"))
    hits = F.filter(F.concat(F.coalesce(f"_p{PHRASE_GRAM}", none), F.coalesce(f"_p{TEXT_GRAM}", none)), lambda p: p["g"] == said(p))
    met = hashed.where(F.col(f"_p{PHRASE_GRAM}").isNotNull() | F.col(f"_p{TEXT_GRAM}").isNotNull() | F.coalesce(F.col("at") == 0, F.lit(True)))
    cast = met.select("_rid", "doc_id", "n_words", "at", F.explode_outer(hits).alias("p"))
    return cast.groupBy("_rid", "doc_id", "n_words", F.col("p.t").alias("t"), (F.col("at") - F.col("p.o")).cast("long").alias("diagonal")).agg(F.collect_list("p.o").alias("os"))


def license_spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """_rid, doc_id, n_words, label, base, start, end (words from 0, end exclusive) and cover of each span. Every text also has a row at least; rows with label null are no span.

    A phrase is a span where all its grams vote for one diagonal. Of a text template, diagonals at most SLACK words apart are
    merged; the span stays if verified grams cover COVER of the template's words and make up DENSE of the span.
    Null text counts as empty. Repeated rows are scanned each. A very long text is exploded where it lies and only its
    votes are shuffled. Overlapping spans of several templates all stay, and spans that tie in place are separate rows.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    of = spark.createDataFrame([(i, label, whole, base, text) for i, (text, label, whole, base) in enumerate(templates)], "t int, label string, whole boolean, base boolean, text string")
    known = F.broadcast(of.select("t", "label", "whole", "base", F.size(license_words("text")).alias("len")))  # one row a template
    cast = votes(docs, templates).join(known, "t", "left")
    key = ["_rid", "t"]
    order = Window.partitionBy(*key).orderBy("diagonal")
    opens = F.when(F.col("whole"), F.lit(1)).otherwise(F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= SLACK, 0).otherwise(1))
    grouped = cast.withColumn("_new", opens).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gram = F.when(F.col("whole"), PHRASE_GRAM).otherwise(TEXT_GRAM)
    spread = F.flatten(F.transform("os", lambda o: F.sequence(o, o + gram - 1)))
    low, high = F.col("diagonal") + F.array_min("os"), F.col("diagonal") + F.array_max("os") + gram
    spans = grouped.groupBy(*key, "doc_id", "n_words", "label", "base", "whole", "len", "_run").agg(F.min(low).alias("start"), F.max(high).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list(spread)))).alias("covered"))
    cover = F.col("covered") / F.col("len")
    good = F.when(F.col("whole"), F.col("covered") == F.col("len")).otherwise((cover >= COVER) & (F.col("covered") >= DENSE * (F.col("end") - F.col("start"))))
    keep = F.coalesce(good, F.lit(False))
    shown = lambda c: F.when(keep, c)
    return spans.select("_rid", "doc_id", "n_words", shown(F.col("label")).alias("label"), shown(F.col("base")).alias("base"), shown(F.col("start")).alias("start"), shown(F.col("end")).alias("end"), shown(cover).alias("cover"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row for each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (distinct, sorted) and score (best cover; 0 without a span).

    Edge cases as in ``license_spans``.
    """
    spans = license_spans(docs, templates)
    of = spans.groupBy("_rid", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return of.drop("_rid")


def op11_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = ", ".join(f"({i}, '{text.replace(chr(39), chr(39) * 2)}', '{label}', {whole}, {base})" for i, (text, label, whole, base) in enumerate(TEMPLATES))
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}')"
    return rf"""
WITH t0(t, text, label, whole, base) AS (VALUES {quoted}),
t AS (SELECT t, label, whole, base, {words("text")} AS w, CASE WHEN whole THEN {PHRASE_GRAM} ELSE {TEXT_GRAM} END AS k FROM t0),
p AS (SELECT t, k, label, whole, base, len(w) AS n, unnest(range(len(w) - k + 1)) AS o, w FROM t),
q AS (SELECT t, k, label, whole, base, n, o, array_to_string(w[o + 1:o + k], ' ') AS g FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
e AS (SELECT r, unnest(w) AS w0, unnest(range(len(w))) AS a FROM d),
l AS (SELECT r, a, w0, lead(w0) OVER x AS w1, lead(w0, 2) OVER x AS w2, lead(w0, 3) OVER x AS w3 FROM e WINDOW x AS (PARTITION BY r ORDER BY a)),
m AS (SELECT r, a, 2 AS k, w0 || ' ' || w1 AS g FROM l WHERE w1 IS NOT NULL UNION ALL SELECT r, a, 4, w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM l WHERE w3 IS NOT NULL),
v AS (SELECT r, q.t, label, whole, base, n, q.k, a - o AS diag, o, a FROM m JOIN q ON m.g = q.g AND m.k = q.k),
x AS (SELECT *, CASE WHEN lag(diag) OVER w = diag THEN 0 WHEN NOT whole AND diag - lag(diag) OVER w <= {SLACK} THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY r, t ORDER BY diag, o)),
y AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diag, o ROWS UNBOUNDED PRECEDING) AS run FROM x),
s AS (SELECT r, t, label, whole, base, n, run, min(a) AS s, max(a + k) AS e, len(list_distinct(flatten(list(range(o, o + k))))) AS c FROM y GROUP BY ALL),
f AS (SELECT * FROM s WHERE CASE WHEN whole THEN c = n ELSE c >= {COVER} * n AND c >= {DENSE} * (e - s) END)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(d.w)) AS n_words, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(c / n), 0.0) AS score
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r
"""


OP11_SQL = _sql()
