"""License scans by diagonal voting, in SQL functions only.

All rolling word k-grams of a text are joined by hash to their positions in the
template texts: pairs for the short base phrases, runs of GRAM words for the other
templates.  A match at text position p and template position q votes for the diagonal
p - q, once its words are seen to be equal.  Diagonals that differ by a few words (an
insertion or deletion) are merged.  A merged span is verified against its template: its
matches must cover enough of the template's words, and enough of its own.  The base
phrases need a diagonal with all their words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import FEW_ROWS, documents

#: Runs of ASCII letters, digits and all else beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a gram of a base phrase and of another template.
PAIR, GRAM = 2, 4
#: Merged diagonals lie at most so many words apart; least covered part of a template, and of the span itself.
GAP, COVER = 3, 0.6

# Fixed values: (label, base phrase or not, template).
TEMPLATES = [
    ("mit", True, "mit license"),
    ("apache", True, "apache license"),
    ("gpl", True, "general public license"),
    ("mit", False, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        False,
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("apache", False, "Licensed under the Apache License, Version 2.0"),
    ("apache", False, "you may not use this file except in compliance with the License"),
    (
        "apache",
        False,
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    ("gpl", False, "licensed under the GNU General Public License version 3"),
    ("gpl", False, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl",
        False,
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    ("lgpl", False, "under the terms of the GNU Lesser General Public License"),
    ("bsd", False, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        False,
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name
        of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        False,
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS.""",
    ),
    ("mpl", False, "subject to the terms of the Mozilla Public License"),
    (
        "mpl",
        False,
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    ("unlicense", False, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc", False, "licensed under CC BY-NC 4.0"),
    ("cc", False, "licensed under a Creative Commons Attribution license"),
]
#: What stands for a text as a whole in the join; no gram is given it.
WHOLE = -1


def _words(text: Column) -> Column:
    """Words, lower case.

    Lowering all of Unicode differs from lowering A to Z in no word of ASCII letters,
    but for the Kelvin sign, which would become a k.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORDS), F.lit(0))


def _gram_key(k: int, at: Column) -> Column:
    """Digest of the ``k`` words from ``at``; at the end of a text fewer, which equal no gram of a template."""
    return F.xxhash64(*(F.get("words", at + i) for i in range(k)))


def _template_grams(spark: SparkSession, templates: list[tuple[str, bool, str]]) -> DataFrame:
    """A row for each gram of each template, and one for whole texts: key, tid, label, base, k, n, q, gram."""
    if short := [t for _, base, t in templates if len(re.findall(WORDS, t)) < (PAIR if base else GRAM)]:
        raise ValueError(f"templates of too few words: {short}")
    given = F.array(*(F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(PAIR if base else GRAM).alias("k"), F.lit(text).alias("text")) for i, (label, base, text) in enumerate(templates)))
    rows = spark.range(1).select(F.inline(given)).withColumn("words", _words(F.col("text"))).withColumn("n", F.size("words"))
    grams = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("q"))
    key = F.when(F.col("k") == PAIR, _gram_key(PAIR, F.col("q"))).otherwise(_gram_key(GRAM, F.col("q")))
    grams = grams.select(key.alias("key"), "tid", "label", "base", "k", "n", "q", F.slice("words", F.col("q") + 1, F.col("k")).alias("gram"))
    whole = spark.range(1).select(F.lit(WHOLE).cast("long").alias("key"), F.lit(WHOLE).alias("tid"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("k"), F.lit(1).alias("n"), F.lit(0).alias("q"), F.array().cast("array<string>").alias("gram"))
    return grams.unionByName(whole)


def _covered(starts: Column, k: Column) -> Column:
    """Number of words that grams of ``k`` words at ascending ``starts`` cover."""
    step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(k, x - acc["at"])).alias("n"))
    return F.reduce(starts, F.struct((F.element_at(starts, 1) - k).alias("at"), F.lit(0).alias("n")), step)["n"]


def scan(docs: DataFrame, templates: list[tuple[str, bool, str]] = TEMPLATES, cover: float = COVER, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of letters and digits after A to Z became lower case; null counts
    as empty.  ``n_base`` counts all places of base phrases; first_word and last_word
    are null without any.  ``spans`` lists (label, start, end, coverage) of the accepted
    spans of all templates; the score is the best coverage, 0 without a span.  Rows are
    scanned each on its own, so repeated rows give repeated results; an empty table
    gives none, and other columns of the input are not carried.  The grams of the
    templates are broadcast while they are few.  Templates may have any length.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words")).select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.monotonically_increasing_id().alias("rid"))
    grams = _template_grams(docs.sparkSession, templates)
    if sum(len(t.split()) for _, _, t in templates) <= FEW_ROWS:
        grams = F.broadcast(grams)
    # A row for each word, and one at -1 for the text; the array of words is looked into, but not copied into them.
    at = F.col("place") - 1
    places = texts.withColumn("places", F.concat(F.array(F.lit("")), "words")).select("rid", "doc_id", "n_words", "words", F.posexplode("places").alias("place", "word"))
    keys = F.when(at < 0, F.array(F.lit(WHOLE).cast("long"))).otherwise(F.array(_gram_key(PAIR, at), _gram_key(GRAM, at)))
    hits = (
        places.select("rid", "doc_id", "n_words", "words", at.alias("p"), F.explode(keys).alias("key"))
        .join(grams, "key")
        .where(F.when(F.col("p") < 0, F.col("tid") == WHOLE).otherwise((F.col("tid") != WHOLE) & (F.slice("words", F.col("p") + 1, F.col("k")) == F.col("gram"))))
        .select("rid", "doc_id", "n_words", "tid", "label", "base", "k", "n", "q", "p", (F.col("p") - F.col("q")).alias("diagonal"))
    )
    # From here on all rows of a text are in one task: a row for the text, and its few hits.
    same = ("doc_id", "n_words", "label", "base", "k", "n")
    votes = hits.repartition("rid").groupBy("rid", "tid", "diagonal").agg(*(F.first(c).alias(c) for c in same), F.collect_set("q").alias("qs"))
    by_diagonal = Window.partitionBy("rid", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal), F.lit(gap + 1)) > F.when(F.col("base"), 0).otherwise(gap)
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(by_diagonal))
    ps = F.transform("qs", lambda q: q + F.col("diagonal"))
    spans = merged.withColumn("ps", ps).groupBy("rid", "tid", "part").agg(
        *(F.first(c).alias(c) for c in same), F.array_sort(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("qs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("ps")
    )
    low, high = F.element_at("ps", 1), F.element_at("ps", -1) + F.col("k")
    spans = spans.select("rid", "tid", *same, low.alias("low"), high.alias("high"), (_covered(F.col("qs"), F.col("k")) / F.col("n")).alias("share"), (_covered(F.col("ps"), F.col("k")) / (high - low)).alias("dense"))
    spans = spans.withColumn("ok", (F.col("tid") != WHOLE) & F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= cover) & (F.col("dense") >= cover)))
    base = F.col("ok") & F.col("base")
    names = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("label")))), ",")
    return spans.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("label", F.col("low").alias("start"), F.col("high").alias("end"), F.col("share").alias("coverage"))))).alias("spans"),
    ).drop("rid")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")


def _oracle() -> str:
    values = ", ".join(f"({i}, '{label}', {str(base).lower()}, {PAIR if base else GRAM}, {[w.lower() for w in re.findall(WORDS, text)]!r})" for i, (label, base, text) in enumerate(TEMPLATES))
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    covered = lambda c: f"k + coalesce(list_sum(list_transform({c}[2:], lambda x, i: least(k, x - {c}[i]))), 0)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lowered}, '{WORDS}') AS w FROM documents
), t(tid, label, base, k, tw) AS (VALUES {values}
), tp AS (
  SELECT tid, label, base, k, len(tw) AS n, q, array_to_string(tw[q + 1 : q + k], ' ') AS gram
  FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS q FROM t)
), dw AS (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), dp AS (
  SELECT rid, p, word || {" || ".join(f"' ' || lead(word, {i}) OVER o" for i in range(1, PAIR))} AS pair, word || {" || ".join(f"' ' || lead(word, {i}) OVER o" for i in range(1, GRAM))} AS run
  FROM dw WINDOW o AS (PARTITION BY rid ORDER BY p)
), h AS (
  SELECT rid, p, tp.* FROM dp JOIN tp ON run = gram AND k = {GRAM}
  UNION ALL SELECT rid, p, tp.* FROM dp JOIN tp ON pair = gram AND k = {PAIR}
), v AS (
  SELECT rid, tid, p - q AS diagonal, label, base, k, n, list(q) AS qs, list(p) AS ps FROM h GROUP BY ALL
), m AS (
  SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER o, {GAP + 1}) > CASE WHEN base THEN 0 ELSE {GAP} END THEN 1 ELSE 0 END AS apart
  FROM v WINDOW o AS (PARTITION BY rid, tid ORDER BY diagonal)
), g AS (
  SELECT *, sum(apart) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS part FROM m
), s AS (
  SELECT rid, tid, part, label, base, k, n, list_sort(list_distinct(flatten(list(qs)))) AS qs, list_sort(list_distinct(flatten(list(ps)))) AS ps
  FROM g GROUP BY rid, tid, part, label, base, k, n
), c AS (
  SELECT *, ps[1] AS low, ({covered("qs")}) / n::DOUBLE AS share, ({covered("ps")}) / (ps[-1] + k - ps[1])::DOUBLE AS dense FROM s
), k AS (
  SELECT * FROM c WHERE CASE WHEN base THEN share = 1 ELSE share >= {COVER} AND dense >= {COVER} END
), a AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM k GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (rid)
"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": _oracle()}
