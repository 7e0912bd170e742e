"""License scan by diagonal voting (op 9).

Word k-grams of all texts are joined, by hash and then word by word, to those
of the templates: bigrams of phrases, 4-grams of whole license texts (``LONG``
words or more, whose bigrams are too common). A hit votes for the diagonal (text
position minus template position) on which a copy of the template would lie;
votes are or-ed per diagonal as bit masks of 64 template positions each, so that
they count once however often they come and a template may have any length.

Neighbouring diagonals, ``GAP`` words apart or a few more for long templates, are
merged into one candidate, as words inserted or left out move a copy from one to
the next. A candidate's span is then verified from both sides: its votes must
cover ``COVER`` of the template, and its hits as much of the span's words. A
base phrase is at a place if its own diagonal has every vote, which verifies it
word by word. Labels, spans and scores come back per row.

Only DataFrame functions are used; the templates are a fixed table of a few
thousand words and are broadcast. Nothing groups by anything larger than a text.

Cases: a null text counts as empty and has 0 words, no label and score 0;
repeated rows get equal results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that count wherever their words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The method's own templates (words as this module splits them).
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license as published by the free software foundation": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "released into the public domain": "public-domain",
}
#: Whole license texts, as published.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE
IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received
a copy of the GNU General Public License along with this program.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}
#: Share of a template, and of a candidate's span, that must be covered.
COVER = 0.8
#: Words between neighbouring diagonals; one more for GAP_A_WORD of a template.
GAP, GAP_A_WORD = 2, 32
#: Words of a gram, by the template's length.
SHORT_GRAM, LONG_GRAM, LONG = 2, 4, 40

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(plain, _BREAK), lambda w: w != "")


def split_words(text: str) -> list[str]:
    """``words_of`` of a template."""
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return [w for w in re.split(_BREAK, low) if w]


def templates(own: dict[str, str] | None = None) -> list[tuple[bool, str, list[str]]]:
    """(base, label, words) of all templates; ``own`` adds texts by label."""
    more = [(v, k) for k, v in {**TEXTS, **(own or {})}.items()]
    return ([(True, label, split_words(p)) for p, label in BASE.items()]
            + [(False, label, split_words(p)) for p, label in [*TEMPLATES.items(), *more]])


def template_grams(spark: SparkSession, own: dict[str, str] | None = None) -> DataFrame:
    """template, label, base, size (words of a gram), need (votes), t_pos and
    the gram's words of every template position."""
    rows = []
    for number, (base, label, words) in enumerate(templates(own)):
        k = LONG_GRAM if len(words) >= LONG else SHORT_GRAM
        need = len(words) - k + 1
        rows += [(number, label, base, k, need, i, words[i: i + k]) for i in range(need)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, need int, t_pos int, t_words array<string>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, and spans: the label, first and last
    word and score of all verified copies of templates. ``own`` adds template
    texts by label."""
    spark = docs.sparkSession
    t = template_grams(spark, own).withColumn("t_hash", F.xxhash64(*[F.get("t_words", i) for i in range(LONG_GRAM)]))
    known = {k: [r.t_hash for r in t.where(F.col("size") == k).select("t_hash").distinct().collect()] for k in (SHORT_GRAM, LONG_GRAM)}  # of the fixed templates
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), words_of(F.col("text")).alias("words"))

    def grams(k: int) -> Column:
        """Places whose k-gram has a template gram's hash, with its words."""
        every = F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *[F.get(F.col("words"), i + j) for j in range(1, k)],
                                                                                    *[F.lit(None).cast("string")] * (LONG_GRAM - k)).alias("hash")))
        hits = F.filter(every, lambda x: x["hash"].isin(known[k]))
        return F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), F.slice(F.col("words"), x["pos"] + 1, k).alias("g")))

    found = rows.select("doc_id", "tie", F.inline(F.concat(grams(SHORT_GRAM), grams(LONG_GRAM))))
    hits = found.join(F.broadcast(t), (F.col("hash") == F.col("t_hash")) & (F.col("g") == F.col("t_words")))
    key = ["doc_id", "tie", "template"]
    vote = F.expr("shiftleft(1L, t_pos % 64)")
    lines = hits.withColumn("diagonal", F.col("pos") - F.col("t_pos")).groupBy(*key, "diagonal", (F.col("t_pos") / 64).cast("int").alias("chunk")).agg(
        F.bit_or(vote).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        *[F.first(c).alias(c) for c in ("label", "base", "size", "need")])

    phrases = lines.where("base").select("doc_id", "tie", "label", F.col("diagonal").cast("long").alias("first"), (F.col("diagonal") + F.col("need")).cast("long").alias("last"),
                                         "base", F.when(F.bit_count("votes") == F.col("need"), 1.0).otherwise(0.0).alias("score"))
    along = Window.partitionBy(*key).orderBy("diagonal", "chunk")
    gap = GAP + F.floor(F.col("need") / GAP_A_WORD)
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int"), F.lit(0))
    merged = lines.where("not base").withColumn("begins", begins).withColumn("group", F.sum("begins").over(along))
    # a chunk's votes of all merged diagonals, then the whole candidate
    merged = merged.groupBy(*key, "group", "chunk").agg(F.bit_count(F.bit_or("votes")).alias("covered"), F.sum(F.bit_count("votes")).alias("hits"),
                                                        F.min("first").alias("first"), F.max("last").alias("last"), *[F.first(c).alias(c) for c in ("label", "size", "need")])
    merged = merged.groupBy(*key, "group").agg(F.sum("covered").alias("covered"), F.sum("hits").alias("hits"), F.min("first").alias("first"),
                                               (F.max("last") + F.max("size") - 1).alias("last"), *[F.first(c).alias(c) for c in ("label", "size", "need")])
    of_text = F.least(F.lit(1.0), (F.col("hits") + F.col("size") - 1) / (F.col("last") - F.col("first") + 1))
    copies = merged.select("doc_id", "tie", "label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.lit(False).alias("base"),
                           F.least(F.col("covered") / F.col("need"), of_text).alias("score"))
    whole, ok = F.col("base") & (F.col("score") == 1), F.col("score") >= COVER
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")  # noqa: E731  a few labels at most
    by_doc = phrases.unionByName(copies).groupBy("doc_id", "tie").agg(
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("first"))).alias("first_word"), F.max(F.when(whole, F.col("first"))).alias("last_word"),
        joined(whole).alias("base_labels"), joined(ok).alias("labels"), F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.when(ok, F.struct("first", "last", "label", "score")))).alias("spans"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_d", "tie": "_t"})
    sizes = rows.select("doc_id", "tie", F.size("words").cast("long").alias("n_words"))
    out = sizes.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")), "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint,label:string,score:double>>")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"))
