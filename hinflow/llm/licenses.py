"""Licence scan by diagonal voting (operator 8, built-in functions only).

Templates and documents are cut into rolling word k-grams: pairs for the short
phrases, WIDE words for licence notices and full texts. Every k-gram of a
document that also occurs in a template votes for the diagonal (document
position minus template position). Votes are aggregated by diagonal; diagonals
of a template that lie within DRIFT words of their neighbour, and within SPREAD
of the first of their group, are merged, which bridges words put in or left
out; a merged span is verified by the share of the template's k-grams that it
holds. Votes compare 96 bits of hash of the k-gram's words.

A phrase counts where all its pairs vote for one diagonal, that is, where its
words stand consecutively.

Plan: k-grams are exploded and joined with the template positions by hash in
the task that reads the text; the templates are a table of at most MAX_GRAMS
k-grams, and so broadcast. What is shuffled is votes, aggregated before by
document and diagonal, so no task holds more than a document's own. A second
pass over the table counts words.

Defined results: a null or empty text has no words and no labels; repeated rows
are scanned each for itself; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bind, locator, lower_ascii

#: Phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Wording of common licence notices and the label that the method adds.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Full licence texts, and the notices that licences ask for.
FULL = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
    BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit-full"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
    COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
    BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE.""", "bsd-full"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
    IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc-full"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
    purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
    restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
    software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
    is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
    original software. 3. This notice may not be removed or altered from any source distribution.""", "zlib-full"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
    this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
    the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
    overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""", "unlicense-full"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
    law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
    OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
    limitations under the License.""", "apache-2.0-notice"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details. You should have received a copy of the GNU General Public License along with this program. If not, see
    https://www.gnu.org/licenses/.""", "gpl-3.0-notice"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "mpl-2.0-notice"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
    transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
    is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
    including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
    Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely
    in the form of machine-executable object code generated by a source language processor.""", "bsl-1.0-full"),
)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PAIR, WIDE = 2, 4
DRIFT, SPREAD = 2, 16
SHARE = 0.75
MAX_GRAMS = 100_000


def scan_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _hashes(words: list[Column]) -> tuple[Column, Column]:
    """Two hashes of a k-gram, 96 bits together, that stand for its words."""
    return F.xxhash64(*words).alias("h"), F.hash(*words).alias("g")


def rolled(words: Column, width: int) -> Column:
    """(h, g, pos) of all k-grams of ``width`` words."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(*_hashes([F.get(words, i + k) for k in range(width)]), i.alias("pos")))
    return F.when(F.size(words) >= width, grams).otherwise(F.array().cast("array<struct<h:bigint,g:int,pos:int>>"))


def template_grams(spark: SparkSession, phrases=PHRASES, texts=(*TEXTS, *FULL)) -> DataFrame:
    """(template, label, phrase, width, tpos, grams, h, g), one row per k-gram."""
    rows = []
    for t, (wording, label, width) in enumerate([*((*p, PAIR) for p in phrases), *((*x, WIDE) for x in texts)]):
        words = [w for w in re.split(GAP, wording.lower()) if w]
        n = len(words) - width + 1
        rows += [(t, label, width == PAIR, width, i, words[i : i + width], n) for i in range(n)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"templates have {len(rows)} k-grams; at most {MAX_GRAMS} are broadcast")
    grams = spark.createDataFrame(rows, "template int, label string, phrase boolean, width int, tpos int, gram array<string>, grams int")
    of = lambda width: _hashes([F.get("gram", F.lit(k)) for k in range(width)])
    h, g = (F.when(F.col("width") == PAIR, a).otherwise(b) for a, b in zip(of(PAIR), of(WIDE), strict=True))
    return grams.withColumn("h", h).withColumn("g", g).drop("gram")


def _votes(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """(file, row, pos, and the template's columns): k-grams of the documents that are a template's too."""

    grams_of = bind(scan_words(F.col(text_col)), lambda w: F.concat(rolled(w, PAIR), rolled(w, WIDE)))
    cast = docs.select(*locator(), F.explode(grams_of).alias("v")).select("file", "row", "v.*")
    return cast.join(F.broadcast(grams), ["h", "g"])


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=(*TEXTS, *FULL)) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row of ``docs``, a plain read.

    ``spans`` lists (label, start, end, share) of all verified spans.
    """
    grams = template_grams(docs.sparkSession, phrases, texts)
    rows = docs.select(F.col(id_col).alias("id"), *locator(), F.size(scan_words(F.col(text_col))).cast("long").alias("n_words"))
    votes = _votes(docs, grams, text_col)
    key = ["file", "row", "template"]
    diagonal = votes.groupBy(*key, "label", "phrase", "grams", "width", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("at")
    )
    order = W.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT), F.lit(True))
    chained = diagonal.withColumn("chain", F.sum(apart.cast("int")).over(order))
    first = F.min("diagonal").over(W.partitionBy(*key, "chain"))
    merged = chained.withColumn("group", F.struct("chain", F.floor((F.col("diagonal") - first) / (SPREAD + 1)))).groupBy(*key, "label", "phrase", "grams", "width", "group").agg(
        F.min("lo").alias("start"), (F.max("hi") + F.first("width")).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held")
    )
    share = F.col("held") / F.col("grams")
    spans = merged.where(F.when(F.col("phrase"), F.col("held") == F.col("grams")).otherwise(share >= SHARE)).withColumn("share", share)
    base = F.col("phrase")
    told = spans.groupBy("file", "row").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("label", "start", "end", "share"))).alias("spans"),
    )
    out = rows.select("id", "file", "row", "n_words").join(told, ["file", "row"], "left")
    return out.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
