"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined in Spark to the
positions of the same k-grams in license templates, and the words themselves
must be equal too, so a vote stands for words that were read. A match votes for
a diagonal, its place in the text less its place in the template; votes are
summed by diagonal, neighbouring diagonals (words put in or left out) are
merged, and the spans are verified: a base phrase must have every k-gram of
its words on one diagonal, a template a share of its distinct k-grams.

Templates are short notices and whole license texts. Their table is a fixed list
of this module, of some thousand rows whatever the input, which bounds what is
broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk

K = 3
#: Diagonals of a template no further apart than this belong to one span.
NEIGHBOURS = 3
#: Share of a template's k-grams that a span needs.
COVERAGE = 0.6

# The base phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Sentences of well-known public licenses and notices, and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
]

# Whole texts of public licenses, and the notices that others ask for.
TEXTS = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd-2",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    ),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
]

_SENTINEL = -1
_SCHEMA = "row long, doc_id long, at long, hash long, words string"


def _normal(text: str) -> str:
    """A template's words as they are joined."""
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


#: (words, label) of all templates; the base phrases come first.
_ALL = [*PHRASES, *TEMPLATES, *[(_normal(text), label) for label, text in TEXTS]]


def _gram_words(found: tk.Words, at: np.ndarray) -> pa.Array:
    """The K words from each place on, with a blank between two."""
    lengths = found.ends - found.starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=offsets[1:])
    plain = np.full(int(offsets[-1]), 32, np.uint8)
    inside = np.repeat(found.starts - offsets[:-1], lengths) + np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(inside)) + np.repeat(np.arange(len(lengths)), lengths)
    plain[within] = found.buf[inside - np.repeat(np.arange(len(lengths)), lengths) + within]
    first, sizes = offsets[at], offsets[at + K] - 1 - offsets[at]
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    data = plain[np.repeat(first - ends[:-1], sizes) + np.arange(int(ends[-1]))]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())


def _grams_of(text: str) -> list[tuple[int, int, str]]:
    """(place, hash, words) of a template's k-grams."""
    found = tk.words(next(tk.slices(pa.array([text]))), tk.NOT_ALNUM, lower=True)
    _, at, key = tk.grams(found, K)
    return list(zip(at.tolist(), key.view(np.int64).tolist(), _gram_words(found, at).to_pylist()))


def template_table(spark: SparkSession) -> DataFrame:
    """(template, t_at, hash, words) of all templates; one more row keeps the texts' own rows in the join."""
    rows = [(_SENTINEL, 0, 0, "")]
    for i, (text, _) in enumerate(_ALL):
        rows += [(i, *x) for x in _grams_of(text)]
    return spark.createDataFrame(rows, "template int, t_at long, hash long, words string")


def text_grams(docs: DataFrame) -> DataFrame:
    """All rolling k-grams of docs (row, doc_id, text), and for each row one entry, without words, with its number of words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch.column("text")):
                found = tk.words(part, tk.NOT_ALNUM, lower=True)
                doc, at, key = tk.grams(found, K)
                words = _gram_words(found, found.firsts[doc] + at)
                n = len(part)
                own = pa.array(part.first + np.concatenate([np.arange(n), doc]))
                key = np.concatenate([np.zeros(n, np.uint64), key]).view(np.int64)
                cols = [batch.column("row").take(own), batch.column("doc_id").take(own), pa.array(np.concatenate([found.counts, at])), pa.array(key), pa.concat_arrays([pa.array([""] * n, pa.string()), words])]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.mapInArrow(split, _SCHEMA)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in each row's text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best span's share of its template), and spans (label, first and
    last word, share). Null and empty texts have no words and no labels (empty
    strings) and score 0. Repeated rows are each returned; overlapping phrases
    all count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # rows of one id and text have one key, in every run
    text = F.col(text_col)
    grams = text_grams(docs.select(F.xxhash64(F.col(id_col), text.isNull(), text).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")))
    # a constant table of this module, of fixed size
    votes = grams.join(F.broadcast(template_table(spark)), ["hash", "words"])
    diagonals = votes.groupBy("row", "doc_id", "template", F.when(F.col("template") == _SENTINEL, F.lit(0)).otherwise(F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("t_at").alias("covered"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    sizes = F.array(*[F.lit(len(t.split()) - K + 1) for t, _ in _ALL])
    labels = F.array(*[F.lit(label) for _, label in _ALL])
    is_phrase = F.col("template").between(0, len(PHRASES) - 1)
    by_place = Window.partitionBy("row", "template").orderBy("diagonal")
    # neighbouring diagonals of a template are one span; those of phrases stay apart, as each is a place
    gap = F.col("diagonal") - F.lag("diagonal").over(by_place)
    fresh = F.when(is_phrase | gap.isNull() | (gap > NEIGHBOURS), 1).otherwise(0)
    spans = diagonals.withColumn("island", F.sum(fresh).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy("row", "doc_id", "template", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("diagonal"), F.max("votes").alias("votes")
    )
    size = F.element_at(sizes, F.greatest(F.col("template"), F.lit(0)) + 1)
    spans = spans.withColumn("share", F.col("covered") / size).withColumn("label", F.element_at(labels, F.greatest(F.col("template"), F.lit(0)) + 1))
    own = F.col("template") == _SENTINEL
    good = F.when(own, F.lit(False)).when(is_phrase, F.col("share") >= 1.0).otherwise(F.col("share") >= COVERAGE)
    base, any_label = good & is_phrase, F.when(good, F.col("label"))
    text_of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("row", "doc_id").agg(
        F.max(F.when(own, F.col("votes"))).alias("n_rows"),
        F.max(F.when(own, F.col("last"))).alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        text_of(F.when(base, F.col("label"))).alias("base_labels"),
        text_of(any_label).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).cast("double").alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("label", F.col("first").alias("first_word"), (F.col("last") + K - 1).alias("last_word"), "share")))).alias("spans"),
    )
    return found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("row", "n_rows", "nth")
