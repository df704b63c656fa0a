"""License scan by diagonal voting, with DataFrame operations only.

Every run of GRAM words of a document is joined by hash with the runs of the templates (a constant, broadcast table). A match
of document place p and template place t votes for the diagonal p - t; votes are gathered by diagonal before the shuffle and
written once, neighbouring diagonals are merged (inserted or missing words shift a license text by a few places), and a merged
span counts if the template's places that it covers are enough and it isn't much longer. Templates may be of any length. A base phrase is a template that must be met in full on one
diagonal, which is the same as its words standing consecutively.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.store import written

#: Words of a run; share of a template's runs that a span must cover; words that it may have besides, at least and as a share of the
#: template's; diagonals that are merged: those as far apart as such words shift them, NEAR at least.
GRAM, NEAR, COVER, SLACK, SLACK_SHARE = 3, 2, 0.8, 4, 0.1
#: The phrases that always count, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Notices and opening sentences of public licenses.
SENTENCES = [
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Whole texts of public licenses, and the whole notices of those that are applied by a notice.
TEXTS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]
TEMPLATES = SENTENCES + TEXTS
#: Characters between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN, -1), "")


def grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(label, template, base, runs, t, g1, g2, g3): all runs of all templates, a small constant table."""
    rows = []
    for base, found in ((True, phrases), (False, templates)):
        for k, (label, text) in enumerate(found):
            own = [w for w in re.split(BETWEEN, text.lower()) if w]
            n = len(own) - GRAM + 1
            if n < 1:
                raise ValueError(f"a template has {GRAM} words at least: {text!r}")
            rows += [(label, f"{int(base)}:{k}", base, n, t, *own[t : t + GRAM]) for t in range(n)]
    return spark.createDataFrame(rows, "label string, template string, base boolean, runs int, t int, " + ", ".join(f"g{k} string" for k in range(GRAM)))


def _hash(names: list[str]) -> Column:
    return F.xxhash64(*names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is 1 with a base phrase, else the best covered share of a template, 0 without any match. Null, empty and wordless
    texts have no words, places or labels ("" for no labels). Repeated rows are each reported with their own places, rows
    without an id are scanned like others, an empty table gives no rows, and columns besides the two are never read. A phrase
    that stands for several labels counts once for each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sized = rows.select("doc_id", F.xxhash64("text").alias("h"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    names = [f"w{k}" for k in range(GRAM)]
    shifted = F.arrays_zip(*[(F.col("w") if k == 0 else F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0)))).alias(n) for k, n in enumerate(names)])
    runs = rows.select("doc_id", F.xxhash64("text").alias("h"), word_array(F.col("text")).alias("w")).where(F.size("w") >= GRAM)
    runs = runs.select("doc_id", "h", F.posexplode(shifted).alias("p", "z")).select("doc_id", "h", "p", *[F.col(f"z.{n}").alias(n) for n in names]).where(F.col(names[-1]).isNotNull())
    known = grams(docs.sparkSession, phrases, templates).withColumn("key", _hash([f"g{k}" for k in range(GRAM)]))
    met = runs.withColumn("key", _hash(names)).join(F.broadcast(known), "key")
    for k, n in enumerate(names):
        met = met.where(F.col(n) == F.col(f"g{k}"))
    # votes by diagonal: the template's places, as a set, so that repeated rows don't count twice; a template bounds it
    diagonals = (
        met.groupBy("doc_id", "h", "template", "label", "base", "runs", (F.col("p") - F.col("t")).alias("d"))
        .agg(F.collect_set("t").alias("places"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    )
    diagonals = written(diagonals, "diagonals")
    full = F.size("places") == F.col("runs")
    order = Window.partitionBy("doc_id", "h", "template").orderBy("d")
    group = F.sum(F.when(F.col("d") - F.lag("d").over(order) <= F.greatest(F.lit(NEAR), F.floor(F.col("runs") * SLACK_SHARE)), 0).otherwise(1)).over(order)
    spans = (
        diagonals.where("not base")
        .withColumn("group", group)
        .groupBy("doc_id", "h", "template", "label", "runs", "group")
        .agg((F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.col("runs")).alias("cover"), (F.max("p1") - F.min("p0") + GRAM).alias("span"))
    )
    slack = F.greatest(F.lit(SLACK), F.floor(F.col("runs") * F.lit(SLACK_SHARE)))
    fits = (F.col("cover") >= COVER) & (F.col("span") <= F.col("runs") + GRAM - 1 + slack)
    phrase = diagonals.where("base").where(full).select("doc_id", "h", F.col("d").alias("place"), F.col("label").alias("base_label"), "label", F.lit(1.0).alias("share"))
    method = spans.select("doc_id", "h", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("base_label"), F.when(fits, F.col("label")).alias("label"), F.least("cover", F.lit(1.0)).alias("share"))
    found = phrase.union(method).groupBy("doc_id", "h").agg(
        F.count("place").alias("n_base"),
        F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set("base_label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    found = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *[c for c in found.columns if c not in ("doc_id", "h")])
    out = sized.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
