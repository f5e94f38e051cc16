"""Licence scans, in DataFrame operations only.

The lines of a text, its paragraphs and the whole text are compared with templates by the cosine of sparse TF-IDF
vectors; document frequencies of the templates' words are counted over all texts. Templates are notices of one
sentence and whole licence texts. A document takes the best template that any of its parts reaches ``threshold``
with. A document that is mostly licence text, by its lines, its paragraphs or as a whole, is the licence file of its
directory; documents without a licence of their own take that of the nearest ancestor directory that has one. Where
paths are not those of files, ``file_words`` asks for more: only parts of so many words that reach a template of
so many count as licence text, so that a short notice licenses its own document and no other. Tables without paths pass nothing on.

No part is left out by a pattern. A cosine is at most the root of the squared weights of the template's words that
the part has. So the commonest words of a template, as many as stay below ``threshold`` together, are not enough, and
a part that reaches it has one of the others. Texts that hold none of these for any template are not taken apart;
that loses nothing.

Defined results: a null text has no lines; a null or empty path has the root as its only directory; rows
that repeat are scanned each; equal scores go to the template first in alphabet; several licence files in a
directory: the best score, then the first template; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.shared import small_side, written

# Public licence texts, and notices that refer to them.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details. You should have received a copy of the GNU {} Public License along with this program. If not, see https://www.gnu.org/licenses/."
TEMPLATES = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", _FREE.replace("{}", "Affero General"), "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [f"{_BSD} {_HOLDERS}", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", f"{_BSD} {_ENDORSE} {_HOLDERS}", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", _FREE.replace("{}", "General"), "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": [f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3", _FREE.replace("{}", "Lesser General"), "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "all-rights-reserved": ["All rights reserved", "Copyright, all rights reserved"],
}
SPLIT, PARAGRAPHS = r"[^\p{L}\p{N}.-]+", r"\n[ \t\r]*\n"
THRESHOLD, FILE_SHARE = 0.6, 0.5
#: Words that whole licence texts and standard notices have at least, and notices of one sentence never.
TEXT_WORDS = 30


def words(text: Column) -> Column:
    """Lower-case words without the full stops around them."""
    bare = F.transform(F.split(F.lower(text), SPLIT, -1), lambda w: F.btrim(w, F.lit(".-")))
    return F.filter(bare, lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in (re.sub(r"^[.-]+|[.-]+$", "", p) for p in re.split(r"[^\w.-]+", text.lower())) if w]


def needed_words(weights: dict[str, float], held_by: dict[str, int], threshold: float) -> set[str]:
    """The words of a template of which any part that reaches ``threshold`` has one.

    ``weights`` are those of a unit vector. The commonest words are left out, as long as they alone cannot reach it.
    """
    out, rest = set(), 0.0
    for w in sorted(weights, key=lambda w: (-held_by.get(w, 0), w)):
        rest += weights[w] ** 2
        # a little slack for rounding
        if rest >= threshold**2 - 1e-6:
            out.add(w)
    return out


def scanned(docs: DataFrame, path: Column | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, known: dict[str, list[str]] | None = None, file_words: int = 0) -> DataFrame:
    """``(doc_id, licence, cosine, source, directory)``; ``source``: own, inherited or none.

    ``path`` is None where documents have no paths: none inherits. ``known``: licences and their templates, if not
    ``TEMPLATES``. ``file_words``: words, at least, of the parts and
    templates that make a licence file.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), (F.lit("") if path is None else F.coalesce(path, F.lit(""))).alias("path"), text.alias("text"))
    forms = [(name, i, template_words(t)) for name, ts in (known or TEMPLATES).items() for i, t in enumerate(ts)]
    vocabulary = sorted({w for *_, ws in forms for w in ws})

    # the words of every text, counted once; and which of the templates' words it has
    own_words = source.select("doc_id", "path", F.xxhash64("text").alias("rk"), words(F.col("text")).alias("ws"))
    hits = F.array_intersect("ws", F.array(*map(F.lit, vocabulary)))
    seen = written(own_words.select("doc_id", "path", "rk", F.size("ws").alias("n_words"), hits.alias("hits")), "licence-words")
    counted = {r["w"]: r["count"] for r in seen.select(F.explode("hits").alias("w")).groupBy("w").count().collect()}  # at most one row a word of the templates
    total = seen.count()
    idf = {w: math.log((1 + total) / (1 + counted.get(w, 0))) + 1 for w in vocabulary}
    rare = math.log(1 + total) + 1  # words of no template
    rows, needed = [], set()
    for name, i, ws in forms:
        weights = {w: ws.count(w) * idf[w] for w in ws}
        size = math.sqrt(sum(v * v for v in weights.values()))
        rows += [(name, i, len(ws) >= file_words, w, v / size) for w, v in sorted(weights.items())]
        needed |= needed_words({w: v / size for w, v in weights.items()}, counted, threshold)
    templates = spark.createDataFrame(rows, "licence string, form int, full boolean, w string, share double")
    idfs = spark.createDataFrame([(w, v) for w, v in idf.items()], "w string, idf double")

    # texts with one of the words that a match needs, taken apart
    some = F.array(*map(F.lit, sorted(needed)))
    chosen = written(seen.where(F.arrays_overlap("hits", some)).select("rk").distinct(), "licence-texts")
    texts = source.withColumn("rk", F.xxhash64("text")).join(small_side(chosen, 16), "rk", "left_semi").distinct()
    lines, paragraphs = F.split("text", "\n", -1), F.split("text", PARAGRAPHS, -1)

    def parts(kind: int, made: Column) -> Column:
        return F.transform(made, lambda t, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), t.alias("part")))

    # a paragraph of one line and a text of one paragraph are compared once
    larger = F.filter(parts(1, paragraphs), lambda p: F.contains(p["part"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, parts(2, F.array("text"))).otherwise(F.slice(larger, 1, 0))
    pieces = texts.select("doc_id", "path", "rk", F.explode(F.concat(parts(0, lines), larger, whole)).alias("p")).select("doc_id", "path", "rk", "p.kind", "p.n", words(F.col("p.part")).alias("ws"))
    pieces = written(pieces.where(F.arrays_overlap("ws", some)), "licence-parts")
    key = ["doc_id", "path", "rk", "kind", "n"]
    tf = pieces.select(*key, F.explode("ws").alias("w")).groupBy(*key, "w").agg(F.count("*").alias("tf"))
    # the templates and their words are fixed tables of a few hundred rows
    tf = written(tf.join(F.broadcast(idfs), "w", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(rare))), "licence-weights")
    sizes = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"), F.sum("tf").alias("n_words"))
    dots = tf.join(F.broadcast(templates), "w").groupBy(*key, "licence", "form", "full").agg(F.sum(F.col("v") * F.col("share")).alias("dot"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
    scored = dots.alias("d").join(sizes.alias("s"), same)
    scored = scored.select(*(f"d.{k}" for k in key), "licence", "full", "n_words", F.round(F.col("dot") / F.col("size"), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    by_part = scored.groupBy(*key, "n_words").agg(best.alias("b"), F.max("full").alias("full"))
    by_kind = by_part.groupBy("doc_id", "path", "rk", "kind").agg(F.min("b").alias("b"), F.sum(F.when(F.col("full") & (F.col("n_words") >= file_words), F.col("n_words"))).alias("licence_words"))
    own = by_kind.groupBy("doc_id", "path", "rk").agg(F.min("b").alias("b"), F.max("licence_words").alias("licence_words"))
    own = written(own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), F.col("rk").alias("own_rk"), F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), "licence_words"), "licensed")

    match = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path")) & (F.col("rk") == F.col("own_rk"))
    keyed = written(seen.join(small_side(own, 120), match, "left").select("doc_id", "path", "n_words", "licence", "cosine", "licence_words"), "scanned")
    if path is None:
        origin = F.when(F.col("licence").isNotNull(), "own").otherwise("none")
        return keyed.select("doc_id", "licence", "cosine", origin.alias("source"), F.lit(None).cast("string").alias("directory"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = keyed.where((F.col("licence_words") >= FILE_SHARE * F.col("n_words")) & F.col("licence").isNotNull())
    files = files.groupBy(folder.alias("directory")).agg(best.alias("b")).select("directory", F.col("b.licence").alias("lic"), (-F.col("b.c")).alias("cos"))
    files = written(files, "licence-files")

    # nearest ancestor: every directory above a document, deepest first
    open_ = keyed.where("licence is null").select(folder.alias("at")).distinct()
    steps = open_.select("at", F.posexplode(_ancestors("at")).alias("up", "directory"))
    nearest = steps.join(small_side(files, 120), "directory").groupBy("at").agg(F.min(F.struct("up", "directory", "lic", "cos")).alias("m"))
    nearest = written(nearest.select("at", "m.directory", "m.lic", "m.cos"), "nearest")
    out = keyed.withColumn("at", folder).join(small_side(nearest, 160), "at", "left")
    owns = F.col("licence").isNotNull()
    origin = F.when(owns, "own").when(F.col("lic").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", F.coalesce("licence", "lic").alias("licence"), F.coalesce("cosine", "cos").alias("cosine"), origin.alias("source"), F.when(~owns, F.col("directory")).alias("directory"))


def _ancestors(column: str) -> Column:
    """A directory and all above it, the root last."""
    parts = F.split(F.col(column), "/", -1)
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.array_distinct(F.concat(up, F.array(F.lit(""))))
