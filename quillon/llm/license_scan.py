"""License scans by an exact set-similarity join; DataFrame functions only.

Text blocks and license templates are sets of pairs of neighbouring words, so that the order of the
words counts; no pair goes over the end of a sentence. Blocks are windows over the pairs of a text,
so that line wraps, comment marks and layout do not matter: a block of step c holds the pairs
[ic, ic + 2c), and every run of c pairs lies inside one. Short templates (one-sentence notices) are
met in blocks of step SHORT, long ones (whole licenses and headers) in blocks of step LONG. A block
matches a template of whose pairs it holds the threshold, and all that tell it from its relatives:
those with a number or one of the words DISTINGUISHING. So a text under CC BY-NC 4.0 does not match
the template of CC BY 4.0, nor that of the other version.

Pairs of the templates are ordered by how many documents of the corpus hold them, rarest first; a
block that reaches the threshold must hold one of the first |T| - need + 1 pairs of a template, so
only blocks with such a pair are candidates (prefix filter); the pairs that can still follow, at
either position, must suffice (positional filter); and the block must hold enough pairs at all
(length filter). Candidates are verified by the intersection itself. No block that meets the
threshold is missed.

A text is cut into words once. What later steps need of it is written as a small table: the pairs
of templates that it holds, from which the corpus counts come, and, where these suffice for a
template (the length filter for the whole text), the template pairs of its blocks.

On top of the join, fixed phrases are counted wherever their words stand consecutively.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Share of a template's pairs that a block must hold, in percent, and the pairs it must hold of short ones (or all).
CONTAINMENT, LEAST = 80, 7
#: What a license is told from its relatives by, besides numbers.
DISTINGUISHING = ("affero", "apache", "general", "isc", "lesser", "library", "mit", "mozilla", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike", "version", "zero")
#: Stands for the end of a sentence; no pair with it is one of a template.
MARK = "\ue000"
#: Steps of the blocks in pairs; a template of at most SHORT words is a short one, none has more than LONG.
SHORT, LONG = 24, 256
#: The phrases of the base labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and text of each license template.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
        IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details."""),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "This work is dedicated to the public domain under Creative Commons Zero CC0"),
)


#: The parts of the Creative Commons labels and their words.
_PARTS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}


def templates() -> list[tuple[str, str]]:
    """TEMPLATES, and both names of every Creative Commons license with attribution in its last two versions."""
    out = list(TEMPLATES)
    for parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        label = "-".join(("cc", "by", *parts))
        for version in ("3.0", "4.0"):
            out.append((label, f"CC BY{''.join('-' + p.upper() for p in parts)} {version}"))
            out.append((label, f"Creative Commons Attribution{''.join('-' + _PARTS[p] for p in parts)} {version}"))
    return out


def need(n: int) -> int:
    """Pairs of a template of n distinct ones that a block must hold."""
    return max(-(-n * CONTAINMENT // 100), min(n, LEAST))


def template_sets() -> list[tuple[str, int, list[str], list[str]]]:
    """(label, step, sorted distinct pairs, those of them that must be there) of every template."""
    out = []
    for label, text in templates():
        words = re.findall(f"[a-z0-9{MARK}]+", re.sub(r"[.!?]\s+([A-Z])", rf" {MARK} \1", text).lower())
        if len(words) > LONG:
            raise ValueError(f"a template of {len(words)} words: {text[:60]}")
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if MARK not in (a, b)})
        out.append((label, SHORT if len(words) <= SHORT else LONG, pairs, [p for p in pairs if any(w in DISTINGUISHING or any(map(str.isdigit, w)) for w in p.split())]))
    return out


def _strings(values) -> F.Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _places(phrase: str, label: str) -> F.Column:
    parts = phrase.split()

    def fits(i: F.Column) -> F.Column:
        test = F.get("words", i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.coalesce(F.get("words", i + k), F.lit("")) == p)
        return test

    none = F.array().cast("array<struct<start:int,label:string>>")
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), fits)
    there = F.forall(_strings(sorted(set(parts))), lambda w: F.array_contains("words", w))
    return F.when(there, F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(none)


def _blocks(step: int, least: int) -> F.Column:
    """The template pairs of each block that holds `least` of them at least."""
    block = lambda c: F.array_intersect(F.col("held"), F.slice("pairs", c * step + 1, F.lit(2 * step)))
    every = F.transform(F.sequence(F.lit(0), F.floor((F.size("pairs") - 1) / step).cast("int")), block)
    return F.filter(every, lambda b: F.size(b) >= least)


def _words(text: F.Column) -> F.Column:
    low = F.translate(text, UPPER + _BETWEEN, LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(low, " "), "")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_words, places (start, label) of the phrases, held (template pairs), and short and long: blocks, null if none can match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.regexp_replace(text, r"[.!?][ \t\n\x0B\f\r]+([A-Z])", f" {MARK} $1")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("row"), _words(text).alias("words"), _words(marked).alias("marked"))
    n = F.greatest(F.size("marked") - 1, F.lit(0))
    rows = rows.withColumn("pairs", F.zip_with(F.slice("marked", F.lit(1), n), F.slice("marked", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))
    vocabulary = sorted({x for _, _, t, _ in template_sets() for x in t})
    rows = rows.withColumn("held", F.array_intersect(_strings(vocabulary), F.col("pairs")))
    kinds = {}
    for _, step, pairs, _ in template_sets():
        kinds.setdefault(step, []).append(pairs)
    columns = {}
    for name, step in (("short", SHORT), ("long", LONG)):
        able = F.exists(F.array(*(F.size(F.array_intersect(F.col("held"), _strings(t))) >= need(len(t)) for t in kinds[step])), lambda x: x)
        columns[name] = F.when(able, _blocks(step, min(need(len(t)) for t in kinds[step])))
    columns["places"] = F.flatten(F.array(*(_places(*p) for p in PHRASES)))
    return rows.withColumns(columns).select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), "places", "held", "short", "long")


def _ordered(rows: DataFrame) -> list[str]:
    """The pairs of the templates, rarest in the corpus first: a row per template pair reaches the driver."""
    vocabulary = sorted({w for _, _, t, _ in template_sets() for w in t})
    count = {r["pair"]: r["count"] for r in rows.select(F.explode("held").alias("pair")).groupBy("pair").count().collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def similar_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, row, label, containment of the templates that a block of a document holds to the threshold."""
    place = {w: i for i, w in enumerate(order)}
    prefix = []
    for n, (label, step, t, must) in enumerate(template_sets()):
        pairs, least = sorted(t, key=place.get), need(len(t))
        prefix += [(w, step, n, label, pairs, must, i, least) for i, w in enumerate(pairs[: len(pairs) - least + 1])]
    keys = rows.sparkSession.createDataFrame(prefix, "pair string, step int, template int, label string, tokens array<string>, must array<string>, i int, need int")
    blocks = [rows.filter(F.size(c) > 0).select("doc_id", "row", F.lit(step).alias("step"), F.posexplode(c).alias("block", "part")) for c, step in (("short", SHORT), ("long", LONG))]
    # The block's template pairs, in the order of the corpus.
    candidates = blocks[0].union(blocks[1]).select("doc_id", "row", "step", "block", F.array_intersect(_strings(order), F.col("part")).alias("part"))
    tried = candidates.select("doc_id", "row", "step", "block", "part", F.posexplode("part").alias("j", "pair")).join(F.broadcast(keys), ["pair", "step"])  # the templates are fixed
    tried = tried.filter((F.size("part") >= F.col("need")) & (1 + F.least(F.size("tokens") - F.col("i") - 1, F.size("part") - F.col("j") - 1) >= F.col("need")))
    shared = F.size(F.array_intersect("part", "tokens"))
    right = F.size(F.array_intersect("part", "must")) == F.size("must")
    return tried.filter((shared >= F.col("need")) & right).select("doc_id", "row", "label", (shared / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    n_base counts the places of the phrases, first_word and last_word are the smallest and the
    largest start (null without a place); labels are distinct, sorted and joined by commas, empty
    if there are none. score is 1 with a phrase, else the largest containment of a template that a
    block reaches, else 0. Null and empty texts have no words. Repeated rows give a row each, a null
    id stays null, other columns are not read.
    """
    rows = _lineage.table(digested(docs, id_col, text_col))
    blocks = similar_blocks(rows, _ordered(rows)).groupBy("doc_id", "row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    out = rows.select("doc_id", "row", "n_words", "places").alias("r").join(blocks.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.row") == F.col("b.row")), "left")
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    starts = F.transform("places", lambda p: p["start"].cast("bigint"))
    every = F.array_sort(F.array_union(labels, F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "r.doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
