"""Licence scans: TF-IDF cosine of headers and licence files to templates, inherited along directories.

1. Document frequencies are counted over all documents: of the templates' terms first, then of every other term
   that a candidate holds, so that any word weighs what it weighs in this corpus.
2. Candidates are lines (possible headers), windows of neighbouring words (a notice wrapped over lines or inside
   a longer line) and, if the path names a licence file, the whole text. A text can only reach ``least`` similarity
   to a template if it holds one of the template's distinctive terms (without those, what is left of the
   template's weight is too little), so lines without any are left out. Every window as long as a notice is looked
   at, those that reach over an end of the text too. No window is more similar to a notice than the weight of the notice's
   terms that it holds, so texts, stretches of two notices' length and windows that hold too little of it are left out.
3. Candidates are sparse vectors: rows (candidate, term, count), joined with the templates' weights, a table of a
   few hundred rows, and summed per candidate and template. Lines and windows are compared with notices, files also
   with the bodies of licences.
4. A document whose best candidate reaches ``least`` has that licence. If its name says that it is a licence file, it
   also speaks for its directory; a directory has the licence that most of its licence files state.
5. Other documents inherit from the nearest directory above them that has a licence: the distinct directories
   are joined with their ancestors by path, so no large directory is gathered anywhere, and documents are
   dealt out by directory and a salt.

Defined results: null or empty texts have no licence of their own; a null path has no directory and inherits
nothing; ties go to the more similar (to nine digits), then the earlier first line, then the lesser licence name; repeated
rows are scanned each; other columns are not read; an empty table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import BROADCAST_IDS, stored, text_of

LEAST = 0.6
#: Rarest terms of a notice by which the SQL lays its windows; ``scan`` lays all of them.
SEEDS = 3
#: Parts of a hot term or directory.
SALTS = 16
#: Names of licence files.
FILE_NAME = r"(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"
#: Short notices by licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Available under the Creative Commons Attribution-ShareAlike License 4.0."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

#: Licence texts by licence, compared with whole licence files.
BODIES: dict[str, tuple[str, ...]] = {
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain.",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution.",
    ),
}


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def term_list(notice: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in notice.lower()).split()


def template_terms(notice: str) -> Counter:
    return Counter(term_list(notice))


def inverse_frequency(held: int, n: int) -> float:
    return math.log((n + 1) / (held + 1)) + 1


def distinctive(weights: dict[str, float], least: float) -> set[str]:
    """Terms without any of which no text reaches ``least`` cosine to a unit template."""
    rest, kept = 0.0, set(weights)
    for term, weight in sorted(weights.items(), key=lambda x: (x[1], x[0])):
        rest += weight * weight
        if math.sqrt(rest) >= least:
            break
        kept.discard(term)
    return kept


@dataclass(frozen=True)
class Template:
    """A notice or body of a licence, with unit weights."""

    k: int
    license: str
    body: bool
    terms: tuple[str, ...]

    def weights(self, idf: Mapping[str, float]) -> dict[str, float]:
        raw = {t: c * idf[t] for t, c in Counter(self.terms).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}


def numbered(notices: Mapping[str, Sequence[str]], bodies: Mapping[str, Sequence[str]]) -> list[Template]:
    """All notices, then all bodies, each by licence."""
    texts = [(name, body, x) for body, of in ((False, notices), (True, bodies)) for name in sorted(of) for x in of[name]]
    return [Template(k, name, body, tuple(term_list(x))) for k, (name, body, x) in enumerate(texts)]


def frequencies(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(term, held): how many documents hold each of the distinct ``wanted`` terms.

    Few terms are broadcast to the documents; many are joined after the counts have been combined.
    """
    wanted = stored(wanted, name)
    held = docs.select(F.explode(F.array_distinct(terms(text_of(F.col("text"))))).alias("term"))
    if wanted.count() <= BROADCAST_IDS:
        return held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("held"))
    return held.groupBy("term").agg(F.count("*").alias("held")).join(wanted, "term")


LINE, FILE = -1, -2  # what a candidate is compared with: all notices, all templates; else the number of one notice


def _weight_held(terms: Column, squares: Column) -> Column:
    """Sum of the squared weights (a map by term) of the distinct terms that ``terms`` holds."""
    held = F.array_intersect(F.map_keys(squares), terms)
    return F.aggregate(held, F.lit(0.0), lambda total, t: total + F.element_at(squares, t))


def _windows(near: DataFrame, notices: Sequence[Template], weights: Mapping[int, Mapping[str, float]], least: float) -> DataFrame:
    """(doc, only, at, line, terms) of every window of a notice's length that holds enough of the notice.

    Whole texts are asked first, then stretches that hold a notice's length of starts, then the windows that start there.
    """
    enough = least * least - 1e-6
    squares = F.create_map(*[
        v for x in notices for v in (F.lit(x.k), F.create_map(*[F.lit(y) for t, w in sorted(weights[x.k].items()) for y in (t, w * w)]))
    ])
    asked = F.array(*[F.struct(F.lit(x.k).alias("only"), F.lit(len(x.terms)).alias("n")) for x in notices])
    vocabulary = F.array(*map(F.lit, sorted({t for x in notices for t in x.terms})))
    holds = lambda terms, only: _weight_held(terms, F.element_at(squares, only)) >= enough
    of_line = lambda text, line: F.transform(terms(text), lambda t: F.named_struct(F.lit("line"), line, F.lit("term"), t))
    words = F.flatten(F.transform(F.split("text", "\n"), of_line))

    def cut(words: Column, first: Column, n: Column) -> Column:
        return F.slice(words, F.greatest(first, F.lit(0)) + 1, n + F.least(first, F.lit(0)))

    def stretches(words: Column, x: Column) -> Column:
        firsts = F.sequence(1 - x["n"], F.greatest(F.size(words) - 1, 1 - x["n"]), x["n"])
        found = F.transform(firsts, lambda first: F.struct(
            x["only"].alias("only"), x["n"].alias("n"), first.alias("first"), cut(words, first, 2 * x["n"] - 1).alias("words")
        ))
        return F.filter(found, lambda s: holds(s["words"]["term"], x["only"]))

    def laid(held: Column) -> Column:
        some = F.filter(asked, lambda x: holds(held, x["only"]))
        return F.transform(F.array(some), lambda some: F.when(F.size(some) > 0, F.flatten(F.flatten(
            F.transform(F.array(words), lambda w: F.transform(some, lambda x: stretches(w, x)))
        ))))

    # an array of one value and a function of it: the value is computed once
    found = F.flatten(F.flatten(F.transform(F.array(F.array_intersect(vocabulary, F.col("terms"))), laid)))
    starts = F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)
    inside = F.greatest("at", F.lit(0)) - F.greatest("first", F.lit(0)) + 1
    return near.select("doc", F.explode(found).alias("s")).select("doc", "s.*").withColumn("at", F.explode(starts)).select(
        "doc", "only", "at", F.slice("words", inside, F.col("n") + F.least("at", F.lit(0))).alias("w")
    ).filter(holds(F.col("w.term"), F.col("only"))).select(
        "doc", "only", "at", F.get("w.line", F.lit(0)).alias("line"), F.col("w.term").alias("terms")
    )


def _candidates(
    docs: DataFrame, anchors: list[str], file_anchors: list[str], notices: Sequence[Template], weights: Mapping[int, Mapping[str, float]], least: float
) -> DataFrame:
    """(doc, only, at, line, terms) of every candidate; ``line`` is its first line."""
    marked, file_marked = (F.array(*map(F.lit, a)) for a in (anchors, file_anchors))
    text = text_of(F.col("text"))
    is_file = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    every = terms(text)
    near = docs.select(
        F.struct("doc_id", F.xxhash64("path", "text").alias("tie"), "path").alias("doc"), text.alias("text"), is_file.alias("file"), every.alias("terms")
    ).filter(F.arrays_overlap("terms", marked) | (F.col("file") & F.arrays_overlap("terms", file_marked)))
    lines = near.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "text")).select(
        "doc", F.lit(LINE).alias("only"), F.col("line").alias("at"), "line", terms(F.col("text")).alias("terms")
    ).filter(F.arrays_overlap("terms", marked))
    files = near.filter("file").select("doc", F.lit(FILE).alias("only"), F.lit(0).alias("at"), F.lit(0).alias("line"), "terms")
    return lines.union(files).union(_windows(near, notices, weights, least))


def scan(
    docs: DataFrame, least: float = LEAST, templates: Mapping[str, Sequence[str]] = TEMPLATES, bodies: Mapping[str, Sequence[str]] = BODIES
) -> DataFrame:
    """doc_id, path, own_license, similarity and first line of the best candidate (0 is the first line)."""
    spark = docs.sparkSession
    known = numbered(templates, bodies)
    vocabulary = sorted({t for x in known for t in x.terms})
    n = docs.count()
    of_templates = spark.range(1).select(F.explode(F.array(*map(F.lit, vocabulary))).alias("term"))
    counts = {r["term"]: r["held"] for r in frequencies(docs, of_templates, "licence-terms").collect()}  # template terms only
    idf = {t: inverse_frequency(counts.get(t, 0), n) for t in vocabulary}
    weights = {x.k: x.weights(idf) for x in known}
    anchors = {k: distinctive(w, least) for k, w in weights.items()}
    notices = [x for x in known if not x.body]
    marks = [sorted(set().union(*(anchors[x.k] for x in some))) for some in (notices, known)]
    found = _candidates(docs, *marks, [x for x in notices if x.terms], weights, least)
    unit = ["doc", "only", "at", "line"]
    counted = stored(
        found.select(*unit, F.explode("terms").alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("tf")), "licence-candidates"
    )
    weight_of = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, idf[t])])
    own_idf = F.try_element_at(weight_of, F.col("term"))
    others = stored(frequencies(docs, counted.filter(own_idf.isNull()).select("term").distinct(), "licence-other-terms"), "licence-frequencies")
    if others.count() <= BROADCAST_IDS:
        weighed = counted.join(F.broadcast(others), "term", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        weighed = counted.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int")).join(
            others.select("term", "held", salts), ["term", "salt"], "left"
        ).drop("salt")
    rare = F.log(F.lit(n + 1.0) / (F.coalesce("held", F.lit(0)) + 1)) + 1
    weighed = weighed.withColumn("weight", F.col("tf") * F.coalesce(own_idf, rare))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    rows = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(x.k).alias("k"), F.lit(x.license).alias("license"), F.lit(x.body).alias("body"), F.lit(w).alias("w"))
        for x in known for t, w in sorted(weights[x.k].items())
    ])
    template_rows = spark.range(1).select(F.explode(rows).alias("x")).select("x.*")
    compared = (F.col("only") == F.col("k")) | (F.col("only") == FILE) | ((F.col("only") == LINE) & ~F.col("body"))
    similar = weighed.join(F.broadcast(template_rows), (weighed["term"] == template_rows["t"]) & compared).groupBy(
        *unit, "k", "license"
    ).agg(F.sum(F.col("weight") * F.col("w")).alias("dot")).join(norms, unit)
    best = similar.select(
        "doc", F.struct((-F.round(F.col("dot") / F.col("norm"), 9)).alias("distance"), "line", "license").alias("match")
    ).groupBy("doc").agg(F.min("match").alias("match")).filter(F.col("match.distance") <= -least)
    return best.select(
        "doc.doc_id", "doc.path", "doc.tie", F.col("match.license").alias("own_license"),
        (-F.col("match.distance")).alias("similarity"), F.col("match.line").alias("line"),
    )


def directory_of(path: Column) -> Column:
    """The directory of a path: all before its last slash; the root is the empty string."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def ancestors(directory: Column) -> Column:
    """A directory and those above it with their depth, the root (the empty string) at depth 0."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")),
    )


def licenses(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, license, origin (header, inherited or none), from_dir, similarity and line of every document."""
    docs = docs.select("doc_id", F.col("path").cast("string").alias("path"), "text")
    own = stored(scan(docs, least), "licence-headers")
    files = own.filter(F.col("path").rlike(FILE_NAME)).select(directory_of(F.col("path")).alias("dir"), "own_license")
    stated = files.groupBy("dir", "own_license").agg(F.count("*").alias("n")).groupBy("dir").agg(
        F.min(F.struct(-F.col("n"), "own_license")).alias("m")
    ).select(F.col("dir").alias("above"), F.col("m.own_license").alias("stated"))
    keyed = docs.select("doc_id", "path", F.xxhash64("path", "text").alias("tie"), directory_of(F.col("path")).alias("dir"))
    directories = keyed.select("dir").filter("dir is not null").distinct()
    resolved = directories.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.*").join(
        stated, "above"
    ).groupBy("dir").agg(F.max(F.struct("depth", "above", "stated")).alias("m")).select(
        F.col("dir").alias("in_dir"), F.col("m.above").alias("from_dir"), F.col("m.stated").alias("stated")
    )
    own = own.dropDuplicates(["doc_id", "tie"]).select(F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie"), "own_license", "similarity", "line")
    resolved = resolved.withColumn("in_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int")
    joined = keyed.withColumn("part", part).join(
        own, keyed["doc_id"].eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie")), "left"
    ).join(resolved, (F.col("dir") == F.col("in_dir")) & (F.col("part") == F.col("in_part")), "left")
    header = F.col("own_license").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own_license", "stated").alias("license"),
        F.when(header, "header").when(F.col("stated").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~header, F.col("from_dir")).alias("from_dir"),
        F.round("similarity", 6).alias("similarity"), F.col("line").cast("long").alias("line"),
    )
