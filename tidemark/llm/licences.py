"""Licence scans through a positional index of rare words.

Every licence template is a sequence of words with mandatory key phrases. The rarity
of each template word (IDF) is counted over all files. The index holds, for each
template, the positions of its ``anchors`` rarest mandatory words; as a match needs them
all, these are the highest-IDF words by which a file can match. A file's words are looked up
there: a posting at template position p for a file word at place i gives the
alignment i - p. The alignments of a template's anchor words are intersected, and one
that all of them share counts if every mandatory phrase stands at its
place. Nothing is shuffled but the word counts of the licence vocabulary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of well-known licences as words, one name each.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
    "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
    "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source "
    "code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the "
    "copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential "
    "damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory "
    "of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
    "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
    "acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented "
    "as being the original software 3 this notice may not be removed or altered from any source distribution"
)
APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
    "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
    "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
GPL_NOTICE = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
    "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public "
    "license along with this program if not see https www gnu org licenses"
)
UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
    "form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
MPL_NOTICE = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
)
#: Licence texts and notices, and the phrases that must stand in them. Label, text, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", MIT, ["hereby granted free of charge", "person obtaining a copy"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache", APACHE_NOTICE, ["in compliance with the license", "specific language governing permissions and limitations"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", GPL_NOTICE, ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("bsd", BSD, ["source and binary forms"]),
    ("mpl", MPL_NOTICE, ["mozilla public license"]),
    ("isc", ISC, ["copy modify and or distribute this software"]),
    ("zlib", ZLIB, ["must not claim that you wrote the original software"]),
    ("unlicense", UNLICENSE, ["unencumbered software released into the public domain"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Phrase and label of the base places.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHORS = 2


def _text(text: Column) -> Column:
    """The words of a text, lower-cased, each followed by one space and the first preceded by one."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NOT_WORD, " ")


def vocabulary(templates=TEMPLATES, base=BASE) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | {w for p, _ in base for w in p.split()})


def idf(df: DataFrame, words: list[str], text_col: str = "text") -> dict[str, float]:
    """log((1 + files) / (1 + files with the word)) of the given words over all files; one number for each word reaches the driver."""
    spaced = F.split(_text(F.col(text_col)), " ")
    seen = F.array_intersect(spaced, F.lit(words).cast("array<string>"))
    rows = df.select(F.explode(F.concat(F.array(F.lit("")), seen)).alias("w")).groupBy("w").count().collect()
    counts = {r[0]: r[1] for r in rows}
    files = counts.get("", 0)
    return {w: math.log((1 + files) / (1 + counts.get(w, 0))) for w in words}


def index(templates, rarity: dict[str, float], anchors: int = ANCHORS) -> dict[str, list[tuple[int, int]]]:
    """Word -> (template, position) for the rarest words of each template; ties to the smaller word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text, phrases) in enumerate(templates):
        words = text.split()
        must = {w for p in phrases for w in p.split()}
        for w in sorted(must, key=lambda w: (-rarity[w], w))[:anchors]:
            out.setdefault(w, []).extend((k, i) for i, x in enumerate(words) if x == w and _inside(words, phrases, i))
    return out


def _places(words: list[str], phrases: list[str]) -> list[tuple[int, list[str]]]:
    """Where each mandatory phrase begins in the template."""
    out = []
    for p in phrases:
        q = p.split()
        out.append((next(i for i in range(len(words)) if words[i : i + len(q)] == q), q))
    return out


def _inside(words: list[str], phrases: list[str], i: int) -> bool:
    return any(at <= i < at + len(q) for at, q in _places(words, phrases))


def scan(
    df: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    templates=TEMPLATES,
    base=BASE,
    anchors: int = ANCHORS,
) -> DataFrame:
    """One row for each row of ``df``: ``keep`` columns and the licence findings.

    n_words; n_base, first_word and last_word of the base places (null without any);
    base_labels and labels (distinct, sorted, comma-joined); score, the largest share of a
    matched template's IDF mass that stands at its place (0 without a match); matches, an
    array of template label, place of the template's first word (may be negative if its
    beginning is cut off) and share. Null texts are empty. Every row is judged by itself,
    so repeated rows and identifiers and other columns make no difference; an empty table
    gives an empty result.
    """
    words = vocabulary(templates, base)
    rarity = idf(df, words, text_col)
    postings = index(templates, rarity, anchors)
    phrase_words = sorted({w for p, _ in base for w in p.split()})
    listed = sorted(set(postings) | set(phrase_words))
    tokens = F.split(F.regexp_replace(_text(F.col(text_col)), r"^ | $", ""), " ")
    rows = df.select(*keep, tokens.alias("__words"))
    # " " alone gives one empty word
    rows = rows.withColumn("__n", F.when((F.size("__words") == 1) & (F.element_at("__words", 1) == ""), F.lit(0)).otherwise(F.size("__words")).cast("long"))
    lit_words = F.lit(listed).cast("array<string>")
    rows = rows.withColumn("__has", F.arrays_overlap("__words", lit_words))
    at = lambda i: F.get(F.col("__words"), i)
    hits = F.when(
        F.col("__has"),
        F.filter(F.transform("__words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(listed)),
    ).otherwise(F.array().cast("array<struct<i:int,w:string>>"))
    rows = rows.withColumn("__hits", hits)
    found = []
    for phrase, label in base:
        found.append(_base_places(phrase.split(), label, at))
    rows = rows.withColumn("__base", F.concat(*found))
    aligned = [_aligned(k, {w: [p for t, p in posts if t == k] for w, posts in sorted(postings.items())}) for k in range(len(templates))]
    rows = rows.withColumn("__votes", F.concat(*aligned))
    rows = rows.withColumn("__matches", F.filter(F.transform("__votes", lambda v: _verify(v, templates, rarity, at)), lambda m: m.isNotNull()))
    starts = F.transform("__base", lambda b: b["i"])
    base_labels = F.transform("__base", lambda b: b["l"])
    more = F.transform("__matches", lambda m: m["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        *keep,
        F.col("__n").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform("__matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        F.col("__matches").alias("matches"),
    )


def _base_places(words: list[str], label: str, at) -> Column:
    """The places of a phrase, looked up by its last word."""
    n = len(words) - 1
    ok = F.filter("__hits", lambda x: (x["w"] == words[-1]) & (x["i"] >= n) & _all([at(x["i"] - (n - k)) == w for k, w in enumerate(words[:-1])]))
    return F.transform(ok, lambda x: F.struct((x["i"] - n).alias("i"), F.lit(label).alias("l")))


def _aligned(template: int, positions: dict[str, list[int]]) -> Column:
    """The alignments on which all anchor words of a template agree."""
    def alignments(word, posts):
        mine = F.filter("__hits", lambda x: x["w"] == word)
        return F.flatten(F.transform(mine, lambda x: F.array(*(x["i"] - p for p in posts))))

    found = [alignments(w, posts) for w, posts in positions.items() if posts]
    out = F.array_distinct(found[0])
    for f in found[1:]:
        out = F.array_intersect(out, f)
    return F.transform(out, lambda o: F.struct(F.lit(template).alias("k"), o.alias("o")))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _standing(words: Column, weights: Column, vote: Column, at) -> Column:
    """The weights of a template's words that stand at their places, 0 for the others."""
    return F.transform(words, lambda w, j: F.when(F.coalesce(at(vote["o"] + j) == w, F.lit(False)), F.get(weights, j)).otherwise(0.0))


def _verify(vote: Column, templates, rarity: dict[str, float], at) -> Column:
    """A match for an alignment at which all mandatory phrases stand, else null."""
    out = None
    for k, (label, text, phrases) in enumerate(templates):
        words = text.split()
        word_at = lambda j: F.when(vote["o"] + j >= 0, at(vote["o"] + j))
        must = _all([word_at(p + j) == w for p, q in _places(words, phrases) for j, w in enumerate(q)])
        mass = sum(rarity[w] + 1e-3 for w in words)
        own, weights = F.lit(words).cast("array<string>"), F.lit([(rarity[w] + 1e-3) / mass for w in words]).cast("array<double>")
        share = F.aggregate(_standing(own, weights, vote, at), F.lit(0.0), lambda a, x: a + x)
        made = F.when(must, F.struct(F.lit(label).alias("label"), vote["o"].cast("long").alias("start"), F.least(F.round(share, 6), F.lit(1.0)).alias("share")))
        out = F.when(vote["k"] == k, made) if out is None else out.when(vote["k"] == k, made)
    return out
