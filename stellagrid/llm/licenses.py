"""License scans: phrases in place, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, hash128, small_side, text_or_empty

#: A block's share of a template's distinct words from which on it carries the template's label.
THRESHOLD = 0.8
#: A block is a run of at most this many times the template's distinct words.
SPAN = 2
# The phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Public license notices: label, text, words that a block must have side by side, words that it must not have.
TEMPLATES = [
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3.", "affero", ""),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "affero", ""),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "affero", ""),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache", ""),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "", ""),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache", ""),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "", ""),
    ("bsd", "Licensed under the BSD License.", "bsd", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "", ""),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "", ""),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "", ""),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by", "nc nd sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution", "noncommercial noderivatives sharealike"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc", "nd sa"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "commons attribution noncommercial", "noderivatives sharealike"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd", ""),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "commons attribution noncommercial noderivatives", ""),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa", ""),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "commons attribution noncommercial sharealike", ""),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd", "nc"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "commons attribution noderivatives", "noncommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa", "nc"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "commons attribution sharealike", "noncommercial"),
    ("cc0", "Licensed under CC0 1.0.", "cc0", ""),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived", ""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "general public", "affero lesser library"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "general public", "affero lesser library"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "general public", "affero lesser library"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "general public", "affero lesser library"),
    ("isc", "Released under the ISC License.", "isc", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "", ""),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3.", "lesser", ""),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "lesser", ""),
    ("mit", "Released under the MIT License.", "mit", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla", ""),
    ("mpl", "Licensed under the Mozilla Public License 2.0.", "mozilla", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
]

#: More than the templates have words.
_RANKS = 4096
BLANK = r"\n[ \t\r\x0B\x0C]*+\n"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_apart(c: Column) -> Column:
    """The words of c, A-Z lower-cased, one space apart."""
    return F.trim(F.regexp_replace(ascii_lower(c), GAP, " "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def distinct_words(text: str) -> list[str]:
    low = text.translate(str.maketrans(UPPER, LOWER))
    return sorted(set("".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()))


@dataclass(frozen=True)
class Template:
    """words: its distinct ones; need: so many of them a block has at least; span: words of a block at most."""

    number: int
    label: str
    words: tuple[str, ...]
    must: tuple[str, ...]
    never: tuple[str, ...]
    need: int
    span: int

    @property
    def reach(self) -> int:
        """The span, raised to a power of two: blocks are looked for in tiles of twice this many words."""
        return 1 << max(3, (self.span - 1).bit_length())


def prepare(templates: list[tuple[str, str, str, str]], threshold: float) -> list[Template]:
    out = []
    for k, (label, text, must, never) in enumerate(templates):
        words = distinct_words(text)
        out.append(Template(k, label, tuple(words), tuple(must.split()), tuple(never.split()), math.ceil(round(threshold * len(words), 9)), SPAN * len(words)))
    return out


def describe(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, t1, t2, n_words, n_base, first_word, last_word, base and own (its words of the vocabulary) of each row.

    The only pass over all texts; t1 and t2 are hashes of the text. What it gives is small, and cut.
    """
    hashes = [h.alias(f"t{i}") for i, h in enumerate(hash128(text_or_empty()), 1)]
    rows = docs.select("doc_id", *hashes, words_apart(text_or_empty()).alias("words"))
    places = " (?:" + "|".join(sorted(PHRASES.values())) + ")(?= )"
    s = F.when(F.instr("words", "license") > 0, F.concat(F.lit(" "), "words", F.lit(" ")))
    marked = rows.withColumn("s", s)
    n_base = F.coalesce(F.regexp_count("s", F.lit(places)), F.lit(0))
    labels = F.array_compact(F.array(*(F.when(F.instr("s", f" {phrase} ") > 0, F.lit(label)) for label, phrase in sorted(PHRASES.items()))))
    return cut(
        marked.select(
            "doc_id",
            "t1",
            "t2",
            F.when(F.col("words") == "", 0).otherwise(spaces(F.col("words")) + 1).cast("long").alias("n_words"),
            n_base.cast("long").alias("n_base"),
            F.when(n_base > 0, spaces(F.regexp_extract("s", "(?s)^(.*?)" + places, 1))).cast("long").alias("first_word"),
            F.when(n_base > 0, spaces(F.regexp_extract("s", "(?s)^(.*)" + places, 1))).cast("long").alias("last_word"),
            F.when(F.col("s").isNotNull(), labels).otherwise(F.array().cast("array<string>")).alias("base"),
            F.array_intersect(F.split("words", " "), F.array(*map(F.lit, vocabulary))).alias("own"),
        ),
        "licenses",
    )


def _sides(spark: SparkSession, known: list[Template], order: dict[str, int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The templates by the words of their prefixes, their vocabulary by reach, and all words of prefixes."""
    rank = lambda words: sorted(order[w] for w in words)
    prefixes, words = [], set()
    for t in known:
        ranks = rank(t.words)
        words |= {(w, order[w], t.reach) for w in (*t.words, *t.must, *t.never)}
        prefixes += [(t.reach, r, i, t.number, t.label, ranks, [order[w] for w in t.must], rank(t.never), t.need, t.span) for i, r in enumerate(ranks[: len(ranks) - t.need + 1])]
    sides = spark.createDataFrame(prefixes, "reach int, rank int, i int, template int, label string, ranks array<int>, must array<int>, never array<int>, need int, span int")
    name = {r: w for w, r in order.items()}
    return sides, spark.createDataFrame(sorted(words), "word string, rank int, reach int"), sorted({name[p[1]] for p in prefixes})


def blocks(texts: DataFrame, vocabulary: DataFrame, prefix_words: list[str]) -> DataFrame:
    """(t1, t2, paragraph, reach, tile, occ, ranks) of texts (t1, t2, text): where blocks can be.

    A paragraph is what stands between blank lines. Its words are dealt to tiles of 2 * reach words, one every reach
    words: any run of at most reach words lies within the tile that its first word begins the first half of. occ has a
    tile's words of the vocabulary, and their places; ranks the distinct ones, rarest first.
    """
    prefix = F.array(*map(F.lit, prefix_words))
    paragraphs = texts.select("t1", "t2", F.posexplode(F.split("text", BLANK, -1)).alias("paragraph", "part")).select("t1", "t2", "paragraph", F.split(words_apart(F.col("part")), " ").alias("words"))
    placed = paragraphs.where(F.arrays_overlap("words", prefix)).select("t1", "t2", "paragraph", F.posexplode("words").alias("at", "word")).join(F.broadcast(vocabulary), "word")
    last = F.floor(F.col("at") / F.col("reach")).cast("int")
    tiled = placed.select("t1", "t2", "paragraph", "reach", "at", "rank", F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last)).alias("tile"))
    found = tiled.groupBy("t1", "t2", "paragraph", "reach", "tile").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("occ"))
    return found.withColumn("ranks", F.array_sort(F.array_distinct(F.transform("occ", lambda x: x["rank"]))))


def candidates(found: DataFrame, sides: DataFrame) -> DataFrame:
    """Blocks with the templates that prefix, length and positional filters leave; one row a shared word of the prefix.

    A template of t words and a block of b, whose shared word stands i and j words after the rarest of either, share
    at most min(t - i, b - j) words from there on. For the first shared word that bounds the whole overlap.
    """
    at = found.select("*", F.size("ranks").alias("b"), F.posexplode("ranks").alias("j", "rank"))
    t = F.size("side.ranks")
    return (
        at.alias("block")
        .join(F.broadcast(sides).alias("side"), ["reach", "rank"])
        .where((F.col("b") >= F.col("need")) & (F.least(t - F.col("i"), F.col("b") - F.col("j")) >= F.col("need")))
        .select("t1", "t2", "reach", "tile", "occ", F.col("block.ranks").alias("own"), "rank", "template", "label", F.col("side.ranks").alias("ranks"), "must", "never", "need", "span")
    )


def verified(pairs: DataFrame) -> DataFrame:
    """(t1, t2, label, share) of candidates whose exact overlap, then whose best run, meets the template's need.

    For each place of a template word in the first half of the tile, the run from there on ends after span words, or
    before the first word that the template must not meet. It counts if it has the words that it must have, side by side.
    """
    shared = F.array_intersect("own", "ranks")
    exact = pairs.where((F.size(shared) >= F.col("need")) & (shared[0] == F.col("rank")) & (F.size(F.array_except("must", "own")) == 0))
    mine = F.filter("occ", lambda x: F.array_contains("ranks", x["rank"]))
    bad = F.transform(F.filter("occ", lambda x: F.array_contains("never", x["rank"])), lambda x: x["at"])

    def best(x: Column) -> Column:
        start = x["at"]
        end = F.least(start + F.col("span"), F.coalesce(F.array_min(F.filter("bad", lambda at: at >= start)), start + F.col("span")))
        run = F.filter("mine", lambda y: (y["at"] >= start) & (y["at"] < end))
        codes = F.transform(run, lambda y: y["at"] * _RANKS + y["rank"])
        named = F.exists(codes, lambda c: F.forall(F.sequence(F.lit(1), F.size("must")), lambda i: F.array_contains(codes, F.floor(c / _RANKS).cast("int") * _RANKS + (i - 1) * _RANKS + F.element_at("must", i))))
        return F.when((F.size("must") == 0) | named, F.size(F.array_distinct(F.transform(run, lambda y: y["rank"])))).otherwise(0)

    starts = F.filter("mine", lambda x: x["at"] < (F.col("tile") + 1) * F.col("reach"))
    runs = exact.withColumns({"mine": mine, "bad": bad}).withColumn("most", F.array_max(F.transform(starts, best)))
    return runs.where(F.col("most") >= F.col("need")).select("t1", "t2", "label", (F.col("most") / F.size("ranks")).alias("share"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    A block is a run of words of a paragraph, wherever its lines are broken; a template of t distinct words looks at
    runs of SPAN * t words at most. A block matches it that has at least ceil(threshold * t) of them, has all the words
    that the template says it must have, side by side, and none that it must not have: so the notice of a narrower license carries no
    wider license's label. labels are those of the matching templates and of the phrases; score is the greatest share
    of a matching template, 0 if none matches. Of templates with equal shares, all count.

    The words are ordered by the number of rows of docs that have them, rarest first. A template's first
    t - ceil(threshold * t) + 1 words are its prefix, one of which every matching block has, so only documents with such
    words are cut into blocks; blocks join the templates on the words of their prefixes, and what the length and the
    positional filter leave is counted exactly, run by run. The templates are a parameter, so the joined side, and the
    frequencies that go to the driver, are of fixed size.

    Null text counts as empty: no words, no places, null first_word and last_word, empty labels, score 0. Repeated
    rows each get their row; equal texts are searched once. Long texts are searched tile by tile, in any task. An empty table gives
    no rows. Other columns are left aside.
    """
    spark = docs.sparkSession
    known = prepare(TEMPLATES if templates is None else templates, threshold)
    words = sorted({w for t in known for w in (*t.words, *t.must, *t.never)})
    described = describe(docs, words)
    count = dict(described.select(F.explode("own").alias("word")).groupBy("word").count().collect())  # a row a template word
    order = {w: k for k, w in enumerate(sorted(words, key=lambda w: (count.get(w, 0), w)))}
    sides, vocabulary, prefix_words = _sides(spark, known, order)

    some = cut(described.where(F.arrays_overlap("own", F.array(*map(F.lit, prefix_words)))).select("t1", "t2").distinct(), "licensed")
    texts = docs.select(*(h.alias(f"t{i}") for i, h in enumerate(hash128(text_or_empty()), 1)), text_or_empty().alias("text"))
    chosen = texts.join(small_side(some, F.lit(0)), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    matches = verified(candidates(blocks(chosen, vocabulary, prefix_words), sides)).groupBy("t1", "t2").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))
    labels = cut(matches, "labels")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return described.join(small_side(labels, F.lit(64)), ["t1", "t2"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
