"""Licence scans (operator 7): an exact set-similarity join, DataFrame functions only.

Text blocks are sets of words, licence templates too. Blocks are overlapping
windows of a text's words whatever the line breaks, so that a notice meets its
template however it is wrapped, and the lines of a text. Windows are cut by the
length of a template, and lines of more than twice a template's length aren't
for it: longer ones would hold a short template's words by chance. A block
meets a template if it holds at least ``threshold`` of the template's words,
and is its notice if it also holds the words that tell the template from its
siblings (a name, a version) and none that a sibling has in their place. To
find all pairs without comparing all, words are ordered by how many blocks
hold them, rarest first: a block that meets a template of n words, k of them
needed, has one of the template's n - k + 1 rarest words (prefix filter), has k
words at all (length filter), and has enough words left after the first common
one (positional filter). What passes is verified by counting.

Base phrases are counted beside that, as consecutive words anywhere in a text.

Defined results
---------------
null or empty text: no words, no places, no labels (empty strings), score 0.
Repeated ids and rows: each row by its text. Null ``doc_id`` is kept. Extra
columns are dropped. Empty tables give empty results. A text of any length is
scanned whole. A notice of two licences gives both labels. The score is the
largest containment of a met template, or 1 where a base phrase occurs, else 0.

Scale
-----
One pass over the texts keeps, by document, its counts and the template words
of its blocks, in a table in the shared folder. Blocks are made only of texts
that hold enough words of a template as a whole; no block of others can. Word frequencies are counted
from it: at most one row for each template word on the driver. The index is as
small and is broadcast. Matches are grouped by document and text hash.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words that a notice must have, and words that only a sibling's notice has.
    needs: str
    without: str = ""

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(sorted(set(re.findall(WORD, self.text.translate(_LOWER)))))

    @property
    def length(self) -> int:
        return len(re.findall(WORD, self.text.translate(_LOWER)))


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# Notices by which works are put under well-known licences, as their publishers word them, the words that tell them apart, and those of siblings.
TEMPLATES = (
    Template("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license redistribute"),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License version 3", "affero general public license 3"),
    Template("agpl-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "affero general public license 3 2007"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license 2"),
    Template("apache-2.0", "Apache License Version 2.0, January 2004", "apache license 2 2004"),
    Template("artistic-2.0", "Licensed under the Artistic License 2.0", "artistic license 2"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary permitted"),
    Template("bsd", "Released under the BSD License", "bsd license", "clause"),
    Template("bsd-2-clause", "Released under the BSD 2-Clause License", "bsd 2 clause"),
    Template("bsd-3-clause", "Released under the BSD 3-Clause License", "bsd 3 clause"),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    Template("cc-by-3.0", "Licensed under CC BY 3.0", "cc by 3", "nc nd sa"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4", "nc nd sa"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4", "alike commercial derivatives noderivatives noderivs noncommercial sharealike"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc", "nd sa"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial", "alike noderivatives noderivs sharealike"),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd"),
    Template("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "creative commons noncommercial noderivatives"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa"),
    Template("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative commons noncommercial sharealike"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd", "nc"),
    Template("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons noderivatives", "commercial noncommercial"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa", "nc"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike License", "creative commons sharealike", "commercial noncommercial"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike", "commercial noncommercial"),
    Template("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright neighboring"),
    Template("cc0", "Released under CC0 1.0 Universal", "cc0"),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", "eclipse public license 2"),
    Template("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "free documentation license"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public license redistribute", "affero lesser library"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", "general public license 2", "affero lesser library"),
    Template("gpl-2.0", "GNU General Public License Version 2, June 1991", "general public license 2 1991", "affero lesser library"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", "general public license 3", "affero lesser library"),
    Template("gpl-3.0", "GNU General Public License Version 3, 29 June 2007", "general public license 3 2007", "affero lesser library"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission distribute purpose fee"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license redistribute"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission charge person obtaining copy"),
    Template("mit", "Released under the MIT License", "mit license"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license 2"),
    Template("mpl-2.0", "Licensed under the Mozilla Public License Version 2.0", "mozilla public license 2"),
    Template("public-domain", "This is free and unencumbered software released into the public domain", "unencumbered public domain"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages", "will authors held liable"),
)


def needed(template: Template, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * len(template.words), 9)))


def windows(length: int) -> tuple[int, int]:
    """Size and stride, in words, of windows of which one holds any run of words up to a quarter longer than a template of ``length`` words. The last ones are cut by the text's end."""
    stride = max(1, length // 4)
    return math.ceil(1.25 * length) + stride - 1, stride


def _vocabulary(templates: Iterable[Template]) -> list[str]:
    return sorted({w for t in templates for w in (*t.words, *t.without.split())})


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Where a phrase begins, as word numbers."""

    def here(i: Column) -> Column:
        found = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return found

    last = F.size(words) - len(phrase)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _base(words: Column) -> Column:
    """n, first, last, labels of the base phrases."""
    found = F.array(*[F.struct(_places(words, p).alias("at"), F.lit(label).alias("label")) for p, label in PHRASES.items()])

    def told(each: Column) -> Column:
        at = F.flatten(F.transform(each, lambda x: x["at"]))
        labels = F.array_sort(F.array_distinct(F.transform(F.filter(each, lambda x: F.size(x["at"]) > 0), lambda x: x["label"])))
        return F.struct(F.size(at).cast("long").alias("n"), F.array_min(at).cast("long").alias("first"), F.array_max(at).cast("long").alias("last"), labels.alias("labels"))

    return let(found, told)


def prepared(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """By document: n_words, the base phrases' struct (null where none can be), and the template words of each block (none where no block can meet a template).

    A block is a window for templates of ``length`` words, or, where that is 0, a line of ``size`` words, for templates of at least half as many.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    by_line = F.transform(F.split("__lower", "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(f"({WORD})")))
    one = docs.select(F.col("doc_id"), F.xxhash64("text").alias("__key"), lower.alias("__lower")).select("doc_id", "__key", "__lower", by_line.alias("__lines"))
    one = one.withColumn("__common", F.array_intersect(F.flatten("__lines"), F.lit(_vocabulary(templates))))
    holds = lambda words, some: F.size(F.array_intersect(words, F.lit(list(some))))
    able = lambda some: reduce(or_, [(holds("__common", t.needs.split()) == len(t.needs.split())) & (holds("__common", t.words) >= needed(t, threshold)) for t in some])
    block = lambda words, among, length, size: F.struct(F.array_intersect(words, F.lit(among)).alias("words"), F.lit(length).alias("length"), size.alias("size"))
    no_blocks = F.array().cast("array<struct<words: array<string>, length: int, size: int>>")

    def runs(words: Column, length: int) -> Column:
        some = [t for t in templates if t.length == length]
        least, (size, stride) = min(needed(t, threshold) for t in some), windows(length)
        cut = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(stride)), lambda i: block(F.slice(words, i, size), _vocabulary(some), length, F.lit(size)))
        return F.when(able(some), F.filter(cut, lambda x: F.size(x["words"]) >= least)).otherwise(no_blocks)

    short = F.filter("__lines", lambda x: F.size(x) <= 2 * max(t.length for t in templates))
    lines = F.filter(F.transform(short, lambda x: block(x, _vocabulary(templates), 0, F.size(x))), lambda x: F.size(x["words"]) > 0)
    by_window = let(F.flatten("__lines"), lambda words: F.concat(*[runs(words, n) for n in sorted({t.length for t in templates})]))
    # A phrase's rarest word must be there as letters before its places are looked for.
    may = F.contains("__lower", F.lit("reserved")) | F.contains("__lower", F.lit("general")) | F.contains("__lower", F.lit("cc"))
    return one.select(
        "doc_id",
        "__key",
        F.aggregate("__lines", F.lit(0), lambda n, x: n + F.size(x)).cast("long").alias("n_words"),
        F.when(may, let(F.flatten("__lines"), _base)).alias("base"),
        F.when(able(templates), F.concat(lines, by_window)).otherwise(no_blocks).alias("blocks"),
    )


def matches(ready: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, __key, block, template, containment, own) for each block that meets a template; ``own``: by the words that tell siblings apart, it is the template's notice.

    ``ready``: of ``prepared``, in a written table.
    """
    spark = ready.sparkSession
    blocks = ready.select("doc_id", "__key", F.posexplode("blocks").alias("block", "found")).select("doc_id", "__key", "block", "found.*")
    counted = {r.word: r.n for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(_vocabulary(templates), key=lambda w: (counted.get(w, 0), w))
    place = {w: i + 1 for i, w in enumerate(order)}
    index, sets, prefixes = [], [], set()
    for k, t in enumerate(templates):
        ranks, need = sorted(place[w] for w in t.words), needed(t, threshold)
        sets.append((k, ranks, need, [place[w] for w in t.needs.split()], [place[w] for w in t.without.split()]))
        for i, rank in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((rank, k, i, len(ranks), need, t.length))
            prefixes.add(order[rank - 1])
    least = min(need for _, _, need, _, _ in sets)
    able = blocks.where((F.size("words") >= least) & F.arrays_overlap("words", F.lit(sorted(prefixes))))
    ordered = able.select("doc_id", "__key", "block", "length", "size", F.array_sort(F.transform("words", lambda w: F.array_position(F.lit(order), w).cast("int"))).alias("ranks"))
    each = ordered.select("doc_id", "__key", "block", "length", "size", "ranks", F.posexplode("ranks").alias("at", "rank"))
    by_rank = F.broadcast(spark.createDataFrame(index, "rank int, template int, place int, words int, need int, longest int"))
    fits = (F.col("length") == F.col("longest")) | ((F.col("length") == 0) & (F.col("size") <= 2 * F.col("longest")))
    position = 1 + F.least(F.col("words") - F.col("place"), F.size("ranks") - F.col("at")) - 1 >= F.col("need")
    candidates = each.join(by_rank, "rank").where(fits & (F.size("ranks") >= F.col("need")) & position)
    candidates = candidates.select("doc_id", "__key", "block", "template", "ranks").dropDuplicates(["doc_id", "__key", "block", "template"])
    whole = F.broadcast(spark.createDataFrame(sets, "template int, all array<int>, need int, needs array<int>, without array<int>"))
    common = F.size(F.array_intersect("ranks", "all"))
    own = (F.size(F.array_except("needs", "ranks")) == 0) & ~F.arrays_overlap("ranks", "without")
    return candidates.join(whole, "template").where(common >= F.col("need")).select("doc_id", "__key", "block", "template", (common / F.size("all")).alias("containment"), own.alias("own"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    ready = materialize(prepared(docs, templates, threshold), "licence-words")
    names = F.lit([t.label for t in templates])
    met = matches(ready, templates, threshold).where("own").groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"))
    met = met.agg(F.collect_set(F.get(names, F.col("template"))).alias("__labels"), F.max("containment").alias("__most"))
    both = ready.drop("blocks").join(met, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left")
    none = F.array().cast("array<string>")
    base = F.coalesce("base.labels", none)
    n_base = F.coalesce("base.n", F.lit(0).cast("long"))
    return both.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("__labels", none)))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("__most", F.lit(0.0))).alias("score"),
    )
