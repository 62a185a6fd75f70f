"""Licence notices in documents, by Dice coefficient over word bigrams.

Notices are looked for anywhere in the normalised words of a whole text: inside a line, over
lines or over blocks. A passage like a template holds one of the template's telling bigrams
(of n bigrams at least ``need`` have to be shared, so one of any n - need + 1 is; the rarest
are taken). Where one stands, the window of the template's length that puts it in the
template's place is compared by its distinct bigrams, within the bounds that the least
coefficient puts on its size. Only built-in functions are used.
"""

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voltlake.llm.text import LOWER, UPPER

LEAST_DICE = 0.75

_NO_WARRANTY = (
    'The software is provided "as is", without warranty of any kind, express or implied, including '
    "but not limited to the warranties of merchantability, fitness for a particular purpose and "
    "noninfringement. In no event shall the authors or copyright holders be liable for any claim, "
    "damages or other liability, whether in an action of contract, tort or otherwise, arising from, "
    "out of or in connection with the software or the use or other dealings in the software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission."
)
_BSD_NO_WARRANTY = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied '
    "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for "
    "any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not "
    "limited to, procurement of substitute goods or services; loss of use, data, or profits; or business "
    "interruption) however caused and on any theory of liability, whether in contract, strict liability, or "
    "tort (including negligence or otherwise) arising in any way out of the use of this software, even if "
    "advised of the possibility of such damage."
)
# Notices and short texts as the licences' owners word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
     "file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     'and associated documentation files (the "Software"), to deal in the Software without restriction, '
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
     "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions: The above copyright notice and this "
     f"permission notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_NO_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_NO_WARRANTY}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
     "in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
     "License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of "
     "the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
     "rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits, other runs of characters as one blank."""
    return F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^\\p{L}\\p{N}]+", " "), F.lit(" "))


def _pairs(words: Column) -> Column:
    """The pairs of neighbouring words; one word alone is its own pair."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.size(words)),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def template_pairs(
    spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> dict[int, tuple[str, list[str]]]:
    """License and bigrams, in their order, of each template; those without words are left out."""
    rows = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)], "id int, name string, text string"
    )
    words = F.filter(F.split(normalised(F.col("text")), " "), lambda w: w != "")
    rows = rows.select("id", "name", _pairs(words).alias("pairs")).collect()
    return {r.id: (r.name, r.pairs) for r in rows if r.pairs}


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """How many bigrams a set may have to reach the coefficient with one of ``n``."""
    # 2 * min(a, b) / (a + b) >= least; the slack keeps sizes that rounding would lose.
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def telling_bigrams(pairs: dict[int, tuple[str, list[str]]], least: float) -> dict[int, list[str]]:
    """Bigrams of which every passage like a template holds at least one, by template."""
    common = Counter(pair for _, own in pairs.values() for pair in set(own))
    chosen = {}
    for i, (_, own) in pairs.items():
        n = len(set(own))
        # The smallest passage allowed has to share this many.
        need = math.ceil(least * (n + size_bounds(n, least)[0]) / 2 - 1e-9)
        chosen[i] = sorted(set(own), key=lambda p: (common[p], -len(p), p))[: n - need + 1]
    return chosen


def _constant(value: object, schema: str) -> Column:
    """Nested data that Spark works out once, planning."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def windows_like(
    docs: DataFrame, pairs: dict[int, tuple[str, list[str]]], least: float
) -> DataFrame:
    """(row, doc_id, template, start, n_words, n, common): windows that reach ``least``."""
    telling = telling_bigrams(pairs, least)
    places: dict[str, list[dict]] = {}
    for i, (_, own) in pairs.items():
        chosen = set(telling[i])
        for at, pair in enumerate(own):
            if pair in chosen:
                places.setdefault(pair, []).append({"template": i, "at": at})
    # A template of one word is its own bigram, and has one word more than bigrams less.
    known = [
        {"n_words": len(own) + (" " in own[0]), "pairs": sorted(set(own)),
         "low": size_bounds(len(set(own)), least)[0], "high": size_bounds(len(set(own)), least)[1]}
        for own in (pairs[i][1] if i in pairs else [""] for i in range(max(pairs) + 1))
    ]
    templates = _constant(known, "array<struct<n_words:int,pairs:array<string>,low:int,high:int>>")
    placed = _constant(places, "map<string,array<struct<template:int,at:int>>>")
    found = sorted(places)
    singles = [p for p in found if " " not in p]

    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.split(normalised(F.coalesce(F.col("text"), F.lit(""))), " ").alias("words"),
    )
    # Spark moves filters below the columns they test and works those out once more for each
    # filter. It leaves them above a column that is not deterministic and is used.
    stay = F.monotonically_increasing_id().alias("_stay")
    paired = base.select("row", "doc_id", "words", _pairs(F.col("words")).alias("pairs"), stay)
    here = F.exists("pairs", lambda p: p.isin(found))
    if singles:
        here = here | F.exists("words", lambda w: w.isin(singles))
    paired = paired.filter((F.col("_stay") >= 0) & here)

    def starts(column: str, wanted: list[str]) -> Column:
        """Where windows of which templates begin, by the telling bigrams of a column."""
        numbered = F.transform(F.col(column), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        return F.flatten(
            F.transform(
                F.filter(numbered, lambda x: x["p"].isin(wanted)),
                lambda x: F.transform(
                    F.try_element_at(placed, x["p"]),
                    lambda e: F.struct(e["template"].alias("template"), (x["i"] - e["at"]).alias("start")),
                ),
            )
        )

    begun = starts("pairs", [p for p in found if " " in p])
    if singles:
        begun = F.concat(begun, starts("words", singles))

    def compared(window: Column) -> Column:
        template = F.get(templates, window["template"])
        first = F.greatest(window["start"], F.lit(0))
        last = F.least(window["start"] + template["n_words"], F.size("words"))
        inside = F.array_distinct(_pairs(F.slice(F.col("words"), first + 1, F.greatest(last - first, F.lit(0)))))
        return F.struct(
            window["template"].alias("template"),
            first.cast("bigint").alias("start"),
            (last - first).cast("bigint").alias("n_words"),
            F.size(inside).cast("bigint").alias("n"),
            F.size(F.array_intersect(inside, template["pairs"])).cast("bigint").alias("common"),
        )

    def alike(window: Column) -> Column:
        template = F.get(templates, window["template"])
        return window["n"].between(template["low"], template["high"]) & (
            2.0 * window["common"] / (window["n"] + F.size(template["pairs"])) >= least
        )

    windows = F.filter(F.transform(F.array_distinct(begun), compared), alike)
    return paired.select("row", "doc_id", F.explode(F.array_distinct(windows)).alias("w")).select("row", "doc_id", "w.*")


def _best_in_turn(found: DataFrame, *keys: str) -> DataFrame:
    """The best window of each stretch; ``keys`` name at most the windows of one row of docs."""
    end = F.col("start") + F.col("n_words")
    order = Window.partitionBy(*keys).orderBy("start", F.desc("n_words"), "template")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") + F.floor(F.col("n_words") / 2) >= before, F.lit(True))
    stretch = found.withColumn("opens", opens.cast("int")).withColumn("stretch", F.sum("opens").over(order))
    rank = ((-F.col("common")).alias("less"), (-F.col("dice")).alias("worse"), "license_id", "start", "n_words", "template")
    best = F.min(F.struct(*rank, *(F.col(c).alias(f"_{c}") for c in found.columns))).alias("b")
    held = [F.col(f"b._{c}").alias(c) for c in found.columns]
    return stretch.groupBy(*dict.fromkeys(("row", *keys)), "stretch").agg(best).select(*held)


def license_scan(
    docs: DataFrame,
    *,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least: float = LEAST_DICE,
) -> DataFrame:
    """One row per notice: where it stands and the best licence there.

    Columns: doc_id, start (number of its first word in the normalised text, from 0),
    n_words, license_id, dice and n_bigrams (distinct, of the window). Windows are taken by
    start, longer ones first; one whose middle lies before the end of an earlier one tells of the same
    notice, among windows of one template first, then among the best of all. Of these most
    shared bigrams count, then the highest coefficient, the first licence by name, the first
    and shortest window; so a notice in the middle of a longer one is not reported beside it. Null or
    empty texts, and texts without letters
    or digits, have no row. Rows that share a doc_id are scanned on their own and each give
    rows; a null doc_id is reported as null. Other columns are not read. No rows, or no
    templates, give none.
    """
    spark = docs.sparkSession
    pairs = template_pairs(spark, templates)
    if not pairs:
        return spark.createDataFrame(
            [], "doc_id bigint, start bigint, n_words bigint, license_id string, dice double, n_bigrams bigint"
        )
    names = spark.createDataFrame(
        [(i, name, len(set(own))) for i, (name, own) in pairs.items()],
        "template int, license_id string, n_template bigint",
    )
    found = windows_like(docs, pairs, least).join(F.broadcast(names), "template")  # a row a template
    found = found.withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("n_template")))
    noticed = _best_in_turn(_best_in_turn(found, "row", "template"), "row")
    return noticed.select("doc_id", "start", "n_words", "license_id", "dice", F.col("n").alias("n_bigrams"))
