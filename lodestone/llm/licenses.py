"""License scans: the Dice coefficient over word bigrams between normalised text and licence templates.

The units compared are a document's lines, its paragraphs (between blank lines) and the document itself.  A template with
b bigrams can reach a coefficient of t only against a unit with t / (2 - t) * b to (2 - t) / t * b bigrams.  Those sizes
are an equi-join key: the template table holds one row for each template and size it may meet, so a unit meets only the
templates that its size allows, and most units none.  The template table's size is fixed by the templates, not the data.

A notice among other words, or in a comment block, is found by windows over the document's whole word sequence, of every
length that can reach t.  Such a window misses fewer than b - t / (2 - t) * b + 1 of the template's bigrams, so it holds one
of so many *anchors*, those with the longest words: windows are looked at only around anchors, which are an equi-join key as
well.  For the same reason a unit that matches holds an anchor, so texts and units without the longer word of any anchor (its
*gate*) are left out before bigrams are made of them.  A window counts only for a licence that no unit of the document matches.  A unit or window never counts for a template
if a similar template of another licence fits it better.

A window of a document does not count if a licence with a similar template fits another part of the document better, and a
licence whose template lies within one of another licence (two clauses within three) does not count in a
document that the other licence is found in.

Defined cases: null and blank texts match nothing; every input row gives a row; ties go to the smaller licence id.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.85
#: Licence notices, several wordings to an id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Licences and the identifiers that an SPDX line may give for each.
SPDX = (
    ("AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("Apache-2.0", ("Apache-2.0",)),
    ("BSD-2-Clause", ("BSD-2-Clause",)),
    ("BSD-3-Clause", ("BSD-3-Clause",)),
    ("BSL-1.0", ("BSL-1.0",)),
    ("CC-BY-4.0", ("CC-BY-4.0",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4.0",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4.0",)),
    ("CC0-1.0", ("CC0-1.0",)),
    ("EPL-2.0", ("EPL-2.0",)),
    ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+")),
    ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+")),
    ("ISC", ("ISC",)),
    ("LGPL-2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+")),
    ("LGPL-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+")),
    ("MIT", ("MIT",)),
    ("MPL-2.0", ("MPL-2.0",)),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("Zlib",)),
)
TEMPLATES = (*TEMPLATES, *((name, f"SPDX-License-Identifier: {id_}") for name, ids in SPDX for id_ in ids if not id_.endswith("+")))  # a + is no word
NOT_WORD = r"[^a-z0-9]+"
WINDOW = "struct<key:string,grams:array<string>,at:int>"


def bigrams_of(words: Column) -> Column:
    """Distinct bigrams of the normalised words; one word alone counts as a bigram, no word gives none."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _grams(text: str) -> list[str]:
    words = [w for w in re.split(NOT_WORD, text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) if len(words) > 1 else words


def _gate(gram: str) -> str:
    """The word of a bigram that a text is first searched for."""
    return max(gram.split(" "), key=lambda w: (len(w), w))


class Templates:
    """Bigrams, size bounds, anchors and similar templates of other licences, of each template."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float) -> None:
        grams = [_grams(text) for _, text in templates]
        self.rows, self.keys, gates = [], [], []
        for at, (name, _) in enumerate(templates):
            own = grams[at]
            low, high = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9), math.floor(len(own) * (2 - threshold) / threshold + 1e-9)
            rivals = [g for (other, _), g in zip(templates, grams) if other != name and 2 * len({*g} & {*own}) > 0.5 * (len(g) + len(own))]
            self.rows.append((name, own, low, high, rivals))
            anchors = sorted(own, key=lambda g: (-len(_gate(g)), g))[: len(own) - low + 1]
            gates += anchors
            self.keys += [(f"#{size}", at) for size in range(low, high + 1)] + [(a, at) for a in anchors if " " in a]
        holds = lambda small, large: len({*small} & {*large}) >= 0.95 * len(small) and len(large) > 1.5 * len(small)
        #: Licence -> licences that have all of a template of it within one of theirs.
        self.above: dict[str, list[str]] = {}
        for name in sorted({n for n, _ in templates}):
            over = {other for (n, _), small in zip(templates, grams) for (other, _), large in zip(templates, grams) if n == name != other and holds(small, large)}
            if over:
                self.above[name] = sorted(over)
        #: Licence -> licences that have a template similar to one of its own.
        self.near: dict[str, list[str]] = {}
        for (name, _), row in zip(templates, self.rows):
            others = {n for (n, _), g in zip(templates, grams) if g in row[4] and n != name}
            self.near[name] = sorted({*self.near.get(name, ()), *others})
        self.anchors = sorted({key for key, _ in self.keys if not key.startswith("#")})
        self.gates = sorted({_gate(a) for a in gates})
        self.reach = max((high for _, _, _, high, _ in self.rows), default=0)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(key, license_id, template, low, high, rivals) under each unit size (as #size) and anchor that may meet a template."""
        rows = [(key, *self.rows[at]) for key, at in self.keys]
        return spark.createDataFrame(rows, "key string, license_id string, template array<string>, low int, high int, rivals array<array<string>>")


def _dice(grams: Column, template: Column) -> Column:
    return 2 * F.size(F.array_intersect(grams, template)) / (F.size(F.array_distinct(grams)) + F.size(template))


def _windows(made: Templates, words: Column) -> Column:
    """(key, grams, at) around each anchor in the words: the bigrams that a window through the anchor can reach."""
    grams = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))

    def around(anchor: Column, grams: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.element_at(grams, i) == anchor)
        return F.transform(places, lambda i: F.struct(anchor.alias("key"), F.slice(grams, F.greatest(i - made.reach, F.lit(1)), 2 * made.reach).alias("grams"), F.least(i, F.lit(made.reach + 1)).alias("at")))

    # the one-element array makes the bigrams once for all anchors
    found = F.flatten(F.transform(F.array(grams), lambda g: F.flatten(F.transform(F.array_intersect(g, _literal(made.anchors)), lambda a: around(a, g)))))
    return F.when(F.size(words) > 1, found)


def _literal(values: list[str]) -> Column:
    return F.lit(values) if values else F.array().cast("array<string>")


def _best_window(grams: Column, at: Column, template: Column, low: Column, high: Column) -> Column:
    """The bigrams of the window around ``at`` with the largest coefficient; it starts and ends with bigrams of the template."""
    near = F.slice(grams, F.greatest(at - high, F.lit(1)), 2 * high)
    hits = F.transform(
        F.array(near), lambda n: F.struct(n.alias("n"), F.filter(F.sequence(F.lit(1), F.size(n)), lambda i: F.array_contains(template, F.element_at(n, i))).alias("m"))
    )

    def of(hit: Column) -> Column:
        n, m = hit["n"], hit["m"]
        last = F.size(m) - low + 1
        ends = lambda i: F.filter(F.slice(m, i + low - 1, F.size(m)), lambda j: j - F.element_at(m, i) < high)
        spans = F.flatten(F.transform(F.sequence(F.lit(1), last), lambda i: F.transform(ends(i), lambda j: F.slice(n, F.element_at(m, i), j - F.element_at(m, i) + 1))))
        return F.when(last >= 1, F.array_max(F.transform(spans, lambda w: F.struct(_dice(w, template).alias("d"), w.alias("w"))))["w"])

    return F.element_at(F.transform(hits, of), 1)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For every row of ``docs``: doc_id, the best match (license_id, dice; null if none) and all licences found."""
    made = Templates(templates, threshold)
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, r"\n[\x20\t\r]*\n", -1), F.array(text)))
    pieces = F.concat(
        F.transform(units, lambda u: F.struct(u.alias("unit"), F.lit(None).cast(WINDOW).alias("window"))),
        F.transform(F.coalesce(F.col("windows"), F.array().cast(f"array<{WINDOW}>")), lambda w: F.struct(F.lit(None).cast("string").alias("unit"), w.alias("window"))),
    )
    words = F.array_remove(F.split(F.lower(text), NOT_WORD, -1), "")
    gates = _literal(made.gates)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text", words.alias("words")).withColumn("gated", F.arrays_overlap("words", gates))
    rows = rows.withColumn("windows", F.when(F.col("gated"), _windows(made, F.col("words"))))
    rows = rows.select("doc_id", "_row", F.explode_outer(F.when(F.col("gated"), pieces)).alias("piece"))
    rows = rows.select("doc_id", "_row", F.col("piece.window").alias("window"), F.array_remove(F.split(F.lower("piece.unit"), NOT_WORD, -1), "").alias("words"))
    unit = F.col("window").isNull() & F.arrays_overlap("words", gates)
    rows = rows.withColumn("grams", F.when(unit, bigrams_of(F.col("words")))).drop("words")
    rows = rows.withColumn("key", F.coalesce(F.col("window.key"), F.concat(F.lit("#"), F.size("grams"))))
    joined = rows.join(F.broadcast(made.frame(docs.sparkSession)), "key", "left")
    best_window = _best_window(F.col("window.grams"), F.col("window.at"), F.col("template"), F.col("low"), F.col("high"))
    joined = joined.withColumn("span", F.when(F.col("window").isNull(), F.col("grams")).when(F.col("template").isNotNull(), best_window))
    scored = joined.withColumn("dice", _dice(F.col("span"), F.col("template")))
    fits = (F.col("dice") >= threshold) & ~F.exists("rivals", lambda r: _dice(F.col("span"), r) > F.col("dice"))
    scored = scored.select("doc_id", "_row", "license_id", "dice", fits.alias("good"), F.col("window").isNotNull().alias("wide"))
    # of each licence: its best unit, or else its best window
    hit = F.struct("license_id", "wide", (-F.col("dice")).alias("d"))
    found = scored.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("good"), hit))).alias("hits"))
    ids = F.array_distinct(F.transform("hits", lambda h: h["license_id"]))
    firsts = F.transform(ids, lambda i: F.element_at(F.filter("hits", lambda h: h["license_id"] == i), 1))
    seen = ids
    within = lambda i: functools.reduce(lambda a, x: a | ((i == x[0]) & F.arrays_overlap(seen, F.lit(x[1]))), made.above.items(), F.lit(False))
    # a window is the best part of a text for its template, so a similar licence that fits some part better is the one meant
    every = firsts
    better = lambda h: functools.reduce(
        lambda a, x: a | ((h["license_id"] == x[0]) & F.exists("hits", lambda o: o["license_id"].isin(x[1]) & (o["d"] < h["d"]))), [x for x in made.near.items() if x[1]], F.lit(False)
    )
    firsts = F.filter(every, lambda h: ~within(h["license_id"]) & ~(h["wide"] & better(h)))
    ids = F.transform(firsts, lambda h: h["license_id"])
    found = found.select("doc_id", ids.alias("licenses"), F.array_min(F.transform(firsts, lambda h: F.struct(h["d"].alias("d"), h["license_id"].alias("license_id")))).alias("best"))
    return found.select("doc_id", F.col("best.license_id").alias("license_id"), (-F.col("best.d")).alias("dice"), "licenses")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license_id", F.round("dice", 6).alias("dice"), F.array_join("licenses", ",").alias("licenses"))
