"""Operator 10, license scans by MinHash bands over overlapping windows. DataFrame functions only.

Texts and templates are read as lower-case words [a-z0-9]+ and their shingles of 5 words; a template under five words is one
shingle of its own length. Templates of like length form a class with one window: its longest template has L words, windows
have L + step - 1 words and start every ``step`` words, so each passage of L words lies whole in one of them. A window that
holds ``containment`` of the n shingles of the class's shortest template has Jaccard similarity of at least
J = containment * n / (window shingles + (1 - containment) * n). A band is one minimum of the shingles' hashes after an
exclusive or with the band's constant; a class has as many bands as make the chance to miss such a window at most MISS:
(1 - J) ** bands <= MISS. The bands alone retrieve (window, template) pairs, by an equi-join on (class, band, value); a shingle
of a template that is no band's minimum retrieves nothing. As exclusive or can be undone, a template's value in a band is the
hash of one shingle, and a window has that minimum only if it holds that shingle; minima are taken for windows that hold such
a hash, all others can have no template's value. The shingles themselves, as strings, then verify the containment. The plan
grows with the classes (one for each power of about four in shingles), not with the templates. Templates are a parameter;
their band values are literals, and a table that Spark broadcasts only below its threshold.

Defined results: null and empty texts have no match; a template without words is an error; rows equal in doc_id and text are
one document; rows with a null doc_id are reported with a null doc_id; of several passages of one template the one with the
highest containment, then the first, is reported, by the first word of its window; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, let, table

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
#: The upper bounds of a class in shingles; a template of more shingles is of the class of its power of four.
SIZES = (1, 4, 12, 40)

#: Public license lines, notices and permission paragraphs.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-mark": "SPDX-License-Identifier: MIT",
    "apache-2.0-mark": "SPDX-License-Identifier: Apache-2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


@dataclass(frozen=True)
class Kind:
    """A class of templates: words of a shingle, of a window and between windows, and the number of bands."""

    shingle: int
    window: int
    step: int
    bands: int
    names: tuple[str, ...]

    @property
    def shingles(self) -> int:
        return self.window - self.shingle + 1


def _template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> tuple[int, list[str]]:
    """The words of a shingle, and the distinct shingles of a template."""
    words = _template_words(text)
    if not words:
        raise ValueError(f"a template without words: {text!r}")
    size = min(SHINGLE, len(words))
    return size, sorted({" ".join(words[i : i + size]) for i in range(len(words) - size + 1)})


def kinds(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS) -> list[Kind]:
    by: dict[tuple[int, int], list[str]] = {}
    for name, text in templates.items():
        size, own = template_shingles(text)
        top = next((s for s in SIZES if len(own) <= s), 4 ** math.ceil(math.log(len(own), 4)))
        by.setdefault((size, top), []).append(name)
    out = []
    for (size, _), names in sorted(by.items()):
        least = min(len(template_shingles(templates[n])[1]) for n in names)
        longest = max(len(_template_words(templates[n])) for n in names)
        step = max(1, (longest - size + 1) // 2)
        window = longest + step - 1
        j = containment * least / (window - size + 1 + (1 - containment) * least)
        # A window of one shingle holds the template whole or not at all.
        bands = 1 if window == size else math.ceil(math.log(miss) / math.log(1 - j))
        out.append(Kind(size, window, step, bands, tuple(names)))
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _grams(words: Column, size: int) -> Column:
    """The shingles of an array of words, as strings."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.concat_ws(" ", F.slice(words, i, size)))).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column, size: int) -> Column:
    """A hash of each shingle."""
    return F.transform(_grams(words, size), lambda s: F.xxhash64(s))


def constants(bands: int) -> list[int]:
    """The bands' constants: 0, then random 64-bit numbers."""
    rng = random.Random(20)
    return [0, *(rng.getrandbits(64) - (1 << 63) for _ in range(bands))][:bands]


def template_bands(spark, templates: dict[str, str], own: list[Kind]) -> dict[str, list[int]]:
    """The band values of each template."""
    rows = [(name, template_shingles(text)[1]) for name, text in templates.items()]
    hashed = {r["name"]: r["h"] for r in spark.createDataFrame(rows, "name string, s array<string>").select("name", F.transform("s", lambda s: F.xxhash64(s)).alias("h")).collect()}
    return {name: [min(h ^ c for h in hashed[name]) for c in constants(kind.bands)] for kind in own for name in kind.names}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, license, first_word, n_matched, n_shingles, containment) for every document and template found in it."""
    spark, own = docs.sparkSession, kinds(templates, containment, miss)
    marks = template_bands(spark, templates, own)
    rows = docs.select(F.col(key).alias("__k"), F.xxhash64(text).alias("__t"), _words(F.col(text)).alias("w"))

    def values(of: list[Kind]) -> Column:
        """The hashes that are a template's value in some band."""
        return F.array(*map(F.lit, sorted({v ^ c for kind in of for n in kind.names for v, c in zip(marks[n], constants(kind.bands), strict=True)})))

    def may_match(size: int) -> Column:
        of = [kind for kind in own if kind.shingle == size]
        found = let(F.col("w"), lambda w: F.arrays_overlap(_hashes(w, size), values(of)))
        if size == SHINGLE:
            return found
        # Short templates are one shingle; texts without its longest word need no hashes of that length.
        longest = sorted({max(_template_words(templates[n]), key=len) for kind in of for n in kind.names})
        return F.when(F.arrays_overlap("w", F.array(*map(F.lit, longest))), found).otherwise(F.lit(False))

    held = rows.where(reduce(lambda p, q: p | q, [may_match(size) for size in sorted({kind.shingle for kind in own})]))

    def windows(number: int, kind: Kind) -> Column:
        """array<struct<kind, band, value, first, words>> of the bands of the windows."""
        def found(h):
            def of_window(k):
                minima = lambda p: F.transform(F.array(*map(F.lit, constants(kind.bands))), lambda c: F.array_min(F.transform(p, lambda v: v.bitwiseXOR(c))))
                bands = lambda m: F.transform(m, lambda v, b: F.struct(F.lit(number).alias("kind"), b.alias("band"), v.alias("value"), (k * kind.step).cast("long").alias("first"), F.slice("w", k * kind.step + 1, kind.window).alias("words")))
                return let(F.slice(h, k * kind.step + 1, kind.shingles), lambda p: F.when(F.arrays_overlap(p, values([kind])), let(minima(p), bands)))

            count = F.ceil(F.greatest(F.size(h) - kind.shingles, F.lit(0)) / kind.step).cast("int")
            return F.when(F.arrays_overlap(h, values([kind])), F.flatten(F.filter(F.transform(F.sequence(F.lit(0), count), of_window), lambda x: x.isNotNull())))

        return F.coalesce(let(_hashes(F.col("w"), kind.shingle), found), F.array())

    pairs = held.select("__k", "__t", F.explode(F.concat(*[windows(i, kind) for i, kind in enumerate(own)])).alias("x")).select("__k", "__t", "x.*")
    goals = [(i, b, v, name, *template_shingles(templates[name])) for i, kind in enumerate(own) for name in kind.names for b, v in enumerate(marks[name])]
    goals = cut(spark.createDataFrame(goals, "kind int, band int, value long, license string, size int, goal array<string>"), "template-bands")
    hit = pairs.join(goals, ["kind", "band", "value"]).groupBy("__k", "__t", "license", "first").agg(F.first("words").alias("words"), F.first("goal").alias("goal"), F.first("size").alias("size"))
    shingles = reduce(lambda c, n: c.when(F.col("size") == n, _grams(F.col("words"), n)), range(1, SHINGLE), F.when(F.col("size") == SHINGLE, _grams(F.col("words"), SHINGLE)))
    sized = hit.withColumn("n_matched", F.size(F.array_intersect(shingles, "goal"))).withColumn("n_shingles", F.size("goal")).where(F.col("n_matched") >= containment * F.col("n_shingles"))
    best = sized.groupBy("__k", "__t", "license", "n_shingles").agg(F.max(F.struct("n_matched", (-F.col("first")).alias("back"))).alias("b"))
    return best.select(F.col("__k").alias(key), "license", (-F.col("b.back")).alias("first_word"), F.col("b.n_matched").cast("long").alias("n_matched"), F.col("n_shingles").cast("long").alias("n_shingles"), (F.col("b.n_matched") / F.col("n_shingles")).alias("containment"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(TEMPLATES[n])}, {kind.window}, {kind.step}, {kind.shingle})" for kind in kinds() for n in kind.names)
    sizes = ", ".join(f"({n})" for n in sorted({kind.shingle for kind in kinds()}))
    return f"""
WITH t(license, body, win, step, g) AS (VALUES {rows}),
tw AS (SELECT *, regexp_extract_all(lower(body), '[a-z0-9]+') AS ws FROM t),
ts AS (SELECT DISTINCT license, win, step, g, array_to_string(ws[i:i+g-1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(ws) - g + 1)) AS i FROM tw)),
n AS (SELECT license, count(*) AS n_shingles FROM ts GROUP BY license),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
ds AS (SELECT doc_id, rid, g, len(ws) AS nw, i - 1 AS pos, array_to_string(ws[i:i+g-1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(ws) - g + 1)) AS i FROM d, (VALUES {sizes}) AS z(g))),
h AS (SELECT doc_id, rid, license, pos, s, nw, win, step, g FROM ds JOIN ts USING (g, s)),
k AS (SELECT *, unnest(generate_series(greatest(0, ceil((pos + g - win) / step::DOUBLE))::INT, least(floor(pos / step::DOUBLE), ceil(greatest(nw - win, 0) / step::DOUBLE))::INT)) AS k FROM h),
c AS (SELECT doc_id, rid, license, k * step AS first_word, count(DISTINCT s) AS n_matched FROM k GROUP BY ALL),
b AS (SELECT c.*, n_shingles, row_number() OVER (PARTITION BY rid, license ORDER BY n_matched DESC, first_word) AS r FROM c JOIN n USING (license) WHERE n_matched >= {CONTAINMENT} * n_shingles)
SELECT doc_id, license, first_word::BIGINT AS first_word, n_matched, n_shingles, n_matched / n_shingles::DOUBLE AS containment FROM b WHERE r = 1"""


QUERIES = {"op10_license_scan": op10_license_scan}
SQL = {"op10_license_scan": _oracle()}
