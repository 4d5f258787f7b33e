"""License scans with MinHash bands over overlapping windows (operator 2).

A template is a licence notice; its shingles are runs of ``SHINGLE`` words
(lower-cased A-Z, digits and non-ASCII characters).  Templates of one length
``t`` are looked for in windows of ``t + s - 1`` words, one every
``s = max(1, t // 4)`` words, so any run of ``t`` words lies whole in a window.
Windows and templates are MinHashed; equal bands retrieve templates, and a
retrieved pair is a match if the window holds at least ``CONTAINMENT`` of the
template's shingles, which is tested exactly.

A window that holds such a share has Jaccard similarity of ``least_jaccard``
or more with the template; ``BANDS`` bands of ``ROWS`` rows then miss it with
probability below one in a million (``miss_probability``).

Only windows near a key word are hashed.  Key words are chosen per template so
that its shingles without one are fewer than ``CONTAINMENT`` of all: every
match holds a key word, and none is lost.

Everything runs as DataFrame expressions.  Texts are cut to windows once; these
are written with a number for each row, by which matches come back.  Templates
are an argument of the plan, ``MOST_TEMPLATES`` at a time, and the only side
that is broadcast.

Edge cases: null and empty texts match nothing; each row of the table gets its
own result, also where ids are null or equal and where whole rows are repeated.
Extra columns are ignored by ``license_scan`` and kept by ``license_matches``,
whatever their names.  An empty table gives no rows, and without a template
nothing matches.  A notice inside a very long text is found like any other.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange

SHINGLE = 5
CONTAINMENT = 0.8
ROWS, BANDS = 2, 40
MOST_TEMPLATES = 500
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: notices by SPDX-like id (fixed values: the published wording)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "GPL-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def stride(t: int) -> int:
    return max(1, t // 4)


def least_jaccard(t: int) -> float:
    """The smallest similarity of a matching window of a template of ``t`` words, if no shingle of either is repeated."""
    n, window = max(1, t - SHINGLE + 1), max(1, t + stride(t) - SHINGLE)
    common = math.ceil(CONTAINMENT * n - 1e-9)
    return common / (n + window - common)


def miss_probability(j: float) -> float:
    return (1 - j**ROWS) ** BANDS


def key_words(template: list[str]) -> set[str]:
    """Words that some shingle of every match must hold; the longest words first, as they are rare."""
    runs = [set(template[i : i + SHINGLE]) for i in range(max(1, len(template) - SHINGLE + 1))]
    chosen: set[str] = set()
    for w in sorted(set(template), key=lambda w: (-len(w), w)):
        if sum(not (r & chosen) for r in runs) < math.ceil(CONTAINMENT * len(runs) - 1e-9):
            break
        chosen.add(w)
    return chosen


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _bands(shingles: Column) -> Column:
    """Struct array of band number and key."""
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))

    def least_of(k: int) -> Column:
        return F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, F.lit(k))))

    least = [least_of(k) for k in range(ROWS * BANDS)]
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*least[b * ROWS : (b + 1) * ROWS]).alias("bucket")) for b in range(BANDS)])


def _let(value: Column, body) -> Column:
    """``body`` of a column that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(text: Column, sizes: dict[int, set[str]]) -> Column:
    """Array of (t, window_start, words): the windows near a key word, for templates of each length t."""
    every = sorted(set().union(*sizes.values()))
    classes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(stride(t)).alias("s"), F.array(*map(F.lit, sorted(k))).alias("keys")) for t, k in sorted(sizes.items())])

    def of_class(words: Column, held: Column, c: Column) -> Column:
        t, s = c["t"], c["s"]
        at = F.filter(held, lambda i: F.array_contains(c["keys"], F.get(words, i)))
        near = F.flatten(F.transform(at, lambda p: F.sequence(F.floor(F.greatest(p - t - s + 2, F.lit(0)) / s).cast("int"), F.floor(p / s).cast("int"))))
        cut = F.transform(F.array_distinct(near), lambda k: F.struct(t.alias("t"), (k * s).alias("window_start"), F.slice(words, k * s + 1, t + s - 1).alias("w")))
        return F.filter(cut, lambda x: F.size(x["w"]) >= F.least(F.lit(SHINGLE), t))

    def of_words(words: Column) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(F.array(*map(F.lit, every)), F.get(words, i)))
        return _let(held, lambda at: F.flatten(F.transform(classes, lambda c: of_class(words, at, c))))

    # few texts hold a key word at all, be it in another word or case; the others are not cut to words
    least = [w for w in every if not any(v != w and v in w for v in every)]
    low = F.lower(text)
    may = functools.reduce(operator.or_, [low.contains(w) for w in least])
    return F.when(may, _let(_words(text), lambda w: F.when(F.size(w) > 0, of_words(w))))


def _judged(windows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(t, w, license_id, containment) of each distinct window that matches a template."""
    spark = windows.sparkSession
    notes = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(len(w)).alias("t"), F.array(*map(F.lit, w)).alias("w")) for k, w in wanted.items()])
    notes = spark.range(1).select(F.explode(notes).alias("n")).select("n.license_id", F.col("n.t").alias("nt"), _shingles(F.col("n.w")).alias("template"))
    keys = notes.withColumn("y", F.explode(_bands(F.col("template"))))
    distinct = windows.select("t", "w").distinct().withColumn("shingles", _shingles(F.col("w")))
    banded = distinct.withColumn("x", F.explode(_bands(F.col("shingles"))))
    same = (F.col("t") == F.col("nt")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket"))
    hits = banded.join(F.broadcast(keys), same).select("t", "w", "shingles", "license_id", "template").distinct()
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    return hits.select("t", "w", "license_id", share.alias("containment")).where(F.col("containment") >= CONTAINMENT - 1e-9)


def _scanned(docs: DataFrame, templates: dict[str, str] | None, text_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with numbers and the ``keep`` columns as c0, c1, ...; and their matches: row, license_id, window_start, containment."""
    wanted = {k: words_of(t) for k, t in (TEMPLATES if templates is None else templates).items()}
    wanted = {k: w for k, w in wanted.items() if w}
    kept = [exchange.quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]
    found = None
    names = sorted(wanted)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *kept, exchange.quoted(text_col).cast("string").alias("text"))
    groups = [names[a : a + MOST_TEMPLATES] for a in range(0, len(names), MOST_TEMPLATES)] or [[]]
    plans = []
    for g, group in enumerate(groups):
        sizes: dict[int, set[str]] = {}
        for k in group:
            sizes.setdefault(len(wanted[k]), set()).update(key_words(wanted[k]))
        none = F.lit(None).cast("array<struct<t:int,window_start:int,w:array<string>>>")
        rows = rows.withColumn(f"windows{g}", _windows(F.col("text"), sizes) if sizes else none)
        plans.append({k: wanted[k] for k in group})
    # written once: it fixes the row numbers, and texts are cut to words once only
    rows = exchange.materialize(rows.drop("text"), "windows")
    for g, group in enumerate(plans):
        windows = rows.select("row", F.inline(f"windows{g}"))
        if not group:
            here = windows.select("row", F.lit("").alias("license_id"), "window_start", F.lit(0.0).alias("containment"))
        else:
            hits = _judged(windows, group).groupBy("t", "w").agg(F.collect_list(F.struct("license_id", "containment")).alias("found"))
            hits = hits.select(F.col("t").alias("ht"), F.col("w").alias("hw"), "found")
            held = exchange.lookup(windows, hits, {"key": F.reverse("w"), "key2": -F.col("t")}, {"key": F.reverse("hw"), "key2": -F.col("ht")}, "inner")
            here = held.select("row", "window_start", F.inline("found")).select("row", "license_id", "window_start", "containment")
        found = here if found is None else found.unionByName(here)
    return rows, found


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Verified matches: ``keep`` columns (all if none are named), license_id, window_start (in words), containment.

    A kept column with the name of one of these three is left out.
    """
    keep = docs.columns if keep is None else keep
    rows, found = _scanned(docs, templates, text_col, keep)
    made = ("license_id", "window_start", "containment")
    shown = rows.select(F.col("row").alias("r"), *[F.col(f"c{i}") for i in range(len(keep))])
    held = found.join(shown.hint("merge"), F.col("row") == F.col("r"))
    return held.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in made], *made)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_licenses, license_ids (sorted, comma-joined; empty if none)."""
    rows, found = _scanned(docs, templates, text_col, [id_col])
    named = found.groupBy(F.col("row").alias("m")).agg(F.sort_array(F.collect_set("license_id")).alias("ids"))
    out = rows.select("row", F.col("c0").alias("doc_id")).join(named.hint("merge"), F.col("row") == F.col("m"), "left")
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("license_ids"))
