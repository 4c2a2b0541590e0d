"""License scan by MinHash bands over overlapping windows, in DataFrame functions only.

Words are runs of a-z and 0-9 after lower-casing; shingles are five words.  Of a
text, only the shingles that some template has matter: they are its hits, in their
order.  A template belongs to the smallest size class c (a power of two) that its
number of shingles fits.  For each class the hits are covered by windows of 2c hits,
c apart: any stretch of c hits lies in a window whole.  A passage of any length that
is put into a template has no hits, so it parts no window.  A window that holds a
share of at least ``CONTAINED`` of a template, itself of more than c / 2 shingles, has
a Jaccard similarity of at least ``FLOOR`` to it, and with ``BANDS`` bands of one row
it meets the template with a probability of at least 1 - (1 - FLOOR) ** BANDS >
0.9999.  Candidates are verified: the share of the template's distinct shingles in
the window must be at least 0.8.

Windows with too few distinct hits for any template of their class are not made.
Templates and their bands are a fixed table of this module or of the caller (at most
``MOST`` shingles in all, more are refused), so they are what is broadcast.

One-line notices (``NOTICES``) and templates of fewer than five words are matched
word for word at every place of a text, by windows of their number of words; where
several begin at one word, the longest is meant ("version 2.1" is not "version 2").

Defined results: a null or blank text has no licenses; repeated rows each get a
row; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .scratch import Scratch

WORDS = 5
CONTAINED = 80
BANDS = 48
FLOOR = 0.18
MOST = 100_000

#: Public notices by their SPDX names.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


_VERBS = ("Licensed under {}", "Licensed under the {}", "Licensed under a {}", "Released under {}", "Released under the {}", "Released under a {}", "Distributed under the {}", "Available under the {}", "Provided under the {}", "Published under {}")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("LGPL", "GNU Library General Public License", ("2.0",)), ("AGPL", "GNU Affero General Public License", ("3.0",)))


def _named() -> dict[str, list[str]]:
    """What licenses are called, by SPDX id."""
    out = {
        "MIT": ["MIT", "MIT License"],
        "MIT-0": ["MIT-0", "MIT No Attribution License"],
        "Apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0"],
        "BSD": ["BSD", "BSD License", "BSD-style License"],
        "0BSD": ["0BSD", "Zero-Clause BSD License"],
        "ISC": ["ISC", "ISC License"],
        "EPL-2.0": ["EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
        "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal"],
        "Unlicense": ["Unlicense"],
        "Zlib": ["zlib License"],
        "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    }
    for n, more in (("2", ["Simplified BSD", "FreeBSD"]), ("3", ["New BSD", "Modified BSD", "Revised BSD"]), ("4", ["Original BSD"])):
        out[f"BSD-{n}-Clause"] = [x + y for x in (f"BSD {n}-Clause", f"{n}-Clause BSD", *more) for y in ("", " License")]
    for v in ("1.1", "2.0"):
        out[f"MPL-{v}"] = [f"MPL {v}", f"Mozilla Public License {v}", f"Mozilla Public License, v. {v}", f"Mozilla Public License, v{v}", f"Mozilla Public License, Version {v}"]
    for kind, said in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{kind}-{v}"] = [f"{x} {v}{y}" for x in (f"CC {kind}", f"Creative Commons {said}") for y in ("", " International", " International License", " Unported License", " License")]
    for short, long, versions in _GNU:
        for v in versions:
            spelt = [v, f"v{v}", f"version {v}"] + ([v[0], f"v{v[0]}", f"version {v[0]}"] if v.endswith(".0") else [])
            out[f"{short}-{v}"] = [*(f"{x} {y}" for x in (long, long.removeprefix("GNU "), short, f"GNU {short}") for y in spelt), *(f"{short}{y}" for y in spelt if y[0] == "v")]
    return out


def _notices() -> dict[str, list[str]]:
    out = {"All-Rights-Reserved": ["All rights reserved"]}
    for name, called in _named().items():
        ids = [name, f"{name}-only", f"{name}-or-later", f"{name}+"] if "GPL" in name else [name] * (name != "BSD")
        out[name] = [*(v.format(x) for x in called for v in _VERBS), *(f"SPDX-License-Identifier: {x}" for x in ids)]
    return out


#: One-line notices and SPDX identifiers by SPDX names.
NOTICES = _notices()


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)] if len(w) >= WORDS else [" ".join(w)] * bool(w)


def _shingles(words: Column) -> Column:
    """A 64-bit hash of the shingle at each word."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))))
    few = F.array(F.xxhash64(*(F.coalesce(F.get(words, F.lit(k)), F.lit("")) for k in range(WORDS))))
    return F.when(F.size(words) >= WORDS, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]++"), 0)


def _hits(shingles: Column, known: list[int]) -> Column:
    """The shingles that templates have, each with its place in the text."""
    placed = F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    any_known = F.arrays_overlap(shingles, F.array(*map(F.lit, known)).cast("array<bigint>"))
    return F.when(any_known, F.filter(placed, lambda x: x["h"].isin(known))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))


def _minima(shingles: Column) -> Column:
    """The smallest hash of the set under each of BANDS seeds."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def _class(n: int) -> int:
    return 1 << (n - 1).bit_length() if n > 1 else 1


def _table(spark, templates: dict[str, list[str]]) -> tuple[DataFrame, list[int]]:
    rows = [(f"{name}#{i}", name, text, _class(len(set(shingles_of(text))))) for name, texts in templates.items() for i, text in enumerate(texts) if len(words_of(text)) >= WORDS]
    if sum(len(shingles_of(r[2])) for r in rows) > MOST:
        raise ValueError("templates are too large to broadcast")
    df = spark.createDataFrame(rows, "template string, license string, body string, size int")
    return df.select("template", "license", "size", F.array_distinct(let(_words(F.col("body")), _shingles)).alias("ts")), sorted({r[3] for r in rows})


def _exact(templates: dict[str, list[str]], notices: dict[str, list[str]]) -> dict[str, set[str]]:
    """Licenses by the words of notices that are matched word for word."""
    out: dict[str, set[str]] = {}
    for source, most in ((templates, WORDS - 1), (notices, None)):
        for name, texts in source.items():
            for w in map(words_of, texts):
                if w and (most is None or len(w) <= most):
                    out.setdefault(" ".join(w), set()).add(name)
    return out


def _tree(notices: list[list[str]]) -> str:
    """A pattern of the longest of the notices that a text begins with, its words with a space after each."""
    heads: dict[str, list[list[str]]] = {}
    for w in notices:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    inner = "|".join(f"{head} {_tree(rest)}" for head, rest in sorted(heads.items()))
    return f"(?:{inner}){'?' if [] in notices else ''}" if inner else ""


def _places(words: Column, exact: dict[str, set[str]]) -> Column:
    """at, notice of each exact notice among the words."""
    if not exact:
        return F.array().cast("array<struct<at: int, notice: string>>")
    notices = [n.split() for n in exact]
    alone = {n[0] for n in notices if len(n) == 1}
    second = sorted({n[1] for n in notices if len(n) > 1})
    longest, pattern = max(map(len, notices)), f"^{_tree(notices)}"

    def begins(w: Column, i: Column) -> Column:
        next_fits = F.coalesce(F.get(words, i + 1).isin(second), F.lit(False)) if second else F.lit(False)
        return w.isin(sorted({n[0] for n in notices})) & (next_fits | w.isin(sorted(alone)) if alone else next_fits)

    starts = F.filter(F.transform(words, lambda w, i: F.when(begins(w, i), i)), lambda i: i.isNotNull())
    found = F.transform(starts, lambda i: F.struct(i.alias("at"), F.rtrim(F.regexp_extract(F.concat(F.array_join(F.slice(words, i + 1, longest), " "), F.lit(" ")), pattern, 0)).alias("notice")))
    return F.filter(found, lambda x: x["notice"] != "")


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (sorted names), spans (license:first word:last word of the windows' matching parts, sorted)."""
    spark = docs.sparkSession
    keep = Scratch(spark, "licenses")
    exact = _exact(templates or TEMPLATES, notices if notices is not None else {} if templates else NOTICES)
    table, classes = _table(spark, templates or TEMPLATES)
    # Literals: a bounded table's shingles.
    known = [r[0] for r in table.select(F.explode("ts")).distinct().collect()]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("t"))
    seen = let(_words(F.col("t")), lambda w: F.struct(let(_shingles(w), lambda s: _hits(s, known)).alias("hits"), _places(w, exact).alias("places")))
    found = keep.keep(rows.select("doc_id", "row", seen.alias("x")).select("doc_id", "row", "x.hits", "x.places"), "hits")
    table = keep.keep(table, "templates")

    sizes = F.array(*map(F.lit, classes))
    near = found.where(F.size("hits") > 0).select("row", "hits", F.explode(sizes).alias("size"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("hits") - F.col("size") - 1, F.lit(0)), F.col("size")))
    windows = near.select("row", "size", "hits", at.alias("at")).select("row", "size", "at", F.slice("hits", F.col("at") + 1, 2 * F.col("size")).alias("ws"))
    # A template of this class has more than size / 2 shingles, and CONTAINED in 100 of them must be there.
    windows = windows.withColumn("set", F.array_distinct("ws.h")).where(F.lit(200) * F.size("set") >= F.lit(CONTAINED) * F.col("size"))
    windows = keep.keep(windows, "windows")
    banded = windows.select("row", "size", "at", F.posexplode(_minima(F.col("set"))).alias("band", "low"))
    bands = table.select("template", "size", F.posexplode(_minima(F.col("ts"))).alias("band", "low"))
    pairs = banded.join(F.broadcast(bands), ["size", "band", "low"]).select("row", "size", "at", "template").distinct()
    hits = pairs.join(windows, ["row", "size", "at"]).drop("size")
    checked = hits.join(F.broadcast(table.drop("size")), "template").where(F.lit(100) * F.size(F.array_intersect("set", "ts")) >= F.lit(CONTAINED) * F.size("ts"))
    inside = F.transform(F.filter("ws", lambda x: F.array_contains("ts", x["h"])), lambda x: x["i"])
    spans = checked.select("row", "license", F.concat_ws(":", "license", F.array_min(inside).cast("string"), (F.array_max(inside) + WORDS - 1).cast("string")).alias("span"))
    named = spark.createDataFrame([(n, len(n.split()), sorted(ls)) for n, ls in exact.items()], "notice string, length int, licenses array<string>")
    placed = found.select("row", F.explode("places").alias("p")).select("row", "p.at", "p.notice").join(F.broadcast(named), "notice").select("row", "at", "length", F.explode("licenses").alias("license"))
    spans = spans.union(placed.select("row", "license", F.concat_ws(":", "license", F.col("at").cast("string"), (F.col("at") + F.col("length") - 1).cast("string"))))
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("names"), F.array_sort(F.collect_set("span")).alias("spans"))
    out = found.select("doc_id", "row").join(by_row, "row", "left")
    return out.select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce(F.array_join("spans", ","), F.lit("")).alias("spans"))
