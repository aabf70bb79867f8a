"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every place of a file that speaks of licensing gives windows of words around the cue, as long as the templates are and across
line breaks on both sides; a licence file (by its name) gives its whole text, too. An SPDX tag that names a template's licence
(the first of an expression, without -only, -or-later or +) scores 1. A window is scored against each template by the cosine of sparse TF-IDF
vectors; words that no template has count in the window's length as the rarest words do. The document frequencies of the
templates' words are counted over all files. A file's own licence is the best score of at least ``THRESHOLD``,
of the licences in ``WEAK`` only where no other has one; equal scores go to the first by name. Files
without one inherit from the deepest ancestor directory that holds a licence file with one, by joins on the path.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small
from .scratch import Scratch

THRESHOLD = 0.7
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
)
_MIT_HEAD = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_MIT_TAIL = (
    ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR '
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
    "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
    "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
#: The notices, titles and texts by which each licence is known.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license", _MIT_HEAD, _MIT_HEAD + _MIT_TAIL),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "EPL-2.0": ("This program is made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", _BOOST),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", f"{_BSD_HEAD}: {_BSD_TWO}{_BSD_TAIL}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", f"{_BSD_HEAD}: {_BSD_TWO}{_BSD_THIRD}{_BSD_TAIL}"),
    "BSD": (_BSD_HEAD,),
    "ISC": ("Licensed under the ISC License", _ISC),
    "Zlib": ("Licensed under the zlib License", _ZLIB),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", _UNLICENSE),
    "Proprietary": ("All rights reserved.", "Confidential and proprietary. All rights reserved."),
}
#: These say least: they count only in a file where no other licence reaches the threshold.
WEAK = ("BSD", "Proprietary")
CUE = r"(?i)licen[cs]|copyright|rights\W+reserved|public\W+domain|permission\W+is\W+hereby|permission\W+to\W+use|permission\W+is\W+granted|redistribution\W+and\W+use|creative\W+commons|waived\W+all"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"
_CUE, _FILE = re.compile(CUE), re.compile(LICENCE_FILE)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_SPDX = re.compile(r"spdx-license-identifier\s*:[\s(]*([a-z0-9.-]*[a-z0-9])")
WORD_SPLIT = r"[^a-z0-9.]+"


def words(text: str) -> list[str]:
    """Lower-case words; version numbers stay whole."""
    return _WORD.findall(text.lower())


class Scorer:
    """Cosines to the templates under given document frequencies."""

    def __init__(self, frequency: dict[str, int], n: int, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.rarest = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + min(n, frequency.get(w, 0)))) + 1 for w in vocabulary(templates)}
        self.templates: list[str] = []
        self.holds: dict[str, list[tuple[int, float]]] = {}
        sizes = []
        for name in sorted(templates):
            for text in templates[name]:
                tokens = words(text)
                v, norm = self._vector(tokens)
                for w, x in v.items():
                    self.holds.setdefault(w, []).append((len(self.templates), x / norm))
                self.templates.append(name)
                sizes.append(len(tokens))
        self.names = {name.lower(): name for name in templates}
        self.sizes = sorted(set(sizes))
        self.of_size = {s: {k for k, n in enumerate(sizes) if s <= 2 * n and n <= 2 * s} for s in self.sizes}

    def _vector(self, tokens: list[str]) -> tuple[dict[str, float], float]:
        counts = Counter(tokens)
        v = {w: c * self.idf.get(w, self.rarest) for w, c in counts.items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def cosines(self, tokens: list[str]) -> dict[int, float]:
        """Of the templates that share a word."""
        v, norm = self._vector(tokens)
        out: dict[int, float] = {}
        for w, x in v.items():
            for k, y in self.holds.get(w, ()):
                out[k] = out.get(k, 0.0) + x * y / norm
        return out

    def scan(self, path: str | None, text: str | None) -> tuple[float, str | None]:
        """The best of a file's windows: (score, licence)."""
        found: dict[str, float] = {}
        if not text:
            return 0.0, None

        def note(tokens: list[str], size: int | None) -> None:
            for k, score in self.cosines(tokens).items():
                if size is None or k in self.of_size[size]:
                    name = self.templates[k]
                    found[name] = max(found.get(name, 0.0), score)

        if _FILE.search((path or "").rsplit("/", 1)[-1]):
            note(words(text), None)
        low = text.lower()
        for m in _SPDX.finditer(low):
            name = self.names.get(re.sub("-only$|-or-later$", "", m[1]))
            if name:
                found[name] = 1.0
        places = list(_WORD.finditer(low))
        tokens, starts = [m[0] for m in places], [m.start() for m in places]
        seen = set()
        for m in _CUE.finditer(low):
            cue = bisect_left(starts, m.start())
            line = bisect_left(starts, low.rfind("\n", starts[max(0, cue - self.sizes[-1])] if cue else 0, m.start()) + 1)
            for size in self.sizes:
                first, step = max(0, cue - size + 1), max(1, size // 8)
                for start in sorted({*range(first, cue + 1, step), *range(max(first, line), cue + 1, step)}):
                    if (size, start) not in seen:
                        seen.add((size, start))
                        note(tokens[start : start + size], size)
        return self.best(found)

    def best(self, found: dict[str, float]) -> tuple[float, str | None]:
        """The licence of a file from the best score of each."""
        order = sorted(found, key=lambda g: (-round(found[g], 9), g))
        strong = [g for g in order if g not in WEAK and found[g] >= self.threshold]
        first = (strong or order or [None])[0]
        return (min(1.0, found[first]), first) if first else (0.0, None)


def vocabulary(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[str]:
    return sorted({w for texts in templates.values() for t in texts for w in words(t)})


def frequencies(files: DataFrame, text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many files each word of the templates occurs, and the number of files; over all of them."""
    has = F.array_distinct(F.transform(F.split(F.lower(F.col(text_col)), WORD_SPLIT), lambda w: F.rtrim(w, F.lit("."))))
    known = F.array_intersect(has, F.array(*[F.lit(w) for w in vocabulary(templates)]))
    counts = files.select(F.explode(known).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counts.collect()}, files.count()  # as many rows as the vocabulary has words


def directory(path: Column) -> Column:
    """The directory part of a path; the empty text at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Add own_license, own_score, license, license_from and how to path and the other columns but text.

    how is "own", "inherited" or "none"; license_from is the path that declares it. Within a directory the licence file with the
    best score counts, then the first by path. Null and empty texts declare nothing, texts of any length are searched whole; a null
    path inherits nothing. Repeated rows each give a row, an empty table none. Columns with these names are replaced.
    """
    out_cols = ("own_license", "own_score", "license", "license_from", "how")
    frequency, n = frequencies(files, text_col, templates)
    sent = files.sparkSession.sparkContext.broadcast((frequency, n))  # as many entries as the templates have words
    keep = [c for c in files.columns if c not in (text_col, *out_cols)]
    cue = F.col(text_col).rlike(CUE)
    rows = files.select(*keep, F.when(cue | F.regexp_extract(F.coalesce(path_col, F.lit("")), r"[^/]*$", 0).rlike(LICENCE_FILE), F.col(text_col)).alias("__text"))
    place, width = keep.index(path_col), len(keep)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*sent.value, templates, threshold)
        for b in small(batches):
            found = [scorer.scan(p, t) for p, t in zip(b.column(place).to_pylist(), b.column(width).to_pylist(), strict=True)]
            names = pa.array([f[1] if f[0] >= threshold else None for f in found], type=pa.string())
            scores = pa.array([round(f[0], 9) if f[0] >= threshold else None for f in found], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], names, scores], names=[*keep, "own_license", "own_score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([files.schema[c] for c in keep]).add("own_license", StringType()).add("own_score", DoubleType())
    scratch = Scratch(files.sparkSession, "licenses")
    own = scratch.write(rows.mapInArrow(run, schema), "own").withColumn("__dir", directory(F.col(path_col)))
    base = F.regexp_extract(path_col, r"[^/]*$", 0)
    declared = own.filter(base.rlike(LICENCE_FILE) & F.col("own_license").isNotNull())
    declared = declared.groupBy(F.col("__dir").alias("__up")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col(path_col).alias("p"), F.col("own_license").alias("l"))).alias("d"))
    dirs = own.filter("__dir is not null").select("__dir").distinct()
    parts = F.split("__dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ups = F.when(F.col("__dir") == "", F.array(F.lit(""))).otherwise(ups)
    chains = dirs.select("__dir", F.explode(F.array_distinct(ups)).alias("__up"))
    nearest = chains.join(declared, "__up").groupBy("__dir").agg(F.max_by("d", F.length("__up")).alias("d"))
    joined = own.join(scratch.write(nearest, "nearest"), "__dir", "left")
    mine = F.col("own_license").isNotNull()
    how = F.when(mine, "own").when(F.col("d").isNotNull(), "inherited").otherwise("none")
    return joined.select(*keep, "own_license", "own_score", F.coalesce("own_license", "d.l").alias("license"), F.when(mine, F.col(path_col)).otherwise(F.col("d.p")).alias("license_from"), how.alias("how"))
