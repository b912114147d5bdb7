"""License scans: runs of lines compared with licence templates by the Dice coefficient over word bigrams.

Texts and templates are lower-cased and reduced to words. A run of whole lines with ``a`` bigrams and a template with
``b`` of them can reach a Dice coefficient of ``t`` only if ``a`` lies between ``b t / (2 - t)`` and ``b (2 - t) / t``, and
only if they share ``t b / (2 - t)`` bigrams or more. The first bound keeps every run short; the second gives for each
template a few words of which one must occur, so that most texts are done after some substring tests. Both bounds are
exact: no run of lines above the threshold is lost. Bigrams count as often as they occur.

With ``within_lines`` the runs are of words, wherever lines begin and end: a notice inside a longer line is compared at its
own size. The best run begins and ends with a bigram of the template, as any other bigram at its ends lowers the score, so
that these are all that is tried. ``op3_license_scan`` works so; the lines it gives are those that the run lies in.

The templates are a parameter: their number and length are the user's, not the data's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")

# Notices and texts of common licences, as (licence, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""),
    ("BSD-3-Clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
)


class _Template:
    def __init__(self, name: str, text: str, least: float):
        words = _WORD.findall(text.lower())
        self.name, self.bigrams = name, Counter(zip(words, words[1:], strict=False))
        self.size = sum(self.bigrams.values())
        self.low, self.high = self.size * least / (2 - least), self.size * (2 - least) / least
        need = max(1, math.ceil(self.size * least / (2 - least) - 1e-9))
        # Of any ``size - need + 1`` bigrams one must be shared: those with the longest words are the rarest.
        each = sorted(self.bigrams.elements(), key=lambda p: (-max(map(len, p)), p))
        self.marks = {max(p, key=lambda w: (len(w), w)) for p in each[: self.size - need + 1]}


def _licences(text: str, templates: Sequence[_Template], least: float) -> dict[str, tuple[float, int, int]]:
    """The best run of lines for each licence found: score, first and last line, from 1."""
    low = text.lower()
    left = [t for t in templates if any(m in low for m in t.marks)]
    found: dict[str, tuple[float, int, int]] = {}
    if not left:
        return found
    words: list[str] = []
    line_of: list[int] = []
    for number, line in enumerate(low.split("\n"), 1):
        own = _WORD.findall(line)
        words += own
        line_of += [number] * len(own)
    begins = [i for i in range(len(words)) if not i or line_of[i] != line_of[i - 1]]
    pairs = list(zip(words, words[1:], strict=False))
    for t in left:
        hits = {line_of[i] for i, p in enumerate(pairs) if p in t.bigrams}
        for begin in begins:
            if line_of[begin] not in hits:
                continue
            seen: Counter = Counter()
            shared = 0
            for i in range(begin, min(len(words), begin + int(t.high) + 1)):
                a = i - begin
                if a:
                    p = pairs[i - 1]
                    seen[p] += 1
                    shared += seen[p] <= t.bigrams[p] if p in t.bigrams else 0
                if a >= t.low and (i + 1 == len(words) or line_of[i + 1] != line_of[i]):
                    score = 2 * shared / (a + t.size)
                    if score >= least and score > found.get(t.name, (0.0,))[0]:
                        found[t.name] = (score, line_of[begin], line_of[i])
    return found


def _licences_within(text: str, templates: Sequence[_Template], least: float) -> dict[str, tuple[float, int, int]]:
    """The best run of words for each licence found: score, and the first and last line it lies in, from 1."""
    low = text.lower()
    left = [t for t in templates if any(m in low for m in t.marks)]
    found: dict[str, tuple[float, int, int]] = {}
    if not left:
        return found
    words: list[str] = []
    line_of: list[int] = []
    for number, line in enumerate(low.split("\n"), 1):
        own = _WORD.findall(line)
        words += own
        line_of += [number] * len(own)
    pairs = list(zip(words, words[1:], strict=False))
    for t in left:
        hits = [i for i, p in enumerate(pairs) if p in t.bigrams]
        need = max(1, math.ceil(t.size * least / (2 - least) - 1e-9))
        for h, begin in enumerate(hits):
            stop = begin + int(t.high + 1e-9)
            if h + need > len(hits) or hits[h + need - 1] >= stop:
                continue
            seen: Counter = Counter()
            shared = 0
            for i in hits[h:]:
                if i >= stop:
                    break
                p = pairs[i]
                seen[p] += 1
                shared += seen[p] <= t.bigrams[p]
                score = 2 * shared / (i - begin + 1 + t.size)
                if score >= least and score > found.get(t.name, (0.0,))[0]:
                    found[t.name] = (score, line_of[begin], line_of[i + 1])
    return found


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8, *, within_lines: bool = False
) -> DataFrame:
    """``doc_id, license, score, first_line, last_line, licenses``: one row for every row of ``docs``.

    ``licenses`` has all licences with a run of lines (with ``within_lines``: of words) of Dice coefficient ``least`` or more, sorted; the others describe
    the best of them (ties: the first by name), or are null where there is none, as for null and empty texts. Other
    columns of ``docs`` are not looked at; repeated rows give a row each.
    """

    @F.pandas_udf("license string, score double, first_line int, last_line int, licenses array<string>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = [t for t in (_Template(n, x, least) for n, x in templates) if t.size]
        licences = _licences_within if within_lines else _licences
        for part in parts:
            rows = []
            for text in part:
                found = licences(text, own, least) if text else {}
                best = min(found, key=lambda k: (-found[k][0], k)) if found else None
                rows.append((best, *(found[best] if best else (None, None, None)), sorted(found)))
            frame = pd.DataFrame(rows, columns=["license", "score", "first_line", "last_line", "licenses"])
            yield frame.astype({"license": object, "score": float, "first_line": "Int32", "last_line": "Int32"})

    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scan(text).alias("found"))
    return found.select(
        "doc_id", "found.license", F.when(F.col("found.license").isNotNull(), F.col("found.score")).alias("score"),
        "found.first_line", "found.last_line", "found.licenses",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    return scan_licenses(table(spark, sf_dir, "documents"), within_lines=True)
