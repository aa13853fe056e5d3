"""License scans by patience alignment: words unique to a passage and a template anchor them, gaps align recursively."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.common import table

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


@dataclass(frozen=True)
class Template:
    """A notice. ``needed`` are words without which it is another notice; they have to be among the aligned ones. With
    one of the ``barred`` words between its first and last word it is another notice, too."""

    license: str
    text: str
    needed: tuple[str, ...]
    barred: tuple[str, ...] = ()

    @cached_property
    def words(self) -> list[str]:
        return [canonical(w) for w in WORD.findall(self.text.lower())]

    @cached_property
    def needed_words(self) -> tuple[str, ...]:
        return tuple(map(canonical, self.needed))


def canonical(word: str) -> str:
    """One spelling of a version: ``v3``, ``3.0`` and ``v3.0`` are ``3``."""
    if word[0] not in "v0123456789":
        return word
    found = VERSION.fullmatch(word)
    return found[1] if found else word


_NOT_GPL = ("lesser", "library", "affero")
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_NO_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(short: str, name: str, version: str, dated: str, years: str) -> tuple[Template, ...]:
    """Notices of a GNU license, for one version alone or later ones too, and the heading of its full text."""
    own = [w for w in name.lower().split() if w in _NOT_GPL]
    needed, barred = ("gnu", "public", *own, version), () if own else _NOT_GPL
    only, later = f"{short}-{version if '.' in version else version + '.0'}", "later"
    full = f"GNU {name} General Public License".replace("  ", " ")
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the " + full
    free += " as published by the Free Software Foundation,"
    head = f"{full} Version {version}, {dated} Copyright (C) {years} Free Software Foundation, Inc. {_VERBATIM}"
    return (
        *[Template(only, f"{start} under the {full}, version {version}.", needed, barred) for start in _STARTS],
        *[Template(f"{only}-or-later", f"{start} under the {full}, version {version} or later.", (*needed, later), barred) for start in _STARTS],
        Template(only, f"{free} version {version} of the License.", (*needed, "redistribute"), (*barred, "later")),
        Template(f"{only}-or-later", f"{free} either version {version} of the License, or (at your option) any later version.", (*needed, "redistribute", "later"), barred),
        Template(only, head, (*needed, "verbatim"), barred),
    )


#: The identifier follows this word at once, and no other notice of fewer than SHORT words reaches across it.
TAG, SHORT = "spdx-license-identifier", 15
_STARTS = ("Licensed", "This work is licensed")

#: Identifiers of SPDX and the license each names.
_SPDX = (
    "MIT Apache-2.0 ISC Unlicense BSD-2-Clause BSD-3-Clause MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 GPL-2.0 GPL-3.0 "
    "LGPL-2.1 LGPL-3.0 AGPL-3.0 GPL-2.0-or-later GPL-3.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-or-later"
).split()
_SPDX_NAMES = [(i, i) for i in _SPDX] + [(f"{i}-only", i) for i in _SPDX if "GPL" in i and not i.endswith("later")]
#: Words of an expression of SPDX, and how far behind the tag its names are looked for.
SPDX_WORDS = frozenset(["or", "and", "with", *[name.lower() for name, _ in _SPDX_NAMES]])
SPDX_REACH = 16

# Notices as the licenses ask for them, or as they are commonly shortened; full texts of the short licenses
# and the headings of the long ones.
TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit", "license")),
    Template("MIT", "This project is licensed under the terms of the MIT license.", ("mit", "license")),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        ("permission", "sublicense"),
    ),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template(
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
        ("apache", "2.0", "compliance"),
    ),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "public", "3"), _NOT_GPL),
    Template(
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        ("gnu", "redistribute", "3", "later"),
        _NOT_GPL,
    ),
    Template("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd", "3-clause")),
    Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", ("bsd", "2-clause")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC0-1.0", "Released into the public domain under CC0 1.0.", ("cc0", "1.0")),
    *_gnu("GPL", "", "2", "June 1991", "1989, 1991"),
    *_gnu("GPL", "", "3", "29 June 2007", "2007"),
    *_gnu("LGPL", "Lesser", "2.1", "February 1999", "1991, 1999"),
    *_gnu("LGPL", "Lesser", "3", "29 June 2007", "2007"),
    *_gnu("AGPL", "Affero", "3", "19 November 2007", "2007"),
    Template("ISC", "Licensed under the ISC License.", ("licensed", "under", "the", "isc", "license")),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("permission", "fee", "appear"),
    ),
    Template("Unlicense", "Released under the Unlicense.", ("unlicense",)),
    Template(
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
        ("unencumbered", "domain"),
    ),
    Template("BSD-3-Clause", _REDISTRIBUTION + _NO_ENDORSEMENT + _BSD_DISCLAIMER, ("redistributions", "endorse")),
    Template("BSD-2-Clause", _REDISTRIBUTION + _BSD_DISCLAIMER, ("redistributions", "disclaimer"), ("endorse",)),
    Template("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", ("mozilla", "2.0")),
    Template(
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that "
        "creates, contributes to the creation of, or owns Covered Software.",
        ("mozilla", "2.0", "contributor"),
    ),
    Template(
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION",
        ("apache", "2.0", "2004", "reproduction"),
    ),
    *[Template(of, f"SPDX-License-Identifier: {name}", ("spdx-license-identifier", name.lower())) for name, of in _SPDX_NAMES],
)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first number) whose second numbers rise: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of words of ``a`` and ``b`` that are aligned, in order.

    Equal words at both ends of a range are aligned; then words that stand once in either range and in both become
    anchors, the longest increasing sequence of them holds, and the gaps between are ranges of their own. A range
    without an anchor stays open.
    """
    out, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        i, m, j, n = ranges.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[i:m], i) if in_a[w] == 1 and w in place])
        last = (i, j)
        for k, p in anchors:
            out.append((k, p))
            ranges.append((last[0], k, last[1], p))
            last = (k + 1, p + 1)
        if anchors:
            ranges.append((last[0], m, last[1], n))
    return sorted(out)


def _hits(words: list[str], here: dict[str, list[int]], t: Template, number: int, coverage: float) -> list[tuple]:
    """Passages of a text that are a template's: (aligned words, length, number of the template, first word, last word).

    The rarest needed word says where a passage may begin. Passages equal to the template come first; what is left of
    the text between them is aligned with some room around each place.
    """
    rare = min(t.needed_words, key=lambda w: len(here[w]))
    size, tagged = len(t.words), TAG in t.needed
    slack = SPDX_REACH if tagged else max(2, size // 4)
    offsets = [k for k, w in enumerate(t.words) if w == rare]
    starts = sorted({p - o for p in here[rare] for o in offsets})
    out, firsts, lasts = [], [], []
    for start in starts:
        if start >= 0 and (not lasts or start > lasts[-1]) and words[start : start + size] == t.words:
            out.append((-size, size, number, start, start + size - 1))
            firsts.append(start)
            lasts.append(start + size - 1)
    for start in starts:
        k = bisect_right(firsts, start)
        if k and start <= lasts[k - 1]:
            continue
        low = max(0, start - slack, lasts[k - 1] + 1 if k and not tagged else 0)
        high = min(len(words), start + size + slack + slack // 2, firsts[k] if k < len(firsts) else len(words))
        if any((j := bisect_left(here[w], low)) == len(here[w]) or here[w][j] >= high for w in t.needed_words):
            continue
        pairs = aligned(words[low:high], t.words)
        got = {t.words[b] for _, b in pairs}
        if not pairs or len(pairs) < coverage * size or not got.issuperset(t.needed_words):
            continue
        a, b = low + pairs[0][0], low + pairs[-1][0]
        between = words[a + 1 : b]
        if tagged:
            # Further names of an expression count where they stand, so that all names of it are found.
            if b - a >= size and not (words[b - 1] in ("or", "and") and all(w in SPDX_WORDS for w in between)):
                continue
            a = b if b - a >= size else a
        elif (size < SHORT and TAG in words[a : b + 1]) or not frozenset(t.barred).isdisjoint(words[a : b + 1]):
            continue
        out.append((-len(pairs), b - a + 1, number, a, b))
    return out


def notices(text: str, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> list[dict]:
    """Notices found in a text: license, coverage (share of the template's words aligned), start, end (characters).

    Where the rarest needed word of a template stands in the text, the passage around it is aligned. For each such place
    that is as much work as the template is long, and places are told apart by bisection. Of passages that overlap, the
    one with most aligned words stays (of equals the shorter, then the first template); what stands next to each other
    is found each.
    """
    found = list(WORD.finditer(text.lower())) if len(text.lower()) == len(text) else list(WORD.finditer(text))
    words = [canonical(w.group().lower()) for w in found]
    here: dict[str, list[int]] = {}
    asked = {w for t in templates for w in t.needed_words}
    for k, w in enumerate(words):
        if w in asked:
            here.setdefault(w, []).append(k)
    hits = []
    for number, t in enumerate(templates):
        if all(w in here for w in t.needed_words):
            hits += _hits(words, here, t, number, coverage)
    # Passages that equal a template are not cut by one that is only like another, nor all together part of a lesser one.
    crossed, inside = [0] * (len(words) + 2), [0] * (len(words) + 2)
    for matched, length, _, a, b in hits:
        if length == -matched:
            crossed[a + 1] += 1
            inside[a + 1] += 1
            crossed[b + 1] -= 1
            inside[b + 2] -= 1
    crossed = list(accumulate(crossed))
    equal = list(accumulate(min(n, 1) for n in accumulate(inside)))  # words before each place that are in such a passage
    hits = [
        (matched, length, number, a, b)
        for matched, length, number, a, b in hits
        if length == -matched or not (crossed[a] or crossed[b + 1] or equal[b + 1] - equal[a] >= -matched)
    ]
    out, firsts, lasts = [], [], []
    for matched, _, number, a, b in sorted(hits):
        k = bisect_right(firsts, b)
        if k and lasts[k - 1] >= a:
            continue
        firsts.insert(k, a)
        lasts.insert(k, b)
        share = -matched / len(templates[number].words)
        out.append({"license": templates[number].license, "coverage": share, "words": -matched, "start": found[a].start(), "end": found[b].end()})
    return sorted(out, key=lambda x: x["start"])


def license_scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each notice in whole texts: ``doc_id, license, coverage, words, start, end, notice``.

    ``start`` and ``end`` are characters, ``notice`` is the text between. NULL and empty texts have none; repeated rows
    are scanned each; an empty table gives no rows; other columns are left out. The templates are a fixed small table; nothing is shuffled.
    """
    given = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    added = "license string, coverage double, words int, start int, end int, notice string"
    schema = T.StructType([given.schema["doc_id"], *T.StructType.fromDDL(added).fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, value in enumerate(batch["text"]):
                t = value.as_py()
                for hit in notices(t, templates, coverage):
                    rows.append(hit | {"notice": t[hit["start"] : hit["end"]]})
                    of.append(k)
            body = pa.Table.from_pylist(rows, pa.schema([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("notice", pa.string())]))
            columns = [batch["doc_id"].take(pa.array(of, pa.int64())), *[c.combine_chunks() for c in body.columns]]
            yield pa.record_batch(columns, names=["doc_id", *body.column_names])

    return given.mapInArrow(scan, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
