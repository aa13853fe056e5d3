"""License scans: alignment against brute force, planted notices, and a scan of a whole table."""

import random
import time
from itertools import combinations

import pandas as pd

from twinrun.llm.licenses import TEMPLATES, WORD, aligned, canonical, increasing, license_scan, notices, op9_license_scan


def test_longest_increasing_subsequence():
    r = random.Random(1)
    for _ in range(200):
        b = r.sample(range(20), r.randint(0, 9))
        pairs = list(enumerate(b))
        best = max(n for n in range(len(b) + 1) if any(list(c) == sorted(c) for c in combinations(b, n)))
        got = increasing(pairs)
        assert len(got) == best and got == sorted(got) and [p[1] for p in got] == sorted(p[1] for p in got)


def test_alignment_is_ordered_and_true():
    r = random.Random(2)
    for _ in range(300):
        a, b = r.choices("abcdefgh", k=r.randint(0, 12)), r.choices("abcdefgh", k=r.randint(0, 12))
        got = aligned(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        if a == b:
            assert len(got) == len(a)
    assert aligned(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]


def test_planted_notices():
    r = random.Random(3)
    for t in TEMPLATES:
        filler = [" ".join(r.choices(["the", "under", "of", "licensed", "ther", "mit", "version", "license"], k=60)) for _ in range(2)]
        text = f"{filler[0]}\n{t.text}\n{filler[1]}"
        assert t.license in {n["license"] for n in notices(text) if n["coverage"] == 1.0 or n["coverage"] > 0.9}, t
        twice = f"{t.text} zebra yellow xylo wind violin under {t.text}"
        assert [n["license"] for n in notices(twice)] == [t.license] * 2, t
        assert notices(t.text.upper())[0]["license"] == t.license
        words = t.text.split()
        if len(words) > 20:  # some words changed
            for k in range(3, len(words), 9):
                words[k] = "changed" if words[k].lower().strip(".,;()") not in t.needed else words[k]
            assert [n["license"] for n in notices("intro " + " ".join(words) + " outro")] == [t.license], t
    assert notices("") == [] and notices("Released under the License.") == [] and notices("mit der license") == []
    assert notices("license " * 3000 + "mit " * 3000) == []


def test_adjacent_notices_are_found_each():
    for t in TEMPLATES:
        for k in (1, 2, 3, 4, 7, 20):
            text = "\n".join([t.text] * k)
            got = notices(text)
            assert [n["license"] for n in got] == [t.license] * k, (t, k)
            assert all(x["end"] <= y["start"] for x, y in zip(got, got[1:]))
    r = random.Random(4)
    for _ in range(60):
        chosen = [r.choice(TEMPLATES[:12]) for _ in range(r.randint(2, 8))]
        assert [n["license"] for n in notices(" . ".join(t.text for t in chosen))] == [t.license for t in chosen]


def test_expressions_of_identifiers():
    line = "# SPDX-License-Identifier: "
    assert [n["license"] for n in notices(line + "MIT OR Apache-2.0")] == ["MIT", "Apache-2.0"]
    got = notices(f"{line}(MIT OR Apache-2.0) AND BSD-3-Clause\n{line}ISC\ncode here")
    assert [n["license"] for n in got] == ["MIT", "Apache-2.0", "BSD-3-Clause", "ISC"]
    assert [n["license"] for n in notices(line + "MIT some other words Apache-2.0")] == ["MIT"]


def plain_notices(text):
    """All passages of exactly a template's length that equal it; of overlapping ones the longest, then the first."""
    words = [canonical(w.lower()) for w in WORD.findall(text)]
    hits = [
        (-len(t.words), n, a) for n, t in enumerate(TEMPLATES) for a in range(len(words)) if words[a : a + len(t.words)] == t.words
    ]
    taken = []
    for size, n, a in sorted(hits):
        if all(a - size <= c or a >= d for c, d, _ in taken):
            taken.append((a, a - size, n))
    return [TEMPLATES[n].license for _, _, n in sorted(taken)]


def test_equals_plain_scan_on_whole_notices():
    """Whole notices in any order, between words that no notice holds."""
    r = random.Random(9)
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 8)):
            parts += [r.choice(TEMPLATES).text] if r.random() < 0.6 else [" ".join(r.choices(["zebra", "xylo", "quark"], k=r.randint(1, 40)))]
        text = "\n".join(parts)
        exact = [n["license"] for n in notices(text) if n["coverage"] == 1.0]
        assert exact == plain_notices(text)


def test_many_notices_take_linear_time():
    def seconds(k):
        start = time.perf_counter()
        assert len(notices("Released under the MIT License. " * k)) == k
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)
    start = time.perf_counter()
    assert notices("permission sublicense " * 20_000) == []
    assert time.perf_counter() - start < 60


def test_spans_and_rows(spark):
    rows = [(1, "İ Released under the MIT License. x"), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, license string, start int")
    got = license_scan(df).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "MIT"), ("4", "CC-BY-NC-4.0"), ("4", "CC-BY-NC-4.0"), ("None", "CC-BY-NC-4.0")]
    for r in got:
        assert r.notice in dict(rows)[r.doc_id] and r.coverage == 1.0
    assert license_scan(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    lines = {t.text: t.license for t in TEMPLATES if len(t.words) < 15}
    want = sorted((d, lines[x]) for d, text in zip(docs.doc_id, docs.text) for x in text.split("\n") if x in lines)
    got = sorted((r.doc_id, r.license) for r in op9_license_scan(spark, "/root/testdata/sf0.001").collect())
    assert got == want and want


def test_common_licenses_and_version_spellings():
    cases = {
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.0": "GPL-3.0",
        "This work is licensed under the GNU General Public License v3 or later": "GPL-3.0-or-later",
        "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Licensed under the Apache License, Version 2": "Apache-2.0",
        "Licensed under the ISC License": "ISC",
        "Released under the Unlicense": "Unlicense",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    }
    assert {t: [n["license"] for n in notices(f"some text\n{t}\nmore text")] for t in cases} == {t: [of] for t, of in cases.items()}
    names = {t.license for t in TEMPLATES}
    assert {"GPL-2.0", "AGPL-3.0", "LGPL-2.1", "ISC", "Unlicense", "GPL-2.0-or-later", "AGPL-3.0-or-later"} <= names
    assert notices("Licensed under the GNU General Public License, version 4.") == []
    assert [n["license"] for n in notices("SPDX-License-Identifier: ISC mit")] == ["ISC"]
