"""Line dedup against a brute-force version."""

import random
from collections import Counter

import pytest

from twinrun.llm import lines
from twinrun.llm.lines import drop_repeated_lines, line_bitmaps


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows, min_docs, keep_first):
    """(kept text, dropped lines) of each row; rows as (order, text)."""
    split = [(t or "").split("\n") for _, t in rows]
    count = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    seen, out = set(), {}
    for d in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        kept = []
        for x in split[d]:
            k = key(x)
            if count[k] >= min_docs and (not keep_first or k in seen):
                continue
            seen.add(k)
            kept.append(x)
        out[d] = ("\n".join(kept), len(split[d]) - len(kept))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_equals_brute_force(spark, keep_first):
    r = random.Random(8)
    common = ["Ab c", " ab C\t", "ÉCOLE", "école", "x", "", " \x0b", "ß", "ÀB", "ãb"]
    texts = ["\n".join(r.choice(common) if r.random() < 0.5 else f"own {r.random()}" for _ in range(r.randint(1, 9))) for _ in range(60)]
    texts += ["", None, "\n".join(["long"] + [f"line {k}" for k in range(500)] + ["x"] * 200 + ["tail"]), "x\nx\nx"]
    ids = r.sample(range(1000), len(texts))
    rows = [(i, t, "n", 5, 6) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_lines int, k1 int")
    want = brute(list(zip(ids, texts)), 5, keep_first)
    got = {x.doc.doc_id: x for x in drop_repeated_lines(df, min_docs=5, keep_first=keep_first).collect()}
    for d, i in enumerate(ids):
        assert (got[i].kept, got[i].n_dropped) == want[d], texts[d]
        assert got[i].n_lines == len((texts[d] or "").split("\n")) and got[i].doc.kept == "n"


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb")] * 3 + [(None, "a"), (None, None)], "doc_id bigint, text string")
    got = Counter((x.doc.doc_id, x.kept, x.n_dropped) for x in drop_repeated_lines(df, min_docs=3).collect())
    assert got == Counter({(1, "", 2): 3, (None, "", 1): 1, (None, "", 0): 1})
    assert drop_repeated_lines(df.limit(0)).count() == 0
    bare = df.select("text")
    assert sorted(x.n_dropped for x in drop_repeated_lines(bare, min_docs=3).collect()) == [0, 1, 2, 2, 2]


def test_bitmaps_are_sparse(spark):
    text = "\n".join(["first"] + [f"{k}" for k in range(1000)] + ["last"])
    df = spark.createDataFrame([(k, text if k == 0 else "first\nlast") for k in range(3)], "doc_id bigint, text string")
    maps = {r.n_dropped: r.bitmap for r in line_bitmaps(df, min_docs=3).collect() if len(r.bitmap) > 1}
    assert [w.word for w in maps[2]] == [0, 1001 // lines.WORD]
