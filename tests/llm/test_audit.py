"""The transducer and the audit of filters against plain Python."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinrun.llm import transducer
from twinrun.llm.audit import audit
from twinrun.llm.transducer import MEASURES, measured, measures

WORD = re.compile("[^\x20\x09-\x0d]+")


def plainly(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def all_measured(texts):
    return [list(map(int, row)) for row in zip(*measured(pa.array(texts, pa.large_string())))]


PIECES = ["a", "A", "Zz", "ab" * 40, "ab" * 40 + "c", "é", "日本", "😀", "#", "$%&*|", " ", "\n", "\t\x0b\x0c\r", "\x1c", " ", "x" * 64, "x" * 65, "\0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=8))
def test_measures_of_pieces(texts):
    assert all_measured(texts) == [plainly(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_measures_of_any_text(texts):
    assert all_measured(texts) == [plainly(t) for t in texts]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With one hash for all words, the bytes decide."""
    monkeypatch.setattr(transducer.Words, "_hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "aa", "long" * 30, "long" * 30 + "x", "é"]) for _ in range(40)) for _ in range(5)]
    assert all_measured(texts) == [plainly(t) for t in texts]


def test_sliced_array():
    texts = pa.array(["skip me", "A b", "", "c c"], pa.large_string()).slice(1, 3)
    assert [list(map(int, r)) for r in zip(*measured(texts))] == [plainly(t) for t in ["A b", "", "c c"]]


def test_column(spark):
    texts = ["a b a", None, "", "word " * 400_000, "x" * 3_000_000, "a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: [r[m] for m in MEASURES] for r in measures(df, "text", F.col("k")).collect()}
    assert got == {k: plainly(t or "") for k, t in enumerate(texts)}


def fails(rows, row):
    words, distinct, capitals, chars, symbols = plainly(row[1] or "")
    copy = any(o[0] is not None and row[0] is not None and o[0] < row[0] and (o[1] or "") == (row[1] or "") for o in rows)
    return {
        k for k, v in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * chars, symbols > 0, copy)) if v
    }


def expected(rows, labels):
    out, failed = {}, [fails(rows, r) for r in rows]
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in m[1] for m in mine) - len(gone), sum(m[1] == {x} for m in mine),
                    sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone),
                ]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[x])
    return out


def found(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    docs = docs.withColumns({"id": F.lit(1), "same": F.lit("x"), "fails": F.lit(0), "n": F.lit(9)})
    table = audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert table.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = [list(r) for r in table.collect()]
    assert len({tuple(r[:3]) for r in got}) == len(got)
    return {tuple(r[:3]): r[3:] for r in got}


def some(n):
    r = random.Random(n)

    def text():
        kind = r.randrange(6)
        words = ["".join(r.choice("abcdeé") for _ in range(6)) for _ in range(r.choice([3, 199, 200, 260]))]
        if kind == 0:
            words = words[:2] * 110
        if kind == 1:
            words = [w.upper() for w in words]
        if kind == 2:
            words.append("#")
        if kind == 3:
            return r.choice([None, "", "one text"])
        return " ".join(words)

    rows = [[i, text(), r.choice(["a", "b", "", None])] for i in range(n)]
    for _ in range(n // 2):
        rows.append([n + len(rows), r.choice(rows)[1], r.choice(["a", "b"])])
    return rows + [rows[0], rows[0], [None, "one text", "a"], [None, None, None], [rows[-1][0], rows[-1][1], "another"]]


@pytest.mark.parametrize("n", [1, 60])
def test_equals_plain_audit(spark, n):
    rows = some(n)
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, n, 2)] + [(0, 1, None), (0, None, 1), (4, 0, 0), (None, 1, 1)]
    assert found(spark, rows, labels) == expected(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
    rows = [[1, "clean text " + " ".join(f"w{i}" for i in range(300)), "s"]]
    assert found(spark, rows, []) == expected(rows, [])
