"""Substring dedup against a brute-force version."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from twinrun.llm.substrings import COVER, PERIOD, _Block, _repeated, drop_repeated_spans, span_hashes, word_hashes


def brute(rows, window):
    """Kept text by row number; rows as (order, text) in their order."""
    words = [(t or "").encode().split() for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for d in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        for p in range(len(words[d]) - window + 1):
            g = tuple(words[d][p : p + window])
            if g in seen:
                gone[d] |= set(range(p, p + window))
            seen.add(g)
    return [b" ".join(w for k, w in enumerate(ws) if k not in g).decode() for ws, g in zip(words, gone)]


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_span_hashes():
    words = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for length in (1, 2, 5, 8, 20, 50, 51):
        h = span_hashes(words, length, 0x9E3779B97F4A7C15)
        assert len(h) == max(0, 51 - length)
        same = {(h[i] == h[j]) == bool((words[i : i + length] == words[j : j + length]).all()) for i in range(len(h)) for j in range(len(h))}
        assert same <= {True}


@pytest.mark.parametrize("window,block_bytes", [(20, 800), (14, 1 << 20), (20, 200)])
def test_equals_brute_force(spark, window, block_bytes):
    r = random.Random(window)
    passages = [" ".join(r.choices("abcdefgh", k=r.randint(10, 45))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choices("abcdefghijklmnop", k=r.randint(1, 30))) for _ in range(r.randint(0, 5))]
        texts.append(r.choice(["\n", "  ", " \t"]).join(parts))
    texts += ["", None, "x " * 500, "y z " * 100, texts[3], texts[3], "é " * 30 + "x " * 40]
    ids = r.sample(range(10_000), len(texts))
    df = spark.createDataFrame(
        [(i, t, 1, "q", k) for k, (i, t) in enumerate(zip(ids, texts))],
        "doc_id bigint, text string, block int, kept string, n_words int",
    )
    got = {x.doc["n_words"]: x for x in drop_repeated_spans(df, window=window, block_bytes=block_bytes).collect()}
    want = brute(list(zip(ids, texts)), window)
    assert [got[k].kept for k in range(len(texts))] == want
    for k, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[k].n_words == len(words) and got[k].n_removed == len(words) - len(want[k].split())
        left = [w for j, w in enumerate(words) if not any(s.start <= j < s.end for s in got[k].removed)]
        assert b" ".join(left).decode() == want[k] and got[k].doc["kept"] == "q"


def test_repeated_rows_nulls_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id bigint, text string")
    got = sorted((x.doc_id is None, x.n_words, x.n_removed) for x in drop_repeated_spans(df).collect())
    assert got == [(False, 30, 30), (False, 30, 30), (True, 0, 0), (True, 30, 0)]
    assert drop_repeated_spans(df.limit(0)).count() == 0


def test_layout_is_kept(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(1, f" a\n{passage}\t b "), (2, f"c  d\n\n{passage}\ne\tf \n"), (3, " no\n  passage\there "), (4, passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.kept for r in drop_repeated_spans(df, layout=True).collect()}
    assert got == {1: rows[0][1], 2: "c  d\n\ne\tf \n", 3: rows[2][1], 4: ""}


def test_a_bucket_answers_many_blocks_in_one_sort():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 600_000).astype("<u8")
    keys = [np.unique(r.choice(pool, 300)) for _ in range(1500)]
    began = time.process_time()
    answers = _repeated([k.tobytes() for k in keys], list(range(len(keys))))
    assert time.process_time() - began < 5  # a sort for each block took 59 s, one for all 0.1 s
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    many = set(found[n > 1].tolist())
    for k, bits in list(zip(keys, answers))[::100]:
        assert np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)).tolist() == [x in many for x in k.tolist()]


def test_words_and_their_hashes():
    words = ["", "a", "é", "\x00", "\x00\x00", "eight by", "w" * 63, "w" * 64, "w" * 65, "w" * 500 + "v", "\x85", "\u2028", "\x1c"]
    texts = ["\t \n".join(words), "a\x0bb\x0cc\rd  ", "", " \n", "end", "begin"]
    rows = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    block = _Block(rows, 20, 3)
    want = [t.encode().split() for t in texts]
    assert np.diff(block.starts).tolist() == list(map(len, want))
    every = [w for ws in want for w in ws]
    assert len(set(zip(every, block.hashes.tolist()))) == len(set(every)) == len(set(block.hashes.tolist()))
    assert block.joined(np.zeros(len(every), bool)).to_pylist() == [b" ".join(ws).decode() for ws in want]
    raw = np.frombuffer(b"abc abcabc" + bytes(8), np.uint8)
    h = word_hashes(raw, np.array([0, 4, 7]), np.array([3, 7, 10]))
    assert len(set(h.tolist())) == 1
