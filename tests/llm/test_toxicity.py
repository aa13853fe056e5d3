"""Toxicity: the label model on votes of known quality, evidence against plain Python, and accuracy on rows held out."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinrun.llm import toxicity as tox
from twinrun.llm.common import table

SF = "/root/testdata/sf0.01"


def votes_of(seed, n=20_000, prior=0.2):
    """Three independent voters, and a bad one with two copies that agree with it nearly always."""
    r = np.random.default_rng(seed)
    y = (r.random(n) < prior).astype(int)
    vote = lambda p: np.where(r.random(n) < p, 2 * y - 1, 1 - 2 * y)
    bad = vote(0.6)
    copies = [np.where(r.random(n) < 0.97, bad, -bad) for _ in range(2)]
    return y, np.stack([vote(0.9), vote(0.85), vote(0.8), bad, *copies], axis=1).astype(np.int8)


def fitted(votes, rounds=25):
    p = np.where(votes[:, :3].sum(axis=1) > 0, 0.9, 0.1)
    for _ in range(rounds):
        model = tox.LabelModel.of_counts(tox._vote_counts(votes, np.ones(len(votes)), p))
        p = model.posterior(votes)
    return model, p


def test_label_model_finds_accuracies_and_correlations():
    y, votes = votes_of(1)
    model, p = fitted(votes)
    accuracy = [a for a, _ in model.accuracies(tuple("abcdef")).values()]
    assert np.allclose(accuracy[:3], [0.9, 0.85, 0.8], atol=0.02)
    tied = {frozenset((j, int(k))) for j, k in enumerate(model.parent) if k >= 0}
    assert len(tied) == 2 and all(t <= {3, 4, 5} for t in tied)
    # Three copies of a bad voter do not outvote the good ones.
    majority = (votes.sum(axis=1) > 0).astype(int)
    assert ((p > 0.5) == y).mean() > max(0.9, (majority == y).mean() + 0.02)


def plain_evidence(text):
    words = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
    out = set()
    for w in words:
        raw = w.encode()
        out |= {(k, raw[:k]) for k in tox.PREFIXES if len(raw) >= k} | {(0, raw)}
    return out


def test_evidence_equals_plain_sets():
    r = random.Random(3)
    texts = [" ".join(r.choice(["Ab", "abc,", "abcd!", "ÉCOLE", "x" * 70, "x" * 71, "1a2", "日本語", "..", ""]) for _ in range(12)) for _ in range(30)]
    found, _ = tox._evidence(pa.array(texts, pa.large_string()))
    sets = [{(k, int(h)) for k, (hs, at) in zip(tox._KINDS, found) for h, t in zip(hs, at) if t == i} for i in range(len(texts))]
    plain = [plain_evidence(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def invented(n, seed=2):
    """Texts of invented words; toxic ones hold a few words that begin with a stem no other text has."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "lo", "mi", "té", "ru", "sen"]) for _ in range(r.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(20, 200))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), "krazö" + word() if i % 2 else r.choice(["idiot", "moron"]))
        docs.append([i, " ".join(words), "xx", None])
        labels.append([i, 1, int(toxic)])
    return docs, labels


@pytest.fixture(scope="module")
def planted(spark):
    docs, labels = invented(1500)
    odd = [[None, "odd", None, None], [2000, None, None, None], [2001, "", None, None], [2002, "Idiot! " * 200_000, None, None],
           [2003, "x" * 2_000_000, None, None], [2004, "\n\t", None, None], docs[0], docs[0]]
    schema = "doc_id bigint, text string, votes string, found string"  # names that the operator uses itself
    frame = spark.createDataFrame(docs + odd, schema).repartition(4)
    # Labels of held-out rows are turned round: they must not matter.
    turned = [[d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t] for d, q, t in labels]
    marks = spark.createDataFrame(turned + [[5, 0, labels[5][2]], [None, 0, 1], [7, 0, None]], "doc_id bigint, quality int, toxic int")
    model, evidence = tox.learned(frame, marks)
    rows = tox.scored(evidence.select("doc_id", "held_out", "votes", "found"), model).collect()
    return docs + odd, labels, model, rows, frame


def test_held_out_rows_are_told(planted):
    _, labels, _, rows, _ = planted
    truth = {d: t for d, _, t in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(truth[r.doc_id], r.score >= tox.THRESHOLD) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 300
    assert sum(t == p for t, p in held) / len(held) > 0.98
    assert sum(p for t, p in held if t) / sum(t for t, _ in held) > 0.95


def test_odd_rows_have_scores(planted):
    docs, _, _, rows, _ = planted
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(d[0]) for d in docs)
    assert all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[2000] == by_id[2001] == by_id[2004] < tox.THRESHOLD < by_id[2002]


def test_scoring_texts_again_gives_the_same(planted):
    """The general interface reads texts; the query goes on from stored evidence."""
    _, _, model, rows, frame = planted
    again = model.score(frame, F.col("doc_id")).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in again) == sorted((repr(r.doc_id), round(r.score, 9)) for r in rows)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(i, "you idiot" if i % 5 == 0 else "good day") for i in range(40)], "doc_id bigint, text string")
    model, evidence = tox.learned(docs, none)
    rows = tox.scored(evidence, model).collect()
    assert {r.doc_id for r in rows if r.score >= tox.THRESHOLD} == set(range(0, 40, 5))
    model, evidence = tox.learned(docs.limit(0), none)
    assert tox.scored(evidence, model).collect() == []


def test_query(spark):
    rows = {r.doc_id: r for r in tox.op12_toxicity(spark, SF).collect()}
    docs = table(spark, SF, "documents")
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    held = [(truth[d], r.predicted) for d, r in rows.items() if r.held_out and d in truth]
    right = sum(t == p for t, p in held) / len(held)
    assert right > 0.93, (right, len(held))
