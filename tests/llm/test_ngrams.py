"""N-gram Jaccard join and connected components against brute-force versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinrun.llm import ngrams
from twinrun.llm.components import components
from twinrun.llm.ngrams import bands_and_rows, jaccard_join


def brute(rows, n=5, threshold=0.8):
    """(n_links, class_id) by row."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links = [[b for b in range(len(rows)) if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold] for a in range(len(rows))]
    out, group = [], list(range(len(rows)))
    for a in range(len(rows)):
        todo, seen = [a], {a}
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((len(links[a]), min(ids) if ids else None))
    return out


def near_copies(r, n_texts):
    texts = []
    for _ in range(n_texts):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(3, 90))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(len(other))] = f"w{r.randint(0, 3000)}"
            texts.append("  ".join(other))
    return texts


def test_bands():
    b, r = bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= ngrams.MOST_HASHES
    assert bands_and_rows(1.0, 0.9999)[0] == 1


@pytest.mark.parametrize("block", [256, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    r = random.Random(5)
    texts = near_copies(r, 40) + ["", None, "one two", "one two", " one  two ", "one"]
    big = [f"v{k}" for k in range(120)]
    texts += [" ".join([*big, f"end{k % 9}"]) for k in range(25)]  # a large group with copies in it
    ids = r.sample(range(5000), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, "alone without an id")]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], "doc_id bigint, text string, node string, label int, band int")
    got = Counter((x.doc_id, x.n_links, x.class_id) for x in jaccard_join(df).collect())
    assert got == Counter((i, n, c) for (i, _), (n, c) in zip(rows, brute(rows)))


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(90)] + [(5, 5), (900, 900)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {x.node: x.label for x in components(df).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(400):
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert components(df.where(F.lit(False))).count() == 0
