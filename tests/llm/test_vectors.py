"""Nearest neighbours: recall against brute force, exact scores, and the rows that take no part."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from twinrun.llm import vectors
from twinrun.llm.vectors import VectorIndex, nearest_neighbours, op6_nearest_neighbours

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("list", T.StringType())])


def test_recall_and_scores(spark):
    data = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    by_query = defaultdict(list)
    for r in op6_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        by_query[r.query_id].append(r)
    assert set(by_query) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for query, found in by_query.items():
        q = x[ids == query][0]
        far = np.sqrt(((x - q) ** 2).sum(1))
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and query not in {r.vec_id for r in found}
        assert all(math.isclose(r.score, far[ids == r.vec_id][0], rel_tol=1e-12) for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        best = [i for _, i in sorted(zip(far.tolist(), ids.tolist())) if i != query][:10]
        hits += len({r.vec_id for r in found} & set(best))
    assert hits >= 0.9 * 10 * len(by_query)


def test_graph_finds_the_nearest_centroids():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16))
    graph = vectors.CentroidGraph.of(vectors.balanced_centroids(x, 300), x)
    at, d = graph.search(x[:200], 40)
    true = np.argsort(vectors._squares(x[:200], graph.centers), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(t)) for a, t in zip(at.tolist(), true.tolist())]) > 9.5
    assert (np.diff(d, axis=1) >= 0).all() and all(len(set(a)) == 40 for a in at.tolist())


def test_rows_that_take_no_part_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 20)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=4).tolist(), "x") for k in range(1, 300)] + [(k, [1.0, 2.0, 3.0, 4.0], "x") for k in range(300, 360)]
    bad = [None, [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [1.0, float("inf"), 0.0, 1.0], [1.0, 2.0], []]
    rows += [(1000 + k, v, "y") for k, v in enumerate(bad)] + [(None, [1.0, 2.0, 3.0, 4.0], "z"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest_neighbours(df, df, k=5).collect()
    found = defaultdict(list)
    for x in sorted(got, key=lambda x: x["rank"]):
        found[x.query_id].append(x.vec_id)
    assert set(found) == set(range(1, 360)) and all(len(v) == 5 == len(set(v)) for v in found.values())
    assert found[310] == [300, 301, 302, 303, 304] and found[302] == [300, 301, 303, 304, 305]
    good = {i: np.asarray(v) for i, v, _ in rows if i is not None and i < 1000}
    hits = 0
    for q, mine in found.items():
        best = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(good[q]).astype(float)) ** 2).sum())), i) for i, v in good.items() if i != q)
        hits += len({i for _, i in best[:5]} & set(mine))
    assert hits >= 0.9 * 5 * len(found)


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [3.0, 4.0], "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(nearest_neighbours(df, df).collect())] == [(1, 1, 2), (2, 1, 1)]
    assert nearest_neighbours(df.limit(0), df).count() == 0 and nearest_neighbours(df, df.limit(0)).count() == 0
    assert VectorIndex.build(spark.createDataFrame([(1, None, "")], SCHEMA)) is None


def _brute(rows, query, k):
    """The k nearest other ids of a query: the least distance over all rows of an id, ties to the smaller id."""
    far = {}
    for q in (np.float32(v).astype(float) for i, v, _ in rows if i == query):
        for i, v, _ in rows:
            if i != query:
                d = float(np.sqrt(((np.float32(v).astype(float) - q) ** 2).sum()))
                far[i] = min(far.get(i, d), d)
    return [i for _, i in sorted((d, i) for i, d in far.items())[:k]]


def test_repeated_rows_count_once(spark):
    r = np.random.default_rng(5)
    own = [(k, r.normal(size=4).tolist(), "x") for k in range(60)]
    moved = [(k, (np.asarray(own[k][1]) + 1e-3 * r.normal(size=4)).tolist(), "y") for k in range(20) for _ in range(15)]
    for rows in (own * 2, own * 5, own[:3] * 30 + own, own + moved):
        df = spark.createDataFrame(rows, SCHEMA)
        index = VectorIndex.build(df, list_size=10**6)  # one list, so nothing but the merging of copies decides
        found = defaultdict(list)
        for x in sorted(index.search(df.where("vec_id % 3 = 0"), k=10).collect(), key=lambda x: x["rank"]):
            found[x.query_id].append(x.vec_id)
        assert found == {q: _brute(rows, q, 10) for q in range(0, 60, 3)}


def test_every_query_gets_k(spark):
    r = np.random.default_rng(6)
    rows = [(k, (1e-3 * r.normal(size=8) + 1).tolist(), "hot") for k in range(1500)]
    rows += [(2000 + k, r.normal(size=8).tolist(), "cloud") for k in range(1500)]
    for g in range(40):  # small groups far from everything
        c = r.normal(size=8)
        rows += [(4000 + 3 * g + j, (100 * c / np.linalg.norm(c) + 0.01 * r.normal(size=8)).tolist(), "far") for j in range(3)]
    rows += [(9000, (50 + 0.01 * r.normal(size=8)).tolist(), "one id, many vectors") for _ in range(1500)]
    rows += [(9001 + k, (50 + 0.01 * r.normal(size=8)).tolist(), "its only neighbours") for k in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [*range(0, 1500, 150), *range(2000, 3500, 150), *range(4000, 4120, 3), 9001, 9002]
    found = defaultdict(list)
    for x in nearest_neighbours(df, df.where(df.vec_id.isin(asked)), k=10).collect():
        found[x.query_id].append((x["rank"], x.vec_id))
    assert all(sorted(n for n, _ in found[q]) == list(range(1, 11)) and len({i for _, i in found[q]}) == 10 for q in asked)
    for q in (4000, 4060, 9001):  # the whole group, and then the nearest beyond it
        assert [i for _, i in sorted(found[q])][:2] == _brute(rows, q, 2)
