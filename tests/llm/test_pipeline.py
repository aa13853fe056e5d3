"""The pipeline, stage by stage, against brute-force versions on the smallest documents and on odd rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_ngrams import brute as brute_links
from tests.llm.test_tokens import packs_well

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def rows(df):
    return dict(zip(df.doc_id, df.text))


def test_each_stage(stages, spark):
    docs, good, lined, one_each, cut, packed = stages
    assert all(list(s.columns) == list(docs.columns) for s in stages[1:-1])
    assert all((s.n_chars == s.text.str.len()).all() for s in stages[2:-1])
    kept = {r.doc_id for r in spark.createDataFrame(docs[["doc_id", "text"]]).where(P.quality(F.col("text"))["kept"]).collect()}
    assert set(good.doc_id) == kept and 0 < len(kept) < len(docs)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    clean = [d for d in docs.doc_id if labels.get(d) == 1]
    assert len(set(clean) & kept) > 0.95 * len(clean)
    ordered = list(zip(good.doc_id, good.text))
    want = brute_lines(ordered, 10, True)
    assert rows(lined) == {d: want[k][0] for k, (d, _) in enumerate(ordered)}
    given = list(zip(lined.doc_id, lined.text))
    classes = brute_links(given)
    assert set(one_each.doc_id) == {d for (d, t), (_, c) in zip(given, classes) if d == c}
    assert rows(one_each).items() <= rows(lined).items() and len(one_each) < len(lined)
    seen, expected = set(), {}
    for d, t in sorted(rows(one_each).items()):
        words, gone = t.encode().split(), set()
        for p in range(len(words) - 19):
            g = tuple(words[p : p + 20])
            gone |= set(range(p, p + 20)) if g in seen else set()
            seen.add(g)
        expected[d] = [w for k, w in enumerate(words) if k not in gone]
    assert {d: t.encode().split() for d, t in rows(cut).items()} == expected
    assert all(t == rows(one_each)[d] for d, t in rows(cut).items() if len(expected[d]) == len(rows(one_each)[d].encode().split()))
    assert set(packed.doc_id) == set(cut.doc_id)
    packs_well(packed, 1.03)


def test_odd_rows(spark):
    text = " ".join(f"the word{k} of" for k in range(40))
    odd = [(1, text, "x", 7), (1, text, "x", 7), (None, text + " more", "y", 7), (2, None, None, None), (3, "", "z", 0), (None, None, None, 1)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, r1 string, label int")
    assert P.quality_rules(spark, docs, SF).count() == 3
    for name, stage in P.STAGES[1:-1]:
        docs = P.stored(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "r1", "label"]
    assert sorted((str(r.doc_id), r.text or "") for r in docs.collect()) == [("1", text), ("2", ""), ("3", ""), ("None", "")]
    assert P.best_fit_packing(spark, docs, SF).count() == 4
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
