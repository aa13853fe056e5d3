"""The Merkle manifest against trees built one node at a time."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from twinrun.llm.merkle import FIELDS, folded, leaf_of, manifest, siblings

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h("".join(values))


def tree(leaves, fanout=3):
    """Root, and for each leaf the siblings of each level as (before, after)."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for proof, i in zip(proofs, at):
            first = i - i % fanout
            proof.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def expected(rows, fanout=3):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: (sorted(by_source[s], key=lambda x: x[:3]),) for s in sources}
    low = {s: (members, *tree([m[2] for m in members], fanout)) for s, (members,) in low.items()}
    root, high = tree([low[s][1] for s in sources], fanout)
    out = []
    for s, upper in zip(sources, high):
        members, subroot, proofs = low[s]
        for m, proof in zip(members, proofs):
            whole = proof + upper
            out.append((m[3][0], m[2], subroot, root, "".join(b + a for b, a in whole)))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    # Another column has the name of one that the operator makes.
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"leaf": F.lit(1), "tree": F.lit(2), "pos": F.lit(3)})
    rows = manifest(docs, **kw).withColumns({"back": folded(F.col("leaf"), F.col("proof")), "s": siblings(F.col("proof"))}).collect()
    assert all(r.back == r.root for r in rows)
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.s) for r in rows], key=repr)


def some(n, sources, seed=1):
    r = random.Random(seed)
    return [(i, sources[r.randrange(len(sources))], r.choice(["en", None]), r.choice([None, 3]), r.choice(["a\nb", "", None, "é" * i])) for i in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_trees_of_many_blocks(spark, depth):
    """83 leaves in one source are 28 or 10 blocks, the last one short; other sources have one leaf or few."""
    rows = some(83, ["hot"]) + [(100 + i, s, "de", 1, "x") for i, s in enumerate(["", None, "ä", "z", "Z", "z"])]
    assert found(spark, rows, depth=depth) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_powers(spark, n):
    rows = some(n, ["s"])
    assert found(spark, rows, depth=1) == expected(rows)


def test_odd_rows(spark):
    """NULL ids, repeated ids, full copies of a row, nothing but NULLs."""
    rows = some(12, ["a", None]) * 2 + [(None, None, None, None, None)] * 3 + [(None, "a", "x", 1, "t"), (5, "a", "x", 1, "t")]
    assert found(spark, rows, depth=1) == expected(rows)


def test_more_sources_than_a_block_holds(spark):
    rows = [(i, f"s{i % 11}", "en", i, f"text {i}") for i in range(40)]
    assert found(spark, rows, depth=1, fanout=2) == expected(rows, 2)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_long_text(spark):
    rows = [(1, "a", "en", 5, "x y\n" * 500_000), (2, "a", "en", 5, "")]
    assert found(spark, rows) == expected(rows)


def test_tampering_shows(spark):
    rows = some(30, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA)
    text = F.replace("text", F.lit("\n"), F.lit(""))
    other = leaf_of([text if f == "text" else F.col(f) for f in FIELDS])
    proven = manifest(docs, carry={"other": other, "text": F.col("text"), "crc": F.crc32(F.col("doc_id").cast("string").cast("binary"))}, depth=1)
    got = proven.withColumn("same", folded(F.col("other"), F.col("proof")) == F.col("root")).collect()
    assert {r.doc_id: r.same for r in got} == {r[0]: "\n" not in (r[4] or "") for r in rows}
    assert all(r.crc == zlib.crc32(str(r.doc_id).encode()) for r in got)
