"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinrun.llm.common import row_key, stored, table, text_of
from twinrun.llm.components import components
from twinrun.llm.substrings import span_hashes

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hash functions at most, and documents of a bucket that meet in one task (twice as many where two blocks meet).
MOST_HASHES, BLOCK = 96, 256
_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: a pair at the threshold shares a band with probability ``recall`` or more, and of the
    choices with at most ``most`` hashes the one with most rows, which gives the fewest false candidates."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no choice of bands reaches this recall with so few hashes")
    return best


def ngram_set(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words. Fewer words than n are one n-gram; no words, none."""
    words = text.encode().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    return np.unique(span_hashes(hashes, min(n, max(1, len(words))), _FACTOR))


class MinHash:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(20)
        self.flip = random.integers(0, 1 << 64, (bands * rows, 1), _U)
        self.factor = random.integers(0, 1 << 64, (bands * rows, 1), _U) | _U(1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A hash for each band."""
        least = np.full(self.bands * self.rows, np.iinfo(_U).max, _U)
        for a in range(0, len(grams), 4096):
            least = np.minimum(least, ((grams[None, a : a + 4096] ^ self.flip) * self.factor).min(axis=1))
        by_band = least.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=_U) * _U(_FACTOR)
        for k in range(self.rows):
            out = (out ^ by_band[:, k]) * _U(0xD6E8FEB86659FD93)
            out ^= out >> _U(32)
        return out


def _signatures(docs: DataFrame, text: str, n: int, minhash: MinHash) -> DataFrame:
    """``doc_id, r1, r2`` (row key), ``node`` (digest of the n-gram set, NULL if empty) and ``bands``."""
    keyed = docs.select("doc_id", *[k.alias(a) for k, a in zip(row_key(F.col("doc_id"), text_of(text)), ("r1", "r2"))], text_of(text).alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands = [], []
            for t in batch["text"]:
                grams = ngram_set(t.as_py(), n)
                nodes.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                bands.append(minhash.of(grams).view(np.int64) if len(grams) else None)
            columns = [batch["doc_id"], batch["r1"], batch["r2"], pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "r1", "r2", "node", "bands"])

    return keyed.mapInArrow(signed, f"doc_id {id_type}, r1 bigint, r2 bigint, node binary, bands array<bigint>")


def _verified(rows: pa.Table, n: int, threshold: float) -> pa.Table:
    """Links inside one bucket, or between two blocks of one: weights of the partners, and the least node reached.

    A pair counts in the first band it shares, so it is verified once however many buckets hold it.
    """
    i, j, first = (rows[c][0].as_py() for c in ("i", "j", "band"))
    grams = [ngram_set(t, n) for t in rows["text"].to_pylist()]
    sizes = np.asarray([len(g) for g in grams], np.int64)
    side, weight = rows["own"].to_numpy(), rows["copies"].to_numpy()
    m = len(grams)
    # Intersections: documents by n-gram as 0/1 columns, multiplied blockwise; n-grams of one document alone drop out.
    values, column = np.unique(np.concatenate(grams), return_inverse=True)
    holder = np.repeat(np.arange(m), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    holder, column = holder[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    holder, column = holder[order], column[order]
    both = np.zeros((m, m), np.float32)
    for a in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(column, [a, a + 8192])
        part = np.zeros((m, 8192), np.float32)
        part[holder[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = both / np.maximum(union, 1) >= threshold
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= side[:, None] != side[None, :]
    bands = np.asarray(rows["bands"].to_pylist(), np.int64)
    for k in range(first):
        linked &= bands[:, None, k] != bands[None, :, k]
    linked &= bands[:, None, first] == bands[None, :, first]
    label = np.arange(m)
    while True:  # least label among the neighbours, until nothing changes
        least = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(linked.any(axis=1))
    nodes = rows["node"].combine_chunks()
    return pa.table(
        [nodes.take(pa.array(some)), nodes.take(pa.array(label[some])), pa.array((linked * weight[None, :]).sum(axis=1)[some], pa.int64())],
        names=["node", "root", "links"],
    )


def jaccard_join(docs: DataFrame, text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, r1, r2, node, label``, one row for each input row.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is ``threshold`` or more.
    ``n_links`` counts the documents linked with a row, copies among them; ``class_id`` is the least doc_id of the
    group that links connect. ``node`` names the n-gram set (rows of equal sets are copies), ``label`` the group,
    ``r1, r2`` the row key ``row_key(doc_id, text)``. Texts of fewer than n words are one n-gram; NULL and empty texts
    have none: no links, and doc_id as class_id. Repeated rows are copies of each other; rows without doc_id take part,
    and a group of nothing else has class_id NULL. Other columns are left out.

    Copies are one node with a weight. Nodes meet in buckets of equal band hashes; buckets with the same members are
    one. A bucket of more than BLOCK nodes is split into blocks of which any two meet in a task of their own, so no
    task holds a whole group and no pair is left out; pairs are counted where they are found, never written as rows.
    """
    bands, rows = bands_and_rows(threshold, recall)
    signed = stored(_signatures(docs, text, n, MinHash(bands, rows)), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min(F.struct("r1", "r2")).alias("r"), F.first("bands").alias("bands")
    )
    nodes = stored(nodes.select("node", "copies", "r.r1", "r.r2", "bands"), "nodes")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    key = F.xxhash64("band", "h").alias("bucket")
    banded = banded.select("node", "band", key)
    many = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"))
    met = banded.join(many.where("n > 1"), "bucket").groupBy("node", "n", "members").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), blocks).cast("int")
    met = met.select("node", "n", "members", "band", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.select("node", "n", "members", "band", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    asked = met.join(nodes.select("node", "copies", "r1", "r2", "bands"), "node")
    texts = docs.select(*[k.alias(a) for k, a in zip(row_key(F.col("doc_id"), text_of(text)), ("r1", "r2"))], text_of(text).alias("text"))
    # A node's text is that of one row; equal rows give the same text, so one of them is enough.
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("r1", "r2", "node")
    texts = wanted.join(texts, ["r1", "r2"]).groupBy("node").agg(F.first("text").alias("text"))
    groups = asked.join(texts, "node").groupBy("n", "members", "band", "i", "j")

    def verify(rows: pa.Table) -> pa.Table:
        return _verified(rows, n, threshold)

    links = stored(groups.applyInArrow(verify, "node binary, root binary, links bigint"), "links")
    labels = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))

    found = nodes.select("node", "copies").join(degree, "node", "left").join(labels, "node", "left")
    found = found.select(
        "node", F.coalesce("label", "node").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    # Stored, so that the join with the rows is one of its own, in which Spark splits a node with very many copies.
    found = stored(found, "found")
    rows_ = signed.drop("bands").join(found, "node", "left")
    rows_ = stored(rows_, "labelled")
    named = rows_.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    joined = rows_.join(named, "label", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "r1",
        "r2",
        "node",
        "label",
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "class_id", "n_links")
