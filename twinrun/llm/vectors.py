"""Approximate nearest neighbours: balanced posting lists, boundary vectors in several of them, centroids in a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.common import stored, table

#: Vectors per list aimed at; lists at most, which bounds what is broadcast; sampled vectors per list for fitting.
LIST_SIZE, MOST_LISTS, SAMPLE_PER_LIST = 128, 4096, 24
#: Lists a vector may stand in, and how much farther than the nearest centroid those may be.
COPIES, REACH = 4, 1.15
#: How much farther than its nearest centroid the lists are that a query reads.
PRUNE = 1.18
#: Rows a query reads at least, as a multiple of those that hold k others for certain; a query that still finds fewer
#: reads WIDER times as many, and again.
SEEN, WIDER = 4, 16
#: Neighbours of a centroid in the graph, near and random; beam for placing a vector; for a query the beam is at least
#: LEAST_BEAM and a share of all lists, so that what it can reach keeps pace with their number.
NEAR, RANDOM, HOME_BEAM, LEAST_BEAM, BEAM_SHARE = 24, 8, 16, 64, 6
#: Rows of a list, and queries, that meet in one task.
CHUNK, QUERY_BLOCK = 4096, 1024


def usable(vector: Column, dimension: int) -> Column:
    """Vectors that take part: of the given length, every component finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimension) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means in which a list that is larger than the mean is charged for it, so that sizes even out."""
    random = np.random.default_rng(11)
    centers = sample[random.choice(len(sample), k, replace=False)].copy()
    charge, mean = np.zeros(k), len(sample) / k
    for _ in range(rounds):
        label, near = np.empty(len(sample), np.int64), 0.0
        for a in range(0, len(sample), 2048):
            d = _squares(sample[a : a + 2048], centers)
            label[a : a + 2048] = (d + charge).argmin(1)
            near += d.min(1).sum()
        size = np.bincount(label, minlength=k)
        charge = np.clip(charge + 0.2 * near / len(sample) * (size / mean - 1), 0, None)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, sample)
        empty = size == 0
        centers = np.where(empty[:, None], centers, sums / np.maximum(size, 1)[:, None])
        if empty.any():  # begin anew inside the largest lists
            centers[empty] = sample[random.choice(len(sample), int(empty.sum()), replace=False)]
    return centers


@dataclass
class CentroidGraph:
    """Centroids, each linked to its nearest ones and to some at random; searched by a beam, many vectors at a time."""

    centers: np.ndarray
    links: np.ndarray
    #: Usual distance of a vector to its nearest centroid. Ratios are taken of no less, so that a vector that lies on a
    #: centroid still looks around itself.
    spread: float

    @classmethod
    def of(cls, centers: np.ndarray, sample: np.ndarray) -> CentroidGraph:
        k, random = len(centers), np.random.default_rng(12)
        near = min(NEAR, k - 1)
        links = np.empty((k, near + RANDOM), np.int64)
        for a in range(0, k, 1024):
            d = _squares(centers[a : a + 1024], centers)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links[a : a + 1024, :near] = np.argsort(d, axis=1)[:, :near]
        links[:, near:] = random.integers(0, k, (k, RANDOM))
        # A centroid that stands twice in a row gives way to the row's own, which a search has always seen.
        for row, own in zip(links, range(k)):
            _, first = np.unique(row, return_index=True)
            again = np.ones(len(row), bool)
            again[first] = False
            row[again] = own
        near = [np.sqrt(_squares(sample[a : a + 2048], centers).min(1)) for a in range(0, len(sample), 2048)]
        return cls(centers, links, float(np.mean(np.concatenate(near))))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each vector, nearest first: numbers and distances."""
        k = len(self.centers)
        if k <= width:
            d = _squares(x, self.centers)
            at = np.argsort(d, axis=1, kind="stable")
            return at, np.sqrt(np.take_along_axis(d, at, 1))
        start = np.linspace(0, k - 1, width).astype(np.int64)
        rows = np.arange(len(x))
        seen = np.zeros((len(x), k), bool)
        seen[:, start] = True
        d = _squares(x, self.centers[start])
        order = np.argsort(d, axis=1)
        at, d = start[order], np.take_along_axis(d, order, 1)
        done = np.zeros(at.shape, bool)
        while len(rows):
            pick = np.argmin(done[rows], axis=1)
            done[rows, pick] = True
            fresh = self.links[at[rows, pick]]
            gap = self.centers[fresh] - x[rows, None]
            far = np.einsum("ijk,ijk->ij", gap, gap)
            far[seen[rows[:, None], fresh]] = np.inf
            seen[rows[:, None], fresh] = True
            every = np.concatenate([d[rows], far], 1)
            order = np.argsort(every, axis=1, kind="stable")[:, :width]
            at[rows] = np.take_along_axis(np.concatenate([at[rows], fresh], 1), order, 1)
            d[rows] = np.take_along_axis(every, order, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(fresh.shape, bool)], 1), order, 1)
            rows = rows[~done[rows].all(1)]
        return at, np.sqrt(d)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Lists of each vector, -1 where there is none: the nearest, and those little farther, so that a vector near a
        boundary stands on all its sides."""
        at, d = self.search(x, HOME_BEAM)
        at, d = at[:, :COPIES], d[:, :COPIES]
        return np.where(d <= REACH * np.maximum(d[:, :1], self.spread), at, -1)

    def probes(self, x: np.ndarray, sizes: np.ndarray, enough: int, wide: bool = False) -> np.ndarray:
        """Lists a query reads, -1 where there is none: those found whose centroid is within PRUNE of the nearest, and
        the nearest until they hold ``enough`` rows. ``wide`` finds all lists."""
        at, d = self.search(x, len(self.centers) if wide else max(LEAST_BEAM, len(self.centers) // BEAM_SHARE))
        rows = sizes[at]
        before = np.cumsum(rows, 1) - rows
        return np.where((rows > 0) & ((d <= PRUNE * np.maximum(d[:, :1], self.spread)) | (before < enough)), at, -1)


@dataclass
class VectorIndex:
    """Posting lists as a stored table (``vec_id, vector, list``) and the graph over their centroids."""

    postings: DataFrame
    graph: CentroidGraph
    dimension: int
    #: Rows of each list.
    sizes: np.ndarray

    @classmethod
    def build(cls, rows: DataFrame, vector: str = "embedding", list_size: int = LIST_SIZE) -> VectorIndex | None:
        """Every usable vector is indexed, rows with the same id and vector as one. Centroids are fitted on
        SAMPLE_PER_LIST * lists vectors, the first by a hash of their id. The dimension is the most frequent length (of
        equals the smallest). None: no vector is usable."""
        spark = rows.sparkSession
        given = rows.select("vec_id", F.col(vector).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
        sizes = given.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
        if not sizes:
            return None
        dimension = sizes[0]["n"]
        good = stored(given.where(usable(F.col("vector"), dimension)).distinct(), "vectors")
        n = good.count()
        if not n:
            return None
        lists = min(MOST_LISTS, max(1, n // list_size))
        first = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n, SAMPLE_PER_LIST * lists)).select("vector")
        sample = matrix(first.toArrow()["vector"])
        graph = CentroidGraph.of(balanced_centroids(sample, lists), sample)
        shared = spark.sparkContext.broadcast(graph)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    part = batch.slice(a, 1024)
                    homes = shared.value.homes(matrix(part["vector"]))
                    row, place = np.nonzero(homes >= 0)
                    out = part.take(pa.array(row))
                    yield pa.record_batch([out["vec_id"], out["vector"], pa.array(homes[row, place], pa.int32())], names=["vec_id", "vector", "list"])

        schema = T.StructType([*good.schema.fields, T.StructField("list", T.IntegerType())])
        postings = stored(good.mapInArrow(post, schema), "postings")
        held = np.zeros(lists, np.int64)
        for r in postings.groupBy("list").count().collect():  # at most MOST_LISTS rows
            held[r["list"]] = r["count"]
        return cls(postings, graph, dimension, held)

    def search(self, queries: DataFrame, vector: str = "embedding", k: int = 10) -> DataFrame:
        """``query_id, rank, vec_id, score``: the k nearest found of each usable query, by Euclidean distance in double
        precision, ties to the smaller vec_id; all candidates only where there are fewer than k. Rows with the query's
        own vec_id are left out; a repeated row counts once. Lists and queries that are large meet in parts, of which no
        row is left out.

        A vector stands in at most COPIES lists, so COPIES * (k + 1) rows hold k other ids. Only ids with many vectors
        can leave a query with fewer: it searches again, wider, at last over all lists."""
        asked = queries.select(F.col("vec_id").alias("query_id"), F.col(vector).alias("q")).where("query_id IS NOT NULL")
        asked = asked.where(usable(F.col("q"), self.dimension)).distinct()
        enough, lists, found = SEEN * COPIES * (k + 1), int((self.sizes > 0).sum()), []
        while True:
            probes = self._probes(asked, enough, wide=bool(found))
            found.append(stored(_ranked(self._near(probes, k), k), "neighbours"))
            have = found[-1].groupBy("query_id").agg(F.count("*").alias("have"))
            few = probes.groupBy("query_id").agg(F.countDistinct("list").alias("read")).join(have, "query_id", "left")
            few = few.where((F.coalesce("have", F.lit(0)) < k) & (F.col("read") < lists)).select("query_id")
            if few.isEmpty():
                break
            asked, enough = asked.join(few, "query_id", "left_semi"), enough * WIDER
        if len(found) == 1:
            return found[0]
        return _ranked(reduce(DataFrame.union, found), k)

    def _probes(self, asked: DataFrame, enough: int, wide: bool) -> DataFrame:
        """``query_id, q, list``: the lists that each query reads."""
        shared = asked.sparkSession.sparkContext.broadcast((self.graph, self.sizes))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    part = batch.slice(a, 1024)
                    graph, sizes = shared.value
                    lists = graph.probes(matrix(part["q"]), sizes, enough, wide)
                    row, place = np.nonzero(lists >= 0)
                    out = part.take(pa.array(row))
                    yield pa.record_batch([out["query_id"], out["q"], pa.array(lists[row, place], pa.int32())], names=["query_id", "q", "list"])

        schema = T.StructType([*asked.schema.fields, T.StructField("list", T.IntegerType())])
        return stored(asked.mapInArrow(probe, schema), "probes")

    def _near(self, probes: DataFrame, k: int) -> DataFrame:
        """``query_id, vec_id, score``: the k nearest in each part of each list that a query reads."""
        # At most MOST_LISTS rows: how many parts the rows and the queries of each list have.
        sizes = self.postings.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        loads = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        parts = F.broadcast(sizes.join(loads, "list"))

        def spread(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        rows = self.postings.join(parts, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
        rows = rows.select("list", "chunk", spread("blocks").alias("block"), "vec_id", "vector")
        probes = probes.join(parts, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
        probes = probes.select("list", spread("chunks").alias("chunk"), "block", "query_id", "q")

        def nearest(found: pa.Table, wanted: pa.Table) -> pa.Table:
            out = [], [], []
            if len(found) and len(wanted):
                rows = found.sort_by("vec_id")
                ids, starts = np.unique(rows["vec_id"].to_numpy(), return_index=True)
                x = matrix(rows["vector"])
                for query, q in zip(wanted["query_id"].to_pylist(), matrix(wanted["q"])):
                    gap = x - q
                    far = np.minimum.reduceat(np.sqrt((gap * gap).sum(1)), starts)  # of each id its nearest row
                    other = np.flatnonzero(ids != query)
                    if len(other) > k:  # nothing beyond the k-th distance; ties with it stay
                        other = other[far[other] <= np.partition(far[other], k - 1)[k - 1]]
                    best = other[np.lexsort((ids[other], far[other]))][:k]
                    out[0].extend([query] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend(far[best].tolist())
            return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        keys = ["list", "chunk", "block"]
        return rows.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(nearest, "query_id bigint, vec_id bigint, score double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each query, of each vec_id its least score."""
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, vector: str = "embedding", k: int = 10) -> DataFrame:
    """Index ``rows`` (``vec_id`` long and a vector column) and search it; no usable vector gives no rows."""
    index = VectorIndex.build(rows, vector)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return index.search(queries, vector, k)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))
