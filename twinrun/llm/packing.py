"""Best-fit packing by sums of squares: each piece goes where the squared counts of open bins per gap become smallest."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.chunks import Memo, ids_by_chunk, packed, slices
from twinrun.llm.common import stored, table

CAPACITY = 1024
END_ID = 2
#: Pieces that are packed together. Groups are dealt at random, so each sees the same mix of lengths, and the bins a
#: group leaves partly filled are a few in thousands. A group of this size takes some MB, whatever the input's size.
GROUP = 25_000


class JsonVocabulary:
    """A byte-level vocabulary in the JSON form of the tokenizers library, as ranks by bytes, with its special tokens."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        spec = json.loads(self.text)
        # The file writes bytes as printable characters: those that are printable stand for themselves, the others
        # for the characters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in vocab.items() if k not in special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        return packed(self.encoding.encode(text, allowed_special="all"))

    @cached_property
    def chunks(self) -> Memo:
        return Memo(self.whole)

    def __getstate__(self) -> dict:
        return {"text": self.text}


def token_ids(spark: SparkSession, text: Column, path: str) -> Column:
    """Packed ids (little-endian unsigned 32-bit) of whole texts; NULL: none. Special strings count as their tokens."""
    vocabulary = spark.sparkContext.broadcast(JsonVocabulary(Path(path).read_text()))

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary.value
        for batch in batches:
            yield pa.array([x for part in slices(batch) for x in ids_by_chunk(part, v.chunks, v.whole)], pa.binary())

    return ids(text)


def pieces_of(ids: Column, capacity: int = CAPACITY) -> Column:
    """Pieces of a packed id sequence: array of (piece, start, length, ids_crc32). Only longer sequences are cut, into
    pieces of ``capacity``; what is left over comes first."""
    n = F.floor(F.octet_length(ids) / 4).cast("int")
    count = F.greatest(F.lit(1), F.ceil(n / capacity).cast("int"))
    short = n - (count - 1) * capacity

    def piece(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(short + (k - 1) * capacity)
        length = F.when(k == 0, short).otherwise(capacity)
        return F.struct(
            k.alias("piece"),
            start.cast("bigint").alias("start"),
            length.cast("bigint").alias("length"),
            F.crc32(F.substring(ids, start * 4 + 1, length * 4)).alias("ids_crc32"),
        )

    return F.transform(F.sequence(F.lit(0), count - 1), piece)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given.

    ``open_bins[g]`` counts the open bins with a gap of g. Putting a piece of length s into such a bin changes the sum
    of squares by 2 * (N[g-s] - N[g]) + 2, or by 1 - 2 * N[g] when that fills the bin, which then is no longer open; a
    new bin changes it by 2 * N[capacity-s] + 1. The least change wins; of equals the smallest gap, then an old bin.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[0] stays 0: full bins do not count
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.int64(1) << 60
    at, offset, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        have, then = count[s:capacity], count[: capacity - s]
        change = np.where(have > 0, 2 * (then - have) + 2, never)
        if len(change) and have[0] > 0:
            change[0] = 1 - 2 * have[0]
        best = int(change.argmin()) if len(change) else -1
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best >= 0 and change[best] <= fresh:
            gap = s + best
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        at[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return at, offset


def place_all(lengths: np.ndarray, capacity: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of a group.

    The longest come first; the short ones follow by length, or mixed in the order given (up to 1/8, 1/4 or 1/2 of a
    bin). In each round the pieces of all bins that did not fill are placed once more in the order that saves most.
    """

    def best(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for share in (0, 8, 4, 2):
            mixed = share * sizes <= capacity if share else np.zeros(len(sizes), bool)
            order = np.lexsort((np.arange(len(sizes)), np.where(mixed, 0, -sizes)))
            placed = np.empty((2, len(sizes)), np.int64)
            placed[:, order] = place(sizes[order], capacity)
            found.append(placed)
        return min(found, key=lambda f: f[0].max(initial=-1))

    at, offset = best(lengths)
    for _ in range(rounds):
        loose = np.flatnonzero(np.bincount(at, weights=lengths)[at] < capacity)
        bins = np.unique(at[loose])
        again, moved = best(lengths[loose])
        if not len(bins) or again.max() + 1 >= len(bins):
            break
        at[loose], offset[loose] = bins[again], moved
    return at, offset


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces (lengths 1 to ``capacity``) with ``sequence_id`` and ``offset`` (long) added, behind a ``piece_row`` struct.

    Pieces are stored first and dealt at random to groups of about ``group`` pieces; each is packed by itself with
    ``place_all``. Equal pieces and repeated rows are packed one by one; an empty table gives an empty one. Group numbers
    make the sequence ids of different groups differ.
    """
    rows = pieces.select(F.struct("*").alias("piece_row"), F.monotonically_increasing_id().alias("n"))
    rows = stored(rows, "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.select(
        "piece_row",
        F.col(f"piece_row.`{length}`").cast("bigint").alias("size"),
        F.pmod(F.xxhash64("n"), F.lit(groups)).alias("g"),
        F.xxhash64(F.lit(1), "n").alias("order"),
    )
    schema = T.StructType(
        [dealt.schema["piece_row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def packed_group(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("order", "ascending")]))
        at, offset = place_all(rows["size"].to_numpy(), capacity)
        ids = at + (rows["g"].to_numpy() << 32)
        return pa.table([rows["piece_row"], pa.array(ids), pa.array(offset)], names=["piece_row", "sequence_id", "offset"])

    return dealt.groupBy("g").applyInArrow(packed_group, schema)


def pack_documents(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces in sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    NULL and empty texts are one piece that holds the end id alone. Rows are documents of their own, also when their
    doc_id or text repeats. Other columns are left out.
    """
    end = F.lit(bytearray(packed([END_ID])))
    ids = docs.select("doc_id", F.concat(token_ids(docs.sparkSession, F.col(text).cast("string"), path), end).alias("ids"))
    pieces = ids.select("doc_id", F.explode(pieces_of(F.col("ids"), capacity)).alias("p")).select("doc_id", "p.*")
    return pack(pieces, capacity=capacity).select("piece_row.*", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path(vocabulary))
