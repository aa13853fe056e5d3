"""Questions of blocks of documents to buckets of keys.

Documents are dealt to blocks of some MB by a hash. A block asks about each of its distinct keys once: it sends every
bucket one row with all its keys that belong there, and gets one row back. So a key that stands in a third of all rows
costs a bucket one entry per block, and the text itself is shuffled once: all passes over the blocks read the same
exchange of one plan. What a block wants to know again in its next pass it sends along as a note: a question to no bucket
(None), which comes back as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.common import row_key, shuffle_partitions

#: Text in a block, in bytes. Larger blocks ask fewer questions; a task holds one at a time.
BLOCK_BYTES = 4 << 20

ASK = "bucket int, block int, payload binary"
ANSWER = "block int, bucket int, kind int, payload binary"


def in_blocks(docs: DataFrame, text: str, *more: Column, block_bytes: int = BLOCK_BYTES, place: Column | None = None) -> tuple[DataFrame, int]:
    """``doc_id, text, block`` and further columns, dealt by block, and the number of blocks.

    The block is a hash of doc_id and text, so rows without an id spread as well. Full copies of a row share a block,
    unless ``place`` tells them apart: a value that a row has again whenever it is read again.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    salt = [] if place is None else [F.col("place")]
    chosen = docs.select(F.col("doc_id").alias("doc_id"), body.alias("text"), *more, *[] if place is None else [place.alias("place")])
    block = F.pmod(row_key(F.col("doc_id"), F.col("text"), *salt)[0], F.lit(n)).cast("int")
    return chosen.withColumn("block", block).drop("place").repartition(shuffle_partitions(docs.sparkSession), "block"), n


def asked(blocks: DataFrame, keys_of: Callable[[pa.Table], list[tuple[int | None, bytes]]]) -> DataFrame:
    """One row (bucket, block, payload) for each pair that ``keys_of`` gives for a block."""

    def ask(rows: pa.Table) -> pa.Table:
        return _questions(rows, keys_of(rows))

    return blocks.groupBy("block").applyInArrow(ask, ASK)


def asked_again(blocks: DataFrame, answers: DataFrame, keys_of: Callable[[pa.Table, pa.Table], list]) -> DataFrame:
    """The same for blocks that have answers to earlier questions."""

    def ask(rows: pa.Table, known: pa.Table) -> pa.Table:
        return _questions(rows, keys_of(rows, known) if len(rows) else [])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASK)


def _questions(rows: pa.Table, found: list[tuple[int | None, bytes]]) -> pa.Table:
    block = rows["block"][0].as_py() if len(rows) else 0
    # A note lies in a bucket of its block alone, below 0.
    buckets = pa.array([-1 - block if b is None else b for b, _ in found], pa.int32())
    return pa.table(
        [buckets, pa.array([block] * len(found), pa.int32()), pa.array([p for _, p in found], pa.binary())],
        names=["bucket", "block", "payload"],
    )


def answered(questions: DataFrame, kind: int, answer: Callable[[list[bytes], list[int]], list[bytes]]) -> DataFrame:
    """Answers of every bucket to all its questions at once: payloads and their blocks in, a payload for each out."""

    def of_bucket(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["block"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        payloads = rows["payload"].to_pylist()
        if rows["bucket"][0].as_py() >= 0:
            payloads = answer(payloads, rows["block"].to_pylist())
        kinds = pa.array([kind] * len(rows), pa.int32())
        columns = [rows["block"].combine_chunks(), rows["bucket"].combine_chunks(), kinds, pa.array(payloads, pa.binary())]
        return pa.table(columns, names=["block", "bucket", "kind", "payload"])

    return questions.groupBy("bucket").applyInArrow(of_bucket, ANSWER)


def finished(blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """The blocks with all their answers: ``finish`` gives the rows of the result."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def by_bucket(known: pa.Table, kind: int) -> dict[int | None, bytes]:
    """Answers by bucket; a note by None."""
    if not len(known):
        return {}
    kinds, buckets, payloads = (known[c].to_pylist() for c in ("kind", "bucket", "payload"))
    return {b if b >= 0 else None: p for k, b, p in zip(kinds, buckets, payloads) if k == kind}
