"""Token counts: pieces are counted once per distinct pre-token and summed by document; no ids are made."""

from __future__ import annotations

import zlib
from functools import cached_property
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinrun.llm.blocks import answered, asked, by_bucket, finished, in_blocks
from twinrun.llm.chunks import Memo, slices
from twinrun.llm.common import table

LIMIT = 2048
#: Larger blocks than elsewhere: the more text shares a list of distinct pre-tokens, the fewer of them move.
COUNT_BLOCK_BYTES = 8 << 20

# The pattern of the vocabulary file that splits normalised text, and what begins a special token.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"


class WordVocabulary:
    """A vocabulary file of the tokenizers library that lower-cases text and splits it into words."""

    def __init__(self, text: str):
        self.text = text

    def __getstate__(self) -> dict:
        return {"text": self.text}

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.text)

    @cached_property
    def finder(self):
        return regex.compile(PRE_TOKENS)

    @cached_property
    def byte_names(self) -> list[str]:
        """The printable character that stands for each byte: itself, or one from 256 on, in order."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(other)) for b in range(256)]

    def split(self, chunk: str) -> tuple[str, ...]:
        """Pre-tokens of a chunk without white space. One that may hold a special token stays whole, as it is."""
        if SPECIAL in chunk:
            return (chunk,)
        if chunk.isascii():
            return tuple(self.finder.findall(chunk.lower()))
        lower = self.library.normalizer.normalize_str(chunk)  # its own Unicode tables and rules decide
        return tuple(self.finder.findall(lower))

    @cached_property
    def pre_tokens(self) -> Memo:
        return Memo(self.split)

    def count(self, pre_token: str) -> int:
        """Pieces of a pre-token."""
        if SPECIAL in pre_token:
            return len(self.library.encode(pre_token, add_special_tokens=False).ids)
        return len(self.library.model.tokenize("".join(map(self.byte_names.__getitem__, pre_token.encode()))))


class _Block:
    """The chunks of a block's texts, and its distinct pre-tokens in the order in which the buckets hear of them."""

    def __init__(self, texts: pa.Array, vocabulary: WordVocabulary, n_buckets: int):
        self.parts, known, pieces = [], {}, []
        for part in slices(texts):
            lists = pc.ascii_split_whitespace(part)
            coded = lists.values.dictionary_encode()
            number = [known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()]
            index = np.asarray(number, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            self.parts.append((index, lists.offsets.to_numpy().astype(np.int64)))
        pieces = [vocabulary.pre_tokens[w] for w in known]
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place: dict[str, int] = {}
        self.flat = np.asarray([place.setdefault(p, len(place)) for ps in pieces for p in ps], np.int64)
        tokens = list(place)
        raw = [t.encode() for t in tokens]
        buckets = np.fromiter((xxhash.xxh3_64_intdigest(r) % n_buckets for r in raw), np.int64, len(raw))
        #: Pre-tokens by bucket; within a bucket in byte order.
        self.order = np.asarray(sorted(range(len(raw)), key=lambda i: (buckets[i], raw[i])), np.int64)
        self.buckets, self.raw = buckets, raw

    def questions(self) -> list[tuple[int, bytes]]:
        found, of = self._runs()
        return [(int(b), zlib.compress(b" ".join([self.raw[i] for i in run]), 1)) for b, run in zip(found, of)]

    def _runs(self):
        ordered = self.buckets[self.order]
        found, starts = np.unique(ordered, return_index=True)
        return found, np.split(self.order, starts[1:]) if len(found) else []

    def totals(self, answers: dict[int, bytes]) -> list[int]:
        """Pieces of each text."""
        count = np.zeros(len(self.raw), np.int64)
        for b, run in zip(*self._runs()):
            count[run] = np.frombuffer(answers[int(b)], "<u4")
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        sums = np.concatenate([[0], np.cumsum(count[self.flat])])
        by_chunk = sums[ends[1:]] - sums[ends[:-1]]
        out = []
        for index, offsets in self.parts:
            total = np.concatenate([[0], np.cumsum(by_chunk[index])])
            out += (total[offsets[1:]] - total[offsets[:-1]]).tolist()
        return out


def file_place() -> Column:
    """File and number of a row that is read from a Parquet file."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def token_counts(docs: DataFrame, path: str, text: str = "text", block_bytes: int = COUNT_BLOCK_BYTES, place: Column | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` (long) of whole texts, one row for each row of the input.

    Blocks of documents send each distinct pre-token once to its bucket, the bucket counts the pieces of each distinct
    pre-token once, and the blocks sum the counts over their texts. NULL and empty texts have 0 bytes and tokens;
    repeated rows are counted each; other columns are left out. Special strings count as the library takes them.
    ``place`` tells full copies of a row apart, so that they spread over the blocks (``file_place`` for a table in files).
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(WordVocabulary(Path(path).read_text()))
    dealt, n = in_blocks(docs, text, block_bytes=block_bytes, place=place)
    id_type = dealt.schema["doc_id"].dataType.simpleString()

    def keys_of(rows: pa.Table) -> list[tuple[int, bytes]]:
        return _Block(rows["text"].combine_chunks(), vocabulary.value, n).questions()

    def count(payloads: list[bytes], _: list[int]) -> list[bytes]:
        v, known = vocabulary.value, {}
        out = []
        for payload in payloads:
            tokens = zlib.decompress(payload).split(b" ")
            for t in tokens:
                if t not in known:
                    known[t] = v.count(t.decode())
            out.append(np.fromiter(map(known.__getitem__, tokens), "<u4", len(tokens)).tobytes())
        return out

    def total(rows: pa.Table, known: pa.Table) -> pa.Table:
        texts = rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string())
        totals = _Block(texts, vocabulary.value, n).totals(by_bucket(known, 0))
        n_bytes = pc.binary_length(texts).cast(pa.int64())
        return pa.table([rows["doc_id"].combine_chunks(), n_bytes, pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    answers = answered(asked(dealt, keys_of), 0, count)
    return finished(dealt, answers, total, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), place=file_place())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
