"""Byte-level BPE: a minimal perfect hash finds pre-tokens that are in the vocabulary, a heap merges the others."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.chunks import SPACE_AFTER_WHITE, slices
from twinrun.llm.common import table

#: Keys in a bucket of the perfect hash, on average.
BUCKET = 4
#: Displacements that are tried at once, and matches in a generation of the memo.
TRIED = 64
KEPT = 250_000
#: From so many new matches on, those that miss merge together.
TOGETHER = 2_000
_LOW, _ALL = (1 << 32) - 1, (1 << 64) - 1
_GOLD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash: n keys have the slots 0 to n-1, by one 64-bit hash and one displacement per bucket.

    Buckets choose in order of their size the first displacement that puts all their keys into free slots, many tried
    at once; a bucket of one key takes a slot that is left and notes it. A lookup compares the key in its slot, so
    strings that are no keys are told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = max(1, len(ranks))
        self.n_slots, self.n_buckets = n, max(1, n // BUCKET)
        keys = list(ranks)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[order], return_index=True)
        members = dict(zip(found.tolist(), np.split(order, starts[1:]) if len(found) else []))
        free = np.ones(n, bool)
        place = np.zeros(len(keys), np.int64)
        self.moves = [0] * self.n_buckets
        alone = []
        for at, own in sorted(members.items(), key=lambda b: -len(b[1])):
            if len(own) == 1:
                alone.append((at, own[0]))
                continue
            move = 0
            while True:
                tried = np.arange(move, move + TRIED, dtype=np.uint64)[:, None]
                slots = self._slots(hashes[own], tried)
                fits = free[slots].all(axis=1)
                for i in np.flatnonzero(fits):
                    if len(set(slots[i].tolist())) == len(own):
                        break
                else:
                    move += TRIED
                    continue
                break
            self.moves[at] = move + int(i)
            place[own], free[slots[i]] = slots[i], False
        for (at, own), slot in zip(alone, np.flatnonzero(free).tolist()):
            self.moves[at], place[own] = -slot - 1, slot
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [-1] * n
        for key, slot in zip(keys, place.tolist()):
            self.keys[slot], self.ranks[slot] = key, ranks[key]

    def _slots(self, hashes: np.ndarray, moves: np.ndarray) -> np.ndarray:
        # The displacement enters through a product, so that all low bits of the hash matter for every value of it; the
        # upper 32 bits of the outcome, times the number of slots, give the slot.
        mixed = (hashes ^ (moves * np.uint64(_GOLD))) * np.uint64(_MIX)
        return ((mixed >> np.uint64(32)) * np.uint64(self.n_slots) >> np.uint64(32)).astype(np.int64)

    def rank(self, key: bytes) -> int:
        """The rank of a key; -1 for any other string."""
        h = xxhash.xxh3_64_intdigest(key)
        move = self.moves[h % self.n_buckets]
        slot = ((((h ^ (move * _GOLD & _ALL)) * _MIX & _ALL) >> 32) * self.n_slots >> 32) if move >= 0 else -move - 1
        return self.ranks[slot] if self.keys[slot] == key else -1


class Merges:
    """What merges: the id of each byte, and of each pair of ids whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece: its bytes are linked, and the pair of neighbours of least rank (leftmost of equals) merges next.

        A heap holds the pairs as rank and place in one number, so n bytes take O(n log n). ``now`` has the rank of the
        pair that begins at each place; one in the heap that differs is outdated.
        """
        n, pair = len(piece), self.pairs.get
        ids = [self.of_byte[b] for b in piece]
        if -1 in ids:
            raise ValueError(f"byte {piece[ids.index(-1)]} is not in the vocabulary")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [pair(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        now.append(-1)
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            r, i = top >> 32, top & _LOW
            if now[i] != r:
                continue
            j = after[i]
            ids[i], now[j] = r, -1
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                now[i] = new = pair(r << 32 | ids[k], -1)
                if new >= 0:
                    push(heap, new << 32 | i)
            else:
                now[i] = -1
            if p >= 0:
                now[p] = new = pair(ids[p] << 32 | r, -1)
                if new >= 0:
                    push(heap, new << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


    @cached_property
    def _sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for none."""
        keys, ranks = self._sorted_pairs
        asked = left << 32 | right
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, ranks[at], -1)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pieces, none of them empty, as ``merged`` gives them one by one.

        One heap serves all: it holds ranks, and with each rank go the places in the linked bytes of all pieces where a
        pair has it. The least rank is taken; of its places each piece merges its first, all pieces at once, and the
        others wait. New pairs go to their ranks. As pieces share nothing, each sees its merges in its own order.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.asarray(self.of_byte, np.int64)[data]
        if (ids < 0).any() or not self.pairs:
            return [struct.pack(f"<{len(x)}I", *x) for x in map(self.merged, pieces)]
        n = len(ids)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        now = np.full(n, -1, np.int64)
        first = np.flatnonzero(after >= 0)
        now[first] = self._ranks(ids[first], ids[first + 1])
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for a, b, r in zip(starts, starts[1:], ranks[starts[:-1]].tolist()):
                if r in waiting:
                    waiting[r].append(places[a:b])
                else:
                    waiting[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        pairs = np.flatnonzero(now >= 0)
        if len(pairs):
            wait(pairs, now[pairs])
        while heap:
            rank = heapq.heappop(heap)
            found = waiting.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[now[at] == rank]
            if not len(at):
                continue
            own = piece[at]
            again = np.flatnonzero(own[1:] == own[:-1]) + 1
            if len(again):
                waiting[rank] = [at[again]]
                heapq.heappush(heap, rank)
                at = np.delete(at, again)
            gone = after[at]
            ids[at], now[gone], alive[gone] = rank, -1, False
            right = after[gone]
            after[at], now[at] = right, -1
            near, right = at[right >= 0], right[right >= 0]
            before[right] = near
            left = before[at]
            left = left[left >= 0]
            here = np.concatenate([near, left])
            if not len(here):
                continue
            new = self._ranks(ids[here], ids[after[here]])
            now[here] = new
            valid = new >= 0
            if valid.any():
                wait(here[valid], new[valid])
        out = ids[alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(piece[alive], minlength=len(pieces))) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops)]


class Kept(dict):
    """Answers by short strings in two generations: when the newer is full it becomes the older, and what was older and
    not asked for since is gone. Memory stays bounded, and frequent strings stay."""

    def __init__(self, make, size: int = KEPT, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def lacks(self, keys: Iterable[str]) -> list[str]:
        """Those of distinct keys that have no answer yet, long ones left out."""
        return [k for k in keys if k not in self and k not in self.older and len(k) <= self.longest]


class _Tables:
    """What an executor needs of a vocabulary: fixed in size, so it is broadcast. Memos stay with the worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.hash = PerfectHash(ranks)
        self.pattern = public_tokenizers.PATTERN

    @cached_property
    def finder(self):
        return regex.compile(self.pattern)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes of each id; ids that the vocabulary leaves out are empty."""
        out = [b""] * (max(self.hash.ranks) + 1)
        for key, r in zip(self.hash.keys, self.hash.ranks):
            out[r] = key
        return out

    def text_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ids_of_pretoken(self, pretoken: str) -> bytes:
        piece = pretoken.encode("utf-8", "surrogatepass")
        r = self.hash.rank(piece)
        ids = (r,) if r >= 0 else self.merges.merged(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    @cached_property
    def merges(self) -> Merges:
        return Merges({k: r for k, r in zip(self.hash.keys, self.hash.ranks) if k is not None})

    @cached_property
    def pretokens(self) -> Kept:
        return Kept(self.ids_of_pretoken)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.finder.findall(text)))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them, none of which holds one. The pattern goes over all of them in one
        string: a space after a character that is no white space begins a match, so matches end with the words."""
        pieces = self.finder.findall(" " + " ".join(words)) if words else []
        self._learn(set(pieces))
        ids = list(map(self.pretokens.__getitem__, pieces))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)) + 1
        firsts = [0, *last[:-1].tolist()]
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(firsts, last.tolist())]

    def _learn(self, pieces: set[str]) -> None:
        """Put the answers for many new pieces into the memo; for few it is not worth while."""
        new = self.pretokens.lacks(pieces)
        if len(new) < TOGETHER:
            return
        rank, missed = self.hash.rank, []
        for text in new:
            raw = text.encode("utf-8", "surrogatepass")
            r = rank(raw)
            if r >= 0:
                self.pretokens.keep(text, r.to_bytes(4, "little"))
            else:
                missed.append((text, raw))
        for (text, _), ids in zip(missed, self.merges.merged_together([raw for _, raw in missed])):
            self.pretokens.keep(text, ids)

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text. Texts are cut at spaces and each distinct word is looked up once; a text in which a
        space follows white space is taken whole."""
        odd = pc.match_substring_regex(texts, SPACE_AFTER_WHITE)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False).tolist()
        ends = lists.offsets.to_numpy().tolist()
        # A word that ends in white space is the last of its text; next to another word it would be matched otherwise.
        whole = [not w or w[-1].isspace() or w[-1] == "\u180e" for w in words]
        together = iter(self.of_words([w for w, alone in zip(words, whole) if not alone]))
        ids = [self.whole(" " + w) if alone else next(together) for w, alone in zip(words, whole)]
        out = []
        for row, long_way in enumerate(odd.to_pylist()):
            if long_way:
                out.append(self.whole(texts[row].as_py()))
                continue
            a, b = ends[row], ends[row + 1]
            first = words[index[a]] if b > a else ""
            out.append((self.whole(first) if first else b"") + b"".join(map(ids.__getitem__, index[a + 1 : b])))
        return out

    def __getstate__(self) -> dict:
        return {"hash": self.hash, "pattern": self.pattern}


class ByteBpe:
    """Encoder and decoder over a rank file (lines of base64 bytes and rank). The file is read on the driver only."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.tables: Broadcast[_Tables] = spark.sparkContext.broadcast(_Tables(ranks))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ByteBpe:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        return cls(spark, {base64.b64decode(token): int(rank) for token, rank in lines})

    def encode(self, docs: DataFrame, text: str = "text", decoded: bool = False) -> DataFrame:
        """Ids of whole texts: ``row`` (the input row without its text) and ``ids``, one binary value of little-endian
        unsigned 32-bit integers; with ``decoded`` also the bytes that the ids stand for, made from the ids.

        Each match of the pattern is looked up in the perfect hash first; a miss is merged byte by byte. Answers for
        short matches are remembered in a bounded memo. NULL and empty texts have no ids. Long texts and long words take
        linear memory and O(n log n) time. Repeated rows are encoded each; other columns stay inside ``row``. An empty
        table gives no rows.
        """
        tables = self.tables
        others = [F.col(f"`{c}`") for c in docs.columns if c != text]
        given = docs.select(F.struct(*others or [F.lit(None).alias("none")]).alias("row"), F.col(text).cast("string").alias("text"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tables.value
            for batch in batches:
                done = 0
                for part in slices(batch["text"]):
                    ids = t.texts(part)
                    columns = [batch["row"].slice(done, len(ids)), pa.array(ids, pa.binary())]
                    if decoded:
                        columns.append(pa.array(map(t.text_of, ids), pa.binary()))
                    done += len(ids)
                    yield pa.record_batch(columns, names=["row", "ids", "decoded"][: len(columns)])

        added = [T.StructField(name, T.BinaryType()) for name in ["ids", "decoded"][: 1 + decoded]]
        return given.mapInArrow(encode, T.StructType([given.schema["row"], *added]))

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for; NULL: empty. Bytes need not be valid UTF-8, so the column is binary."""
        tables = self.tables

        @F.arrow_udf("binary")
        def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([tables.value.text_of(x.as_py() or b"") for x in batch], pa.binary())

        return text(ids)


def op1_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    bpe = ByteBpe.load(spark, public_tokenizers.path(ranks))
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return encoded.select(
        "row.doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
