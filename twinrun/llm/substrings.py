"""Substring dedup: words inside windows that also start earlier are removed.

Difference-cover anchors find the candidates. The positions {0, 1, 3, 9} modulo 13 hold a pair for every difference
modulo 13, so two equal windows of 20 words share an offset of at most 12 at which both have an anchor, and the 8 words
from there are equal as well. So a window without a repeated anchor is unique, and only windows around repeated anchors
are looked at in full.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.llm.blocks import answered, asked, asked_again, by_bucket, finished, in_blocks
from twinrun.llm.common import BLANKS, table

WINDOW = 20
# A difference cover and its period.
COVER, PERIOD = (0, 1, 3, 9), 13

#: Bytes beyond which a word is hashed by itself, words hashed together, bytes of text in a block, and blocks for each
#: bucket: the messages between blocks and buckets grow with the product of their numbers.
LONG_WORD = 64
HASHED_AT_ONCE = 1 << 15
SPAN_BLOCK_BYTES = 8 << 20
BLOCKS_A_BUCKET = 2

_ANCHORS, _WINDOWS = 0, 1
_U = np.uint64
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_FIRST_BYTES = np.asarray([(1 << 8 * k) - 1 for k in range(9)], _U)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
_NO_ID = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Hashes of all spans of ``length`` word hashes: polynomials, put together from spans of powers of two."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, _U)
    total, done, power, size = np.zeros(n, _U), 0, words, 1
    while True:
        if length & size:
            total = total * _U(pow(factor, size, 1 << 64)) + power[done : done + n]
            done += size
        if size * 2 > length:
            return _mixed(total)
        power = power[:-size] * _U(pow(factor, size, 1 << 64)) + power[size:]
        size *= 2


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words ``raw[start:end]``, eight bytes of some thousand words at a time; long words one by one.
    ``raw`` goes on for 8 bytes behind the last word."""
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    hashes = np.empty(len(starts), _U)
    for at in range(0, len(starts), HASHED_AT_ONCE):
        place = starts[at : at + HASHED_AT_ONCE]
        size = ends[at : at + HASHED_AT_ONCE] - place
        found = _mixed(size.astype(_U))
        live = np.flatnonzero(size <= LONG_WORD)
        for done in range(0, LONG_WORD, 8):
            if not len(live):
                break
            piece = eights[place[live] + done] & _FIRST_BYTES[np.minimum(size[live] - done, 8)]
            found[live] = _mixed(found[live] * _U(_FACTORS[0]) ^ piece)
            live = live[size[live] > done + 8]
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            found[k] = xxhash.xxh3_64_intdigest(raw[place[k] : place[k] + size[k]])
        hashes[at : at + len(found)] = found
    return hashes


def _shared(keys: np.ndarray) -> np.ndarray:
    """For each key whether it stands more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    many = np.zeros(len(keys), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    return many


def _firsts(a: np.ndarray, b: np.ndarray, *rank: np.ndarray) -> np.ndarray:
    """For each row whether it is the first with its (a, b): by ``rank``, then by place. Only keys that repeat are sorted."""
    first = np.ones(len(a), bool)
    at = np.flatnonzero(_shared(a))
    order = at[np.lexsort((*[r[at] for r in rank], b[at], a[at]))]
    same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    first[order[1:][same]] = False
    return first


class _Block:
    """The words of a block's documents in order: where they stand in the text, their hashes, and windows over them."""

    def __init__(self, rows: pa.Table, window: int, n_buckets: int):
        ids = rows["doc_id"].to_pylist()
        texts = rows["text"].combine_chunks().cast(pa.binary()).to_pylist()
        # Bytes of UTF-8 have the order of the characters.
        self.order = sorted(range(len(ids)), key=lambda i: (_NO_ID if ids[i] is None else ids[i], texts[i]))
        self.window, self.n_buckets = window, n_buckets
        self.ids = np.asarray([_NO_ID if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.texts = [texts[i] for i in self.order]
        # A blank before each text and behind it, so that a word ends with its text.
        raw = np.frombuffer(b"\n".join([b"", *self.texts, bytes(8)]), np.uint8)
        blank = (raw == ord(" ")) | (raw - np.uint8(ord("\t")) <= ord("\r") - ord("\t"))
        blank[-8:] = True
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.at, self.to = edges[::2], edges[1::2]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.starts = np.searchsorted(self.at, np.concatenate([[0], np.cumsum(self.sizes + 1)]))
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        self.hashes = word_hashes(raw, self.at, self.to)

    def _left(self) -> np.ndarray:
        """For each word the number of words up to the end of its document."""
        return self.starts[self.doc + 1] - np.arange(len(self.doc))

    def _by_bucket(self, keys: np.ndarray):
        """Distinct buckets of the keys, and the positions of the keys of each, in order."""
        buckets = (keys % _U(self.n_buckets)).astype(np.uint16 if self.n_buckets <= 1 << 16 else np.uint32)
        order = np.argsort(buckets, kind="stable")
        found, starts = np.unique(buckets[order], return_index=True)
        return zip(found.tolist(), np.split(order, starts[1:])) if len(found) else []

    def find_anchors(self) -> None:
        words = self.window - PERIOD + 1
        within = np.arange(len(self.doc)) - self.starts[self.doc]
        self.anchor_at = np.flatnonzero(_IN_COVER[within % PERIOD] & (self._left() >= words))
        spans = span_hashes(self.hashes, words, _FACTORS[0])
        self.anchors, self.anchor_of, self.anchor_n = np.unique(spans[self.anchor_at], return_inverse=True, return_counts=True)

    def ask_anchors(self) -> list[tuple[int, bytes]]:
        self.find_anchors()
        return [(b, self.anchors[at].tobytes()) for b, at in self._by_bucket(self.anchors)]

    def find_windows(self, known: pa.Table) -> None:
        """Windows around repeated anchors."""
        self.find_anchors()
        repeated = self.anchor_n > 1
        answers = by_bucket(known, _ANCHORS)
        for b, at in self._by_bucket(self.anchors):
            repeated[at] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(at)).astype(bool)
        # A window from s holds the anchors from s to s + PERIOD - 1.
        marks = np.zeros(len(self.hashes) + 1, np.int64)
        marks[1:][self.anchor_at[repeated[self.anchor_of]]] = 1
        sums = np.cumsum(marks)
        starts = np.flatnonzero(self._left() >= self.window)
        ends = np.minimum(starts + PERIOD, len(self.hashes))
        self._take_windows(starts[sums[ends] > sums[starts]])

    def _take_windows(self, windows: np.ndarray) -> None:
        """The windows, and the first of each word sequence in this block, in order."""
        self.windows = windows
        a, b = (span_hashes(self.hashes, self.window, f)[windows] if len(windows) else np.empty(0, _U) for f in _FACTORS)
        fresh = _firsts(a, b)
        self.first, self.first_a, self.first_b = windows[fresh], a[fresh], b[fresh]

    def ask_windows(self) -> list[tuple[int | None, bytes]]:
        """The first windows to their buckets, and a note of all windows."""
        entry = np.empty(len(self.first), _ENTRY)
        entry["a"], entry["b"] = self.first_a, self.first_b
        entry["id"] = self.ids[self.doc[self.first]] if len(self.first) else 0
        marks = np.zeros(len(self.hashes), bool)
        marks[self.windows] = True
        return [(b, entry[at].tobytes()) for b, at in self._by_bucket(self.first_a)] + [(None, np.packbits(marks).tobytes())]

    def removed(self, known: pa.Table) -> np.ndarray:
        """For each word whether it is covered by a window that also starts earlier."""
        answers = by_bucket(known, _WINDOWS)
        self._take_windows(np.flatnonzero(np.unpackbits(np.frombuffer(answers[None], np.uint8), count=len(self.hashes))))
        keeps = np.zeros(len(self.first), bool)
        for b, at in self._by_bucket(self.first_a):
            keeps[at] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(at)).astype(bool)
        later = np.zeros(len(self.hashes), bool)
        later[self.windows] = True
        later[self.first[keeps]] = False
        at = np.flatnonzero(later)
        step = np.zeros(len(self.hashes) + 1, np.int64)
        step[at] += 1
        step[at + self.window] -= 1
        return np.cumsum(step)[:-1] > 0

    def _runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of marked words within a document: the first word, the one behind the last, and where each document's begin."""
        heads, tails = self.starts[:-1], self.starts[1:] - 1
        filled = tails >= heads
        begins, lasts = flags.copy(), flags.copy()
        begins[1:] &= ~flags[:-1]
        lasts[:-1] &= ~flags[1:]
        begins[heads[filled]], lasts[tails[filled]] = flags[heads[filled]], flags[tails[filled]]
        at = np.flatnonzero(begins)
        return at, np.flatnonzero(lasts) + 1, np.searchsorted(at, self.starts)

    def spans(self, gone: np.ndarray) -> pa.Array:
        """Spans (start, end) of the words of each document that go."""
        at, to, offsets = self._runs(gone)
        first = self.starts[self.doc[at]]
        fields = [pa.array((x - first).astype(np.int32)) for x in (at, to)]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end"]))

    def joined(self, gone: np.ndarray) -> pa.Array:
        """The words of each document that stay, joined by one space."""
        at, to, offsets = self._runs(~gone)
        base = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        at, to = ((x - base[self.doc[at]] - 1).tolist() for x in (self.at[at], self.to[to - 1]))
        lengths = np.concatenate([[0], np.cumsum(self.to - self.at + 1)])[self.starts]
        single = (self.sizes == np.diff(lengths) - 1).tolist()  # one blank between two words and no other
        starts, offsets = self.starts.tolist(), offsets.tolist()
        kept = []
        for k, text in enumerate(self.texts):
            if single[k]:
                text = text.translate(_SPACED)
                kept.append(b" ".join([text[at[r] : to[r]] for r in range(offsets[k], offsets[k + 1])]))
            else:
                kept.append(b" ".join(compress(text.split(), (~gone[starts[k] : starts[k + 1]]).tolist())))
        return pa.array(kept, pa.binary()).cast(pa.string())


_SPACED = bytes.maketrans(BLANKS.encode(), b" " * len(BLANKS))
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8")])


def _ends(payloads: list[bytes], size: int) -> np.ndarray:
    return np.cumsum([len(p) // size for p in payloads])


def _repeated(payloads: list[bytes], _: list[int]) -> list[bytes]:
    """Bits of the anchors that more than one block asks about."""
    many = _shared(np.frombuffer(b"".join(payloads), "<u8"))
    return [np.packbits(m).tobytes() for m in np.split(many, _ends(payloads, 8)[:-1])]


def _earliest(payloads: list[bytes], _: list[int]) -> list[bytes]:
    """Bits of the windows of which no earlier one is known: by id, then block, in whose order the payloads stand."""
    every = np.frombuffer(b"".join(payloads), _ENTRY)
    keeps = _firsts(*(np.ascontiguousarray(every[name]) for name in ("a", "b", "id")))
    return [np.packbits(k).tobytes() for k in np.split(keeps, _ends(payloads, _ENTRY.itemsize)[:-1])]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of words and without the white space behind each."""
    if not spans:
        return text
    starts = [m.start() for m in re.finditer(r"[^ \t-\r]+", text)] + [len(text)]
    cuts = [0, *[starts[w] for span in spans for w in span], len(text)]
    return "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def drop_repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, layout: bool = False, block_bytes: int = SPAN_BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept, doc``: what is left of whole texts, one row for each input row.

    Words are runs of characters other than [\\x20\\x09-\\x0D]. A word goes when a window of ``window`` (at least 14)
    words over it has the words of a window that starts earlier: in a document of smaller doc_id, or earlier in the
    same one. Windows are judged on the input. ``removed`` lists the spans (start, end) of words that go, ``kept`` is
    the words left, joined by one space, ``doc`` the input row without its text. With ``layout`` the text keeps its white
    space: a span that goes takes along what stands behind it, and a text without such spans stays as it is.

    doc_id is an integer; NULL comes before all. Rows with the same doc_id follow each other by their block (a hash of
    id and text), then by their text. NULL, empty and short texts have no window and lose nothing; other columns are
    carried inside ``doc`` and clash with nothing.

    Three passes over blocks that are shuffled once: which anchors stand elsewhere too; which of the windows around
    those is the earliest of its word sequence; and the cut. Within a block equal windows are one question, so text
    that is copied thousands of times, or repeats itself, asks once per block. The second pass leaves the third a note of
    its windows. Buckets are fewer than blocks, and sort what they are asked once for all blocks.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    dealt, n = in_blocks(docs, text, F.struct(*others).alias("doc"), block_bytes=block_bytes)
    buckets = -(-n // BLOCKS_A_BUCKET)
    slim = ["doc_id", "text"]

    def anchors(rows: pa.Table) -> list[tuple[int, bytes]]:
        return _Block(rows.select(slim), window, buckets).ask_anchors()

    def windows(rows: pa.Table, known: pa.Table) -> list[tuple[int | None, bytes]]:
        block = _Block(rows.select(slim), window, buckets)
        block.find_windows(known)
        return block.ask_windows()

    def cut(rows: pa.Table, known: pa.Table) -> pa.Table:
        block = _Block(rows.select(slim), window, buckets)
        gone = block.removed(known)
        rows = rows.take(pa.array(block.order, pa.int64()))
        spans = block.spans(gone)
        if layout:
            cuts = [[(x["start"], x["end"]) for x in found] for found in spans.to_pylist()]
            kept = pa.array(map(_without, rows["text"].to_pylist(), cuts), pa.string())
        else:
            kept = block.joined(gone)
        sums = np.concatenate([[0], np.cumsum(gone)])
        return pa.table(
            [
                rows["doc_id"].combine_chunks(),
                pa.array(np.diff(block.starts), pa.int64()),
                pa.array(np.diff(sums[block.starts]), pa.int64()),
                spans,
                kept,
                rows["doc"].combine_chunks(),
            ],
            names=["doc_id", "n_words", "n_removed", "removed", "kept", "doc"],
        )

    known = answered(asked(dealt, anchors), _ANCHORS, _repeated)
    first = answered(asked_again(dealt, known, windows), _WINDOWS, _earliest)
    added = "n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string"
    schema = T.StructType([dealt.schema["doc_id"], *T.StructType.fromDDL(added).fields, dealt.schema["doc"]])
    return finished(dealt, first, cut, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH base AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
    SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS later
    FROM (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g
          FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM base))
), gone AS (
    SELECT DISTINCT r, i + k AS i FROM windows, range(20) AS offsets(k) WHERE later
), words AS (
    SELECT r, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM base
), kept AS (
    SELECT r, count(*) AS n_words, count(gone.i) AS n_removed,
           string_agg(w, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t
    FROM words LEFT JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (r)
"""
