"""One pass of a finite-state transducer over UTF-8 bytes: counts, and word spans that go into a verified hash table.

The automaton has two states, between words and inside a word. A byte belongs to one of five classes; a table gives the
next state and what the step emits for every state and class. As the next state follows from the class alone, all steps
of a slice of texts are looked up at once. Spans are hashed eight bytes at a time and inserted into an open table, all
words of a slice together; where hashes are equal, the bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")

#: Bytes of text in a slice: its hash table stays in the cache of a core.
SLICE = 1 << 20
#: Words of more bytes are hashed and compared one by one.
SHORT = 64

# Classes of bytes, in the order of the columns of the tables.
BLANK, CAPITAL, SYMBOL, FOLLOWING, OTHER = range(5)
# What a step emits, as bits.
BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL, FOLLOWS = 1, 2, 4, 8, 16

# White space, capitals, symbols, and the bytes after the first of a UTF-8 character.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[[ord(c) for c in "#$%&*|"]] = SYMBOL
CLASS[0x80:0xC0] = FOLLOWING

#: The state after a byte of each class: 0 between words, 1 inside a word.
NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
#: What a byte of each class emits, by state.
EMIT = np.array(
    [
        [0, BEGINS | IS_CAPITAL, BEGINS | IS_SYMBOL, BEGINS | FOLLOWS, BEGINS],
        [ENDS, IS_CAPITAL, IS_SYMBOL, FOLLOWS, 0],
    ],
    np.uint8,
)
_CLASSES = EMIT.shape[1]
_STEP = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _by_text(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending places lie in each text."""
    return np.diff(np.searchsorted(places, offsets))


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte emits, and starts and ends of the words. A text begins between words and ends its last word."""
    classes = table[data]
    after = NEXT[classes]
    state = np.empty(len(data), np.uint8)
    state[1:] = after[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    state[first] = 0
    emitted = EMIT.ravel()[state * np.uint8(_CLASSES) + classes]
    starts = np.flatnonzero(emitted & BEGINS)
    inside = offsets[1:][offsets[:-1] < offsets[1:]]
    open_ends = inside[after[inside - 1] == 1]
    return emitted, starts, np.sort(np.concatenate([np.flatnonzero(emitted & ENDS), open_ends]))


class Words:
    """The words of a slice of texts, and a hash table of the distinct ones of each text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray):
        self.raw, self.starts, self.sizes, self.text = data, starts, ends - starts, text
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        #: The eight bytes from each place on, as one number.
        self.lanes = np.ndarray(len(data), np.dtype("<u8"), padded, strides=(1,))
        self.hashes = self._hashes()

    def _lane(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of words that have byte 8k; zeros behind their end."""
        left = np.minimum(self.sizes[words] - 8 * k, 8)
        return self.lanes[self.starts[words] + 8 * k] & _KEEP[left]

    def _bytes(self, word: int) -> bytes:
        return self.raw[self.starts[word] : self.starts[word] + self.sizes[word]].tobytes()

    def _hashes(self) -> np.ndarray:
        h = (self.text + 1).astype(np.uint64) * _STEP[0] ^ self.sizes.astype(np.uint64) * _STEP[1]
        short = self.sizes <= SHORT
        words = np.flatnonzero(short)
        for k in range(SHORT // 8):
            words = words[self.sizes[words] > 8 * k]
            if not len(words):
                break
            mixed = (h[words] ^ self._lane(words, k)) * _STEP[2]
            h[words] = mixed ^ mixed >> np.uint64(29)
        for w in np.flatnonzero(~short):
            h[w] ^= np.uint64(xxhash.xxh3_64_intdigest(self._bytes(w)))
        return h ^ h >> np.uint64(32)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words are the same word of the same text, by their bytes."""
        same = (self.hashes[a] == self.hashes[b]) & (self.text[a] == self.text[b]) & (self.sizes[a] == self.sizes[b])
        short = self.sizes[a] <= SHORT
        at = np.flatnonzero(same & short)
        for k in range(SHORT // 8):
            at = at[self.sizes[a[at]] > 8 * k]
            if not len(at):
                break
            equal = self._lane(a[at], k) == self._lane(b[at], k)
            same[at[~equal]] = False
            at = at[equal]
        for i in np.flatnonzero(same & ~short):
            same[i] = self._bytes(a[i]) == self._bytes(b[i])
        return same

    def distinct(self, n_texts: int) -> np.ndarray:
        """Distinct words of each text. Words try a slot each; those that meet another word go on to the next slot."""
        size = 1 << max(4, int(2 * len(self.starts)).bit_length())
        slots = np.full(size, -1, np.int64)
        place = (self.hashes & np.uint64(size - 1)).astype(np.int64)
        out, words = np.zeros(n_texts, np.int64), np.arange(len(self.starts))
        while len(words):
            at = place[words]
            free = slots[at] < 0
            slots[at[free]] = words[free]  # of several words one stays
            held = slots[at]
            new = held == words
            out += np.bincount(self.text[words[new]], minlength=n_texts)
            words, held = words[~new], held[~new]
            words = words[~self._same(words, held)]
            place[words] = place[words] + 1 & size - 1
        return out


def measured(texts: pa.Array) -> list[np.ndarray]:
    """The measures of each text of an array without NULLs, in the order of MEASURES."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if offsets[0] == offsets[-1]:
        return [np.zeros(n, np.int64) for _ in MEASURES]
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    emitted, starts, ends = spans(data, offsets)
    found = {bit: _by_text(np.flatnonzero(emitted & bit), offsets) for bit in (IS_CAPITAL, IS_SYMBOL, FOLLOWS)}
    words = _by_text(starts, offsets)
    distinct = Words(data, starts, ends, np.repeat(np.arange(n), words)).distinct(n)
    return [words, distinct, found[IS_CAPITAL], np.diff(offsets) - found[FOLLOWS], found[IS_SYMBOL]]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def measures(docs: DataFrame, text: str, *others: Column) -> DataFrame:
    """``others`` and the measures of whole texts (long): words, distinct words, capitals A to Z, code points, symbols.

    Words are maximal runs of anything but white space. NULL is the empty text, whose measures are 0; repeated rows
    are measured each; an empty table gives no rows. Long texts are slices of their own and take memory in proportion.
    """
    given = docs.select(*others, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(text))
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch[text].cast(pa.large_string())):
                rest = [batch[c].slice(done, len(part)) for c in names]
                done += len(part)
                yield pa.record_batch([*rest, *map(pa.array, measured(part))], names=[*names, *MEASURES])

    added = [T.StructField(m, T.LongType()) for m in MEASURES]
    return given.mapInArrow(run, T.StructType([*given.schema[:-1], *added]))
