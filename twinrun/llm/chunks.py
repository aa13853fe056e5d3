"""Texts cut at spaces into chunks whose token ids can be looked up one by one.

The pre-token pattern of the byte-level vocabularies never lets a match hold a space behind another character, so each
space that follows a character other than white space begins a new match, whatever stands around it. Cutting there and
tokenising the chunks gives the tokens of the whole text. Texts with white space before a space go the long way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time, entries of a memo, and characters of a chunk worth keeping in it.
SLICE_BYTES = 8 << 20
MEMO_SIZE = 300_000
MEMO_KEY = 64

# Characters that any library involved treats as white space.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_AFTER_WHITE = _WHITE + " "


class Memo(dict):
    """Answers of a function by short strings. When ``size`` are kept it starts anew, so memory stays bounded."""

    def __init__(self, make: Callable[[str], object], size: int = MEMO_SIZE):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= MEMO_KEY:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in pieces of about SLICE_BYTES; NULLs as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def ids_by_chunk(texts: pa.Array, ids_of: Memo, whole: Callable[[str], bytes]) -> list[bytes]:
    """Packed ids of each text of one slice: ``ids_of[chunk]`` for texts that can be cut, ``whole(text)`` for the others."""
    odd = pc.match_substring_regex(texts, SPACE_AFTER_WHITE)
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).tolist()
    ends = lists.offsets.to_numpy().tolist()
    ids = [ids_of[" " + w] for w in words]
    out = []
    for row, long_way in enumerate(odd.to_pylist()):
        if long_way:
            out.append(whole(texts[row].as_py()))
            continue
        a, b = ends[row], ends[row + 1]
        first = words[index[a]] if b > a else ""
        head = ids_of[first] if first else b""
        out.append(head + b"".join(map(ids.__getitem__, index[a + 1 : b])))
    return out


def packed(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()
