"""Vectorised word kernels over UTF-8 buffers.

Texts arrive as Arrow string arrays; words are found and hashed on the raw
bytes with numpy, so no Python string is made per word.  All separators of
both word classes are ASCII bytes, so byte positions never split a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def byte_class(separators) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for b in separators:
        table[b] = True
    return table


#: words ``[^\x20\x09-\x0D]+``
WHITESPACE = byte_class([0x20, *range(0x09, 0x0E)])
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z became a-z)
NON_ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

#: bytes that a word hash takes in at a time, and those from which a word is hashed by a library
LANE, LONG_WORD = 8, 4096
_lane_mask = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], dtype=U64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + U64(salt & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_length_salt = [mix(np.arange(LONG_WORD + 1, dtype=U64), 0x51ED270B * (which + 1)) for which in (0, 1)]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together (a longer text stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a run of texts, in order: byte spans, text index, place in its text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text: the index of its first word; one more at the end

    @property
    def place(self) -> np.ndarray:
        return np.arange(len(self.start)) - self.first[self.doc]

    def hashes(self, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (or of the words ``at``); ``which`` picks one of two independent ones.

        Words are taken in eight bytes at a time, each time mixed by a
        bijection that no polynomial describes, so texts made to collide under
        a sum of powers do not collide here.
        """
        start, size = (self.start, self.end - self.start) if at is None else (self.start[at], self.end[at] - self.start[at])
        if not len(start):
            return np.zeros(0, U64)
        padded = np.concatenate([self.data, np.zeros(LANE, np.uint8)])
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        salt = 0x2F7A9C35 * (which + 1)
        h = mix((lanes[start] & _lane_mask[np.minimum(size, LANE)]) ^ _length_salt[which][np.minimum(size, LONG_WORD)], salt)
        live, done = np.flatnonzero((size > LANE) & (size < LONG_WORD)), LANE
        while len(live):
            left = size[live] - done
            lane = lanes[start[live] + done] & _lane_mask[np.minimum(left, LANE)]
            h[live] = mix(h[live] ^ lane, salt)
            live, done = live[left > LANE], done + LANE
        for i in np.flatnonzero(size >= LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[start[i] : start[i] + size[i]], digest_size=LANE, salt=bytes([which]))
            h[i] = int.from_bytes(digest.digest(), "little")
        return h


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``fold`` lower-cases A-Z first."""
    n = len(data)
    if fold:
        data = _FOLD[data]
    inside = ~separators[data]
    begins = np.ones(n + 1, dtype=bool)
    begins[1:n] = ~inside[:-1] if n else False
    begins[offsets] = True
    start = np.flatnonzero(inside & begins[:n])
    ends = np.ones(n + 1, dtype=bool)
    ends[: n - 1] = ~inside[1:] if n > 1 else True
    ends[offsets[offsets > 0] - 1] = True
    end = np.flatnonzero(inside & ends[:n]) + 1
    first = np.searchsorted(start, offsets, side="left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def window_hashes(h: np.ndarray, width: int, salt: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes from each place, or from the places ``at`` (too short at the end: left out)."""
    n = len(h) - width + 1 if at is None else len(at)
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        weight = 0x2545F4914F6CDD1D + 2 * salt
        for k in range(width):
            out += (h[k : k + n] if at is None else h[at + k]) * U64(weight & 0xFFFFFFFFFFFFFFFF)
            weight = weight * 0x5851F42D4C957F2D + 0x14057B7EF767814E
            weight = (weight | 1) & 0xFFFFFFFFFFFFFFFF
    return mix(out, salt)


def window_starts(words: Words, width: int) -> np.ndarray:
    """Indices of words at which a window of ``width`` words of one text starts."""
    n = len(words.start) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[width - 1 : width - 1 + n])


def shingles(words: Words, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all ``width``-word shingles; a shorter text, if not empty, is one shingle."""
    h = words.hashes(which)
    at = window_starts(words, width)
    docs, out = words.doc[at], window_hashes(h, width, 7 + which)[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), U64)
        with np.errstate(over="ignore"):
            for k in range(width - 1):
                has = count[short] > k
                extra[has] = mix(extra[has] * U64(0x9FB21C651E98DF25) + h[words.first[short[has]] + k], k + 1)
        docs, out = np.concatenate([docs, short]), np.concatenate([out, extra])
    return docs, out
