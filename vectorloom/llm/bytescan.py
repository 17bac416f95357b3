"""Vectorised words and word-window hashes over the UTF-8 bytes of Arrow text columns.

Word separators are ASCII in every contract here, so a byte table finds words without
decoding. A word is two longs that are equal only for equal words: its bytes and their number
where it has up to 15, else a BLAKE2b digest of 120 bits. A 64-bit hash (``hashes``,
``windows``) is only ever used to route or to propose; what decides is compared on words
(``decontamination``), a 128-bit BLAKE2b digest of words (``digests``) or 128-bit fingerprints
mixed from the longs of each word (``fingerprints``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers, and the finalizer's constants.
GOLDEN, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Bytes and rows of text handled at once; one longer document is handled whole.
CHUNK, CHUNK_ROWS = 1 << 20, 4096
#: Bytes of a word that its two longs hold as they are.
PLAIN = 15


def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Everything but space, tab, LF, VT, FF and CR.
PRINT = _table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: ASCII digits and letters, and all beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z, every other byte to itself.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Masks of the first bytes of a little-endian long, by their number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > CHUNK:  # not kept for the sake of one very long document
            return made[0], made[1]
        _powers[base] = (made[0], made[1])
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(MIX[0])
    h ^= h >> U(33)
    h *= U(MIX[1])
    h ^= h >> U(33)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of value * base**i, from 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data bytes of a string column and its row offsets, from 0; nulls are empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of some documents: byte spans, and the range of words of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        n = len(data)
        self.data = LOWER[data] if lower else data
        is_word = table[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        before[cut] = False
        after[cut - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        bounds = np.searchsorted(self.start, offsets)
        self.first, self.last = bounds[:-1], bounds[1:]
        #: Words up to the end of its document, for each word.
        self.left = np.repeat(self.last, self.last - self.first) - np.arange(len(self.start))
        self.doc = np.repeat(np.arange(len(self.first)), self.last - self.first)

    def longs(self) -> tuple[np.ndarray, np.ndarray]:
        """Two longs of each word, equal only for equal words."""
        size = self.end - self.start
        at = np.ndarray(len(self.data) + 9, "<u8", np.concatenate([self.data, np.zeros(16, np.uint8)]), strides=(1,))
        low = at[self.start] & FIRST[np.minimum(size, 8)]
        high = at[self.start + 8] & FIRST[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(U) << U(56)
        for i in np.flatnonzero(size > PLAIN).tolist():
            d = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=16).digest()
            low[i] = int.from_bytes(d[:8], "little")
            high[i] = int.from_bytes(d[8:15], "little") | 0xFF << 56
        return low, high

    def hashes(self) -> np.ndarray:
        low, high = self.longs()
        return mix(low ^ mix(high ^ U(GOLDEN)))

    def digests(self, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """A 128-bit digest of the n words from each word ``first`` on."""
        size = (self.end - self.start).astype(np.uint32)
        at = np.cumsum(size, dtype=np.int64) - size
        own = np.zeros(len(self.data) + 1, np.int8)
        own[self.start] += 1
        np.subtract.at(own, self.end, 1)
        data, sizes = memoryview(self.data[np.cumsum(own[:-1], dtype=np.int8).view(bool)]), memoryview(size.view(np.uint8))
        last = first + n
        stop = np.append(at, len(data))[last]
        out = []
        for a, b, i, j in zip(at[first].tolist(), stop.tolist(), first.tolist(), last.tolist(), strict=True):
            h = hashlib.blake2b(data[a:b], digest_size=16)
            h.update(sizes[4 * i : 4 * j])
            out.append(h.digest())
        return out

    def fingerprints(self, n: int, longs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two longs for the n words from each word on; only those with ``left >= n`` lie in one document."""
        k = max(0, len(self.start) - n + 1)
        a, b = np.full(k, n, U), np.full(k, GOLDEN, U)
        for j in range(n):
            low, high = (x[j : j + k] for x in longs)
            a, b = mix(a + low * U(WORD_BASE) ^ b), mix(b + high * U(GOLDEN) ^ low) ^ a
        return a, b

    def windows(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """The hash of the n words from each word on; only those with ``left >= n`` lie in one document."""
        k = len(hashes) - n + 1
        if k <= 0:
            return np.zeros(0, U)
        total = prefix(hashes, WORD_BASE)
        return mix((total[n:] - total[:-n]) * powers(WORD_BASE, len(hashes) + 1)[1][:k] + U(n))


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about CHUNK bytes and CHUNK_ROWS rows at most: first row, row past the last, bytes, offsets."""
    data, offsets = column_bytes(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, min(lo + CHUNK_ROWS, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size = 1
    while 2 * size <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if size < w else a
