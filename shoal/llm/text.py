"""Byte-level text kernels shared by the operators: words, lines and polynomial hashes of whole Arrow slices.

A slice holds some whole rows of a text column as one byte buffer, so that numpy works on a few megabytes at a time whatever
the length of single texts. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is also right for UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))


PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _32, _29, _61, _1 = (np.uint64(k) for k in (30, 31, 32, 29, 61, 1))


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo PRIME."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it, by halves of 31 and 30 bits; no step passes 64 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a0 * b1 + a1 * b0
    return reduced(((a1 * b1) << _1) + (mid >> _30) + ((mid & _LOW30) << _31) + a0 * b0)


class Polynomial:
    """Hashes of any substring from prefix sums: sum of T[byte] * B**i modulo the prime 2**61 - 1, shifted back to the start by B**-i.

    T is a table of pseudo-random values and B a pseudo-random base, so two different strings of n bytes agree for n bases of 2**61 at most
    (a power of two as modulus has strings that agree for every base). Instances with different seeds are independent.
    """

    def __init__(self, seed: int, fold_case: bool = False):
        self.table = reduced(constants(seed, 256))
        if fold_case:
            self.table[0x41:0x5B] = self.table[0x61:0x7B]
        self.base = int(constants(seed + 1000, 1)[0]) % (PRIME - 2) + 2
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, times(self.up, np.uint64(pow(self.base, k, PRIME)))])
            self.down = np.concatenate([self.down, times(self.down, np.uint64(pow(self.base, -k, PRIME)))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums; those of the upper and of the lower 32 bits are made apart, as neither passes 64 bits."""
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        terms = times(self.table[data], self.up[: len(data)])
        high = np.cumsum(terms >> _32, dtype=np.uint64)
        out[1:] = reduced((((high << _32) & _P) | (high >> _29)) + reduced(np.cumsum(terms & np.uint64(0xFFFFFFFF), dtype=np.uint64)))
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(reduced(prefix[end] + (_P - prefix[start])), self.down[start])


class WindowKeys:
    """Keys of all substrings of one width, quicker than Polynomial: sums modulo 2**64. Equal substrings have equal keys; the reverse does not
    hold for texts made for it, so they serve to group what is compared otherwise."""

    def __init__(self, seed: int):
        self.table = constants(seed, 256)
        self.base = int(constants(seed + 1000, 1)[0]) | 1
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, data: np.ndarray, width: int) -> np.ndarray:
        while len(self.up) < len(data):
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.base, -k, 1 << 64))])
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=prefix[1:])
        n = len(data) - width + 1
        return mix((prefix[width:] - prefix[:n]) * self.down[:n])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of spans of 8 bytes or more, read as words of 8 from their start (the last one from their end): sums of mixed values of
    each word and its place, so different spans have equal sums only by chance."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = (ends - starts + 7) >> 3
    before = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(before, n)
    at = np.minimum(np.repeat(starts, n) + (place << 3), np.repeat(ends, n) - 8)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return np.add.reduceat(mix(eight[at] ^ constants(seed, int(n.max()))[place]), before)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about `limit` bytes; null texts count as empty."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that are not in `space`), and for each row the index of its first word (one more entry
    than rows)."""
    word = ~space[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = offs[1:-1]
    cut = cut[cut < len(data)]
    start[cut] |= word[cut]
    cut = cut[cut > 0]
    end[cut - 1] |= word[cut - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, fold_case: bool = False) -> np.ndarray:
    """64-bit hashes of words: sums of a pseudo-random value for each place in the word and byte there, so different words have equal sums
    only by chance, whatever their pattern. A word hashes alike wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.arange(256, dtype=np.uint64)
    if fold_case:
        low[0x41:0x5B] += np.uint64(0x20)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    values = mix((place.astype(np.uint64) << np.uint64(8) | low[data[starts[0] :]]) * _ODD + constants(seed, 1))
    sums = np.zeros(len(data) - starts[0] + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[ends - starts[0]] - sums[starts - starts[0]]


def shingles(word_hashes: np.ndarray, first: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, and the index of each row's first. With `whole`, a row of fewer words
    (one at least) has its whole sequence as its only shingle."""
    n = np.diff(first)
    many = np.maximum(n - k + 1, 0)
    c = constants(77, k)
    rolled = np.zeros(max(len(word_hashes) - k + 1, 0), np.uint64)
    for i in range(k if len(rolled) else 0):
        rolled += word_hashes[i : i + len(rolled)] * c[i]
    rows = np.repeat(np.arange(len(n)), many)
    at = first[:-1][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    out = mix(rolled[at])
    if whole and ((few := (n > 0) & (n < k)).any()):
        short = np.flatnonzero(few)
        own = np.array([mix(np.array([(word_hashes[first[r] : first[r + 1]] * c[: n[r]]).sum(dtype=np.uint64) + np.uint64(n[r])], np.uint64))[0] for r in short], np.uint64)
        place = np.searchsorted(rows, short)
        out, many = np.insert(out, place, own), many + few
    return out, np.concatenate([[0], np.cumsum(many)])


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)
