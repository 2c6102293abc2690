"""Array helpers for Arrow batches of texts: views of the bytes, rolling hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PRIME = (1 << 31) - 1
BASES = (1_315_423_911, 1_908_874_353)
SEGMENT = 1 << 20  # bytes worked on at a time; arrays of eight bytes each per text byte


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    a = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("" if pa.types.is_large_string(a.type) else b"")
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def segments(offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes together; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _reduce(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place, for x below 2**63."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        np.right_shift(x, bits, out=spare)
        x &= prime
        x += spare
    # Below PRIME the difference wraps around and is the larger one.
    np.subtract(x, prime, out=spare)
    return np.minimum(x, spare, out=x)


def _blocks(n: int) -> Iterator[slice]:
    """Ranges whose arrays stay in a core's cache."""
    for lo in range(0, n, 1 << 14):
        yield slice(lo, min(n, lo + (1 << 14)))


@lru_cache(2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers 0 to n - 1 of each base and of its inverse; n is a power of two."""
    def ladder(b: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        k = 1
        while k < n:
            out[k:2 * k] = out[:k] * np.uint64(pow(b, k, PRIME))
            _reduce(out[k:2 * k], np.empty(k, np.uint64))
            k *= 2
        return out.astype(np.uint32)
    return [(ladder(b), ladder(pow(b, -1, PRIME))) for b in BASES]


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    size = 1 << max(21, int(n + 1).bit_length())
    return [(up[:n + 1], down[:n + 1]) for up, down in _powers(size)]


@lru_cache(4)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, PRIME, (len(BASES), 256), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Hasher:
    """Hash of any slice of some bytes in constant time: two polynomials modulo a prime, 62 bits.

    A prime modulus matters: modulo 2**64 texts exist that collide for every odd base
    (a Thue-Morse word and its complement).
    """

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        self.size, self.parts = n, []
        for values, (up, down) in zip(byte_values(seed), powers(n)):
            sums = np.zeros(n + 1, np.uint32)
            before = np.uint64(0)
            for at in _blocks(n):
                # Terms are below 2**62 and reduced before they are added up.
                x = values[data[at]]
                x *= up[at]
                spare = np.empty_like(x)
                _reduce(x, spare)
                x[0] += before
                np.cumsum(x, out=x)
                _reduce(x, spare)
                sums[at.start + 1:at.stop + 1] = x
                before = x[-1]
            self.parts.append((sums, down))

    def _between(self, start: np.ndarray, end: np.ndarray, scale) -> np.ndarray:
        """Codes of slices from sums before their starts and ends, and powers at their starts."""
        code = np.zeros(0, np.uint64)
        for (sums, down), first in zip(self.parts, (True, False)):
            x = sums[end].astype(np.uint64)
            x += np.uint64(PRIME)
            x -= sums[start]
            x *= down[scale]
            x = _reduce(x, np.empty_like(x))
            code = x if first else (code << np.uint64(31)) | x
        return code

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end]; slices of different length differ by it."""
        raw = self._between(start, end, start)
        return mixed(raw + (np.asarray(end) - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def grams(self, k: int) -> np.ndarray:
        """Mixed hashes of data[i:i+k] for every i."""
        n = self.size + 1 - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for at in _blocks(n):
            out[at] = mixed(self._between(at, slice(at.start + k, at.stop + k), at))
        return out


def distinct_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(first, back): where each different slice comes first, and which of these each slice is.

    Hashes group the slices and their bytes settle it: a slice that differs from the first
    of its group is told apart by its bytes.
    """
    _, first, back = np.unique(Hasher(data, seed).slices(start, end), return_index=True, return_inverse=True)
    size = end - start
    like = first[back]
    same = size == size[like]
    which = np.flatnonzero(same & (like != np.arange(len(like))))
    n = size[which]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = data[np.repeat(start[which], n) + step] != data[np.repeat(start[like[which]], n) + step]
    same[which[np.unique(np.repeat(np.arange(len(which)), n)[differ])]] = False
    extra: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(~same).tolist():
        raw = data[start[i]:end[i]].tobytes()
        if raw not in extra:
            extra[raw] = len(first) + len(more)
            more.append(i)
        back[i] = extra[raw]
    return np.append(first, more).astype(np.int64), back


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i:i+w])."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[:len(x) - (w - span)], x[w - span:])
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words between ASCII white space, in order; rows are apart."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # A row's end parts words too.
    heads = offsets[1:-1]
    heads = heads[(heads > 0) & (heads < n)]
    first[heads] = inside[heads]
    last[heads - 1] = inside[heads - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
