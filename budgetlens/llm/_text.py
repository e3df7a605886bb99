"""Vectorised text primitives shared by the operators of this subpackage.

Every helper works on the UTF-8 bytes of an Arrow string column, a few megabytes at a time, so that a worker's
memory depends on the largest single text and not on the number of rows in a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: White space of the contracts: space and the controls 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (a, b) whose texts hold at most ``most`` bytes together, or a single row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lowered, other bytes as they are."""
    return _LOWER[buf]


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    base = 0x5851F42D4C957F2D | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up = np.full(n, self.base, np.uint64)
            down = np.full(n, pow(self.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * power, from which hash_spans() takes the hash of any span."""
    up, _ = POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans [start, end) of the sequence that prefix() was given."""
    _, down = POWERS.upto(len(sums) + 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts buf[off[i]:off[i + 1]], and first word of each text (len(off) entries)."""
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = ~_SPACE[buf]
    start = np.flatnonzero(solid[1:-1] & ~solid[:-2])
    end = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    # a word that runs over the edge between two texts is two words
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    cut = np.unique(inner[solid[inner] & solid[inner + 1]])
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, off, side="left")


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and first word of each text."""
    start, end, first = words(buf, off)
    return hash_spans(prefix(buf), start, end), first


def shingle_runs(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` items (whole shorter sequences as one), and first run of each text."""
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    start = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    end = np.minimum(start + size, np.repeat(first[1:], runs))
    return hash_spans(prefix(h), start, end), at


def characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 texts (its bytes, packed), and first character of each text."""
    begins = (buf & 0xC0) != 0x80
    if begins.all():
        return buf.astype(np.uint64), off
    begins[off[:-1][off[:-1] < len(buf)]] = True
    starts = np.flatnonzero(begins)
    size = np.diff(np.append(starts, len(buf)))
    codes = buf[starts].astype(np.uint64)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        codes[more] |= buf[starts[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return codes, np.searchsorted(starts, off)


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of x[i : i + size] for each i, by doubling."""
    out, done, span, factor = None, 0, 1, int(_M1)
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        power = np.uint64(pow(factor, span, 1 << 64))
        if size & span:
            out = x[:n].copy() if out is None else out * power + x[done : done + n]
            done += span
        if done == size:
            # minima() takes the upper half, which this mixes enough
            out += np.uint64(size * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
            out ^= out >> np.uint64(32)
            out *= _M2
            return out
        x = x[:-span] * power + x[span:]
        span *= 2


def character_runs(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` characters (whole shorter texts as one), and first run of each text."""
    codes, first = characters(buf, off)
    count = np.diff(first)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    codes = (codes + np.uint64(1)) * _ODD
    whole = np.append(windows(codes, size), np.zeros(min(size - 1, len(codes)), np.uint64))
    keep = np.ones(len(codes), bool)
    for k in range(1, size):
        tail = first[1:] - k
        keep[tail[tail >= first[:-1]]] = False
    for i in np.flatnonzero((count > 0) & (count < size)):
        whole[first[i]] = windows(codes[first[i] : first[i + 1]], int(count[i]))[0]
        keep[first[i]] = True
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    return whole[keep], at


def sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group, sorted as unsigned numbers, and first value of each group."""
    out = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][at[:-1] < len(out)]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return out[new], kept[at]


#: Values that minima() takes at a time, so that they stay in a core's cache.
_BLOCK = 1 << 15


def minima(values: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """uint32 MinHash signatures, a row for each group; groups without values get the largest number.

    The values are well mixed already, so each hash function is a multiplication by an odd number.
    """
    low = (values >> np.uint64(32)).astype(np.uint32)  # what the values' hashes mix best
    odd = [np.uint32(int(s) >> 16 & 0xFFFFFFFF | 1) for s in seeds]
    out = np.full((len(at) - 1, len(odd)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    starts, ends = at[full], at[full + 1]
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        part, inner = low[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        x = np.empty_like(part)
        rows = np.empty((len(odd), j - i), np.uint32)
        for k, m in enumerate(odd):
            np.multiply(part, m, out=x)
            np.minimum.reduceat(x, inner, out=rows[k])
        out[full[i:j]] = rows.T
        i = j
    return out


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(salt))
