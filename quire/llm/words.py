"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.  All
work is done on the column's byte buffer, so no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators under which only ASCII letters, digits and bytes of other scripts make words.
PLAIN = np.ones(256, bool)
PLAIN[128:] = False
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Bytes hashed together; a longer text is a piece of its own.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("p", _P), ("i", _INV)):
            out = np.ones(size, U64)
            out[1:] = U64(base)
            _powers[key] = np.multiply.accumulate(out)
    return _powers["p"], _powers["i"]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows of about ``most`` bytes; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def hashed(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """(hash of each word, first byte, end byte, index of each row's first word and the end).

    For each length in ``heads`` there follows the hash of each word's first bytes, 0 for a word not longer.
    """
    solid = ~separators[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64), *[np.zeros(0, U64)] * len(heads)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    value = (total[end] - total[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    out = [mix(value), start, end, np.searchsorted(start, offsets)]
    for size in heads:
        stop = np.minimum(start + size, end)
        head = mix((total[stop] - total[start]) * inverse[start] + U64(size * 0xA0761D6478BD642F % (1 << 64)))
        out.append(np.where(end - start > size, head, U64(0)))
    return tuple(out)


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each row's range; a row of 1 to k-1 words has its sequence as one."""
    count = np.diff(rows)
    each = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate([[0], np.cumsum(each)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, U64), bounds
    at = np.arange(total) - np.repeat(bounds[:-1], each) + np.repeat(rows[:-1], each)
    left = np.repeat(np.minimum(count, k), each)
    padded = np.concatenate([words, np.zeros(k, U64)])
    out = left.astype(U64)
    for j in range(k):
        part = padded[at + j]
        if (left <= j).any():
            part = np.where(left > j, part, U64(0))
        out = mix(out * U64(0x9FB21C651E98DF25) + part)
    return out, bounds


class Index:
    """Places of sorted 64-bit hashes, by linear probing in a table of at most half load."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = U64(64 - bits)
        home = (keys >> self.shift).astype(np.int64)
        at = np.arange(len(keys))
        slot = at + np.maximum.accumulate(home - at) if len(keys) else at
        self.table = np.full((1 << bits) + len(keys) + 1, -1, np.int32)
        self.table[slot] = at

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.table[slot]
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(open_):
            slot[open_] += 1
            now = self.table[slot[open_]]
            out[open_] = now
            open_ = open_[(now >= 0) & (self.keys[now] != hashes[open_])]
        return out


class Tally:
    """Counts per 64-bit key, merged whenever many have come together."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.held, self.parts = most, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        found, back = np.unique(keys, return_inverse=True) if counts is not None else (None, None)
        if counts is None:
            found, total = np.unique(keys, return_counts=True)
        else:
            total = np.bincount(back, weights=counts, minlength=len(found)).astype(np.int64)
        self.parts.append((found, total))
        self.held += len(found)

    def full(self) -> bool:
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All that was added since the last call."""
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        keys, counts = np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        self.parts, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts
