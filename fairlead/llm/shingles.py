"""Sets of hashed word shingles, computed from the bytes of whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
_rng = np.random.default_rng(20240229)
#: A random value for each byte, A-Z as a-z; random odd factors for the words of a shingle.
VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUES[65:91] = VALUES[97:123]
FACTORS = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once, so that what is computed stays in the processor's cache, and powers up to there.
BLOCK = 1 << 18
UP, DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64)])) for b in (BASE, BASE_INVERSE))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased A-Z), and the offsets of the rows' words. A word's hash is the difference of two
    running sums over its bytes, so that no step depends on where words are."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = inside[begin]
    last[begin[1:] - 1] = inside[begin[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(starts), np.uint64)
    for at in range(0, size, BLOCK):
        end = min(at + BLOCK, size)
        total = np.zeros(end - at + 1, np.uint64)
        np.cumsum(VALUES[data[at:end]] * UP[: end - at], out=total[1:])
        here = slice(np.searchsorted(ends, at, side="right"), np.searchsorted(starts, end))
        a, b = starts[here], np.minimum(ends[here], end) - at
        from_ = np.maximum(a, at) - at
        part = (total[b] - total[from_]) * DOWN[from_]
        if len(a) and a[0] < at:  # goes on from the block before
            part[:1] *= np.uint64(pow(int(BASE), int(at - a[0]), 1 << 64))
        sums[here] += part
    return mix(sums), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and the offsets of the rows in them. Fewer words than
    WIDTH make one shingle of all of them; no word, none."""
    words, at = words_of(data, offsets)
    counts = np.diff(at)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    size = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], size)
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    found = np.zeros(to[-1], np.uint64)
    for k in range(WIDTH):
        found += padded[places + k] * FACTORS[k]
    for row in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        n = counts[row]
        found[to[row]] = (words[at[row]:at[row + 1]] * FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)
    found = mix(found)
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        found[a:b].sort()
    keep = np.ones(len(found), bool)
    keep[1:] = found[1:] != found[:-1]
    keep[to[:-1][size > 0]] = True
    return found[keep], np.concatenate([[0], np.cumsum(keep)])[to]


def runs(offsets: np.ndarray, most: int = BLOCK):
    """Ranges of rows of about `most` bytes, so that what is computed at once stays in the processor's cache."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def sets_of(column: pa.Array):
    """For each run of rows: the first row, distinct shingles and offsets."""
    data, offsets = bytes_of(column)
    for a, b in runs(offsets):
        yield a, *shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
