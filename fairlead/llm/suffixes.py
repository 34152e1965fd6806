"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, on arrays instead of single positions."""

from __future__ import annotations

import numpy as np

#: Positions take so many bits of a 63-bit sort key: the longest string is 2**21 - 1.
PLACE = 21


def packed(symbols: np.ndarray, most_bits: int) -> tuple[np.ndarray, int, int]:
    """For each position, as many of the next symbols as fit most_bits, the first one highest; their number, and the bits
    of one. Symbols are dense from 0; behind the end stand zeros."""
    width = max(1, int(symbols.max(initial=0)).bit_length())
    many = max(1, most_bits // width)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(many, np.int64)])
    out = np.zeros(len(symbols), np.int64)
    for k in range(many):
        out = (out << width) | padded[k:k + len(symbols)]
    return out, many, width


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; a suffix that begins another comes before it. Symbols are dense from 1.

    Suffixes are first sorted by what fits a key. As long as some are equal in their first h symbols, each such group is
    sorted by the ranks h further on, which doubles h; groups of one are never touched again. A rank is the place of its
    group's last member. Group, rank and position are one whole number, so that a plain sort does it."""
    n = len(symbols)
    if n >= 1 << PLACE:
        raise ValueError("too long for one array")
    first, h, _ = packed(symbols, 63 - PLACE)
    mask = (1 << PLACE) - 1
    keys = np.sort((first << PLACE) | np.arange(n))
    order = keys & mask
    groups = keys >> PLACE
    last = np.ones(n, bool)
    last[:-1] = groups[1:] != groups[:-1]
    rank = np.zeros(n + 1, np.int64)  # behind the end lies what is less than all
    ends = np.flatnonzero(last)
    rank[order] = ends[np.searchsorted(ends, np.arange(n))] + 1
    single = last & np.concatenate([[True], last[:-1]])
    open_ = np.flatnonzero(~single)
    while len(open_):
        here = order[open_]
        keys = np.sort((((rank[here] << PLACE) | rank[np.minimum(here + h, n)]) << PLACE) | here)
        here = keys & mask
        order[open_] = here
        groups = keys >> PLACE
        last = np.ones(len(open_), bool)
        last[:-1] = groups[1:] != groups[:-1]
        ends = np.flatnonzero(last)
        rank[here] = open_[ends[np.searchsorted(ends, np.arange(len(open_)))]] + 1
        open_ = open_[~(last & np.concatenate([[True], last[:-1]]))]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """For each place of the suffix array the length, up to `most`, that its suffix shares with the one before.

    By Kasai: from one text position to the next, this length falls by one at most, so that what is known need not be
    compared again. Positions are walked in lanes of equal length side by side; only a lane's first starts from nothing."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words, many, width = packed(symbols, 62)
    words = np.concatenate([words, np.full(most + many + 1, -1, np.int64)])
    shared = np.zeros(n, np.int32)
    length = np.zeros(-(-n // lane), np.int64)
    starts = np.arange(len(length)) * lane
    for step in range(lane):
        at = starts + step
        if at[-1] >= n:
            at = at[:-1]
        to = before[at]
        length = np.where(to < 0, 0, np.maximum(length[: len(at)] - 1, 0))
        going = np.flatnonzero((to >= 0) & (length < most))
        while len(going):
            a, b = words[at[going] + length[going]], words[to[going] + length[going]]
            same = a == b
            length[going[same]] += many
            rest = going[~same]
            differ = (a ^ b)[~same] & ((1 << 62) - 1)
            for k in range(1, many):
                length[rest] += (differ >> (width * (many - k))) == 0
            going = going[same]
            going = going[length[going] < most]
        length = np.minimum(length, np.minimum(most, n - np.maximum(at, to)))
        shared[at] = length
    return shared[order]
