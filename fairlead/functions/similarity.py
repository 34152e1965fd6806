"""String similarity: built-in edit distance as a lossless pre-filter, exact ratios in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character of b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def _kept(masks: list[int], full: int) -> Iterator[int]:
    """Length of the longest common subsequence after each character; masks tell where a character stands in the other
    text."""
    row, n = full, full.bit_count()
    for m in masks:
        hit = row & m
        row = ((row + hit) | (row - hit)) & full
        yield n - row.bit_count()


def window_lcs(masks: list[int], full: int) -> int:
    row = full
    for m in masks:
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return full.bit_count() - row.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against every window of its length in the longer one, and its shorter ends.

    From one window to the next the common subsequence grows by one at most, so that windows which can't be better than
    the best one are passed over."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long_ else 0.0
    n, full = len(short), (1 << len(short)) - 1
    where: dict[str, int] = {}
    back: dict[str, int] = {}
    for i, ch in enumerate(short):
        where[ch] = where.get(ch, 0) | (1 << i)
        back[ch] = back.get(ch, 0) | (1 << (n - 1 - i))
    masks = [where.get(ch, 0) for ch in long_]
    best, i = 0, 0
    while i <= len(long_) - n and best < n:
        found = window_lcs(masks[i:i + n], full)
        i += max(1, best - found + 1)
        best = max(best, found)
    ends = [_kept(masks[:n - 1], full), _kept([back.get(ch, 0) for ch in long_[:-n:-1]], full)]
    return max(200.0 * best / (2 * n), *(200.0 * found / (n + k) for end in ends for k, found in enumerate(end, 1)), 0.0)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Percentage of characters two texts share in order."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)])


def may_reach(a: Column, b: Column, percent: float) -> Column:
    """False only where the ratio is surely below the percentage.

    Removing and adding characters is never cheaper than editing them, so edit distance bounds the ratio.
    """
    room = F.floor((F.length(a) + F.length(b)) * (1 - percent / 100.0) + 1e-9).cast("int")
    near = F.abs(F.length(a) - F.length(b)) <= room
    return F.when(near, F.call_function("levenshtein", a, b, room) >= 0).otherwise(False)
