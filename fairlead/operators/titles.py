"""Similarity join of titles, and who comes first among similar rows of one batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.similarity import may_reach, ratio
from fairlead.session import cut_lineage

#: Characters counted one by one, eight to a word; all others count together in the last place. Digits are among them, as
#: numbers and keys in titles differ by nothing else.
COUNTED = " etaoinsrhldcumpfgbywvk0" "123456789jqxz.-"
PLACES = len(COUNTED) + 1
#: Eight bits for a count modulo 16: neighbouring counts differ in one bit (a ring of 16 codes).
RING = [(1 << i) - 1 for i in range(9)] + [255 - ((1 << i) - 1) for i in range(1, 8)]
#: From so many characters on, neighbouring pairs of them are counted too, by so many places of a hash.
LONG, PAIRED = 128, 256
#: Titles of a block; two blocks make a tile, whose pairs are looked at in runs of so many.
BLOCK, RUN = 4096, 1 << 16


def _numbered(titles: DataFrame) -> DataFrame:
    """Distinct titles (t) with an id; the ids are fixed by the checkpoint."""
    found = titles.filter(F.col("t").isNotNull()).select("t").distinct()
    return cut_lineage(found.withColumn("tid", F.monotonically_increasing_id())).withColumn("n", F.length("t"))


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all characters, and the title each is in."""
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.repeat(np.arange(len(titles)), [len(t) for t in titles])


def _counts(titles: list[str]) -> np.ndarray:
    """How often each title has the characters of COUNTED, and all others together."""
    place = np.full(128, PLACES - 1)
    place[[ord(c) for c in COUNTED]] = range(PLACES - 1)
    codes, row = _codes(titles)
    at = np.where(codes < 128, place[np.minimum(codes, 127)], PLACES - 1)
    return np.bincount(row * PLACES + at, minlength=PLACES * len(titles)).reshape(-1, PLACES)


def _paired(titles: list[str]) -> np.ndarray:
    """How often each title has the neighbouring pairs of characters of each place of a hash, at most 255 times. A character
    taken out changes three of these counts by one at most."""
    codes, row = _codes(titles)
    mixed = codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    at = (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(int) % PAIRED
    inside = row[:-1] == row[1:]
    counts = np.bincount(row[:-1][inside] * PAIRED + at[inside], minlength=PAIRED * len(titles))
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, PAIRED)


def _counted(titles: DataFrame) -> DataFrame:
    """The titles with their counts of characters, eight codes of RING in each of h0, h1 and on. Bits in which two titles
    differ are no more than they differ in counts, hence no more than they have characters that are not shared in order.
    `laps` has how often each count went round the ring (at most 255 times), for texts where that hides a difference, and
    `pairs` counts neighbouring pairs of characters of long ones."""
    ring = np.array(RING, np.uint8)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = batch.column("t").to_pylist()
            counts, paired = _counts(texts), iter(_paired([t for t in texts if len(t) >= LONG]))
            words = ring[counts % 16].view(np.int64)
            laps = np.minimum(counts // 16, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("n"), *map(pa.array, words.T), pa.array([x.tobytes() for x in laps], pa.binary()),
                                              pa.array([next(paired).tobytes() if len(t) >= LONG else b"" for t in texts], pa.binary())],
                                             ["tid", "n", *[f"h{k}" for k in range(words.shape[1])], "laps", "pairs"])

    return titles.select("tid", "n", "t").mapInArrow(each, f"tid long, n int, {', '.join(f'h{k} long' for k in range(PLACES // 8))}, laps binary, pairs binary")


def _apart(a: str, b: str) -> Column:
    """By how much two words of counts differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _reach(n: np.ndarray | int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """The shortest and the longest title that one of length n can be similar to."""
    return np.ceil(n * (1 - miss) / (1 + miss) - 1e-9).astype(int), np.floor(n * (1 + miss) / (1 - miss) + 1e-9).astype(int)


class Blocks:
    """Titles of one side by length, in blocks of about BLOCK: a length with more than that has several blocks."""

    def __init__(self, titles: DataFrame):
        found = sorted(tuple(r) for r in titles.groupBy("n").agg(F.count("*")).collect())  # one number per length
        self.lengths, first, parts, held, at = np.array([n for n, _ in found], int), [], [], 0, -1
        for _, many in found:
            if at < 0 or held + many > BLOCK:
                at, held = at + (parts[-1] if parts else 1), 0
            first.append(at)
            parts.append(-(-many // BLOCK))
            held += many
        self.first, self.parts = np.array(first, int), np.array(parts, int)

    def met(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block and number of blocks that have titles of these lengths."""
        i, j = np.searchsorted(self.lengths, low), np.searchsorted(self.lengths, high, "right") - 1
        some = i <= j
        i, j = np.where(some, i, 0), np.where(some, j, 0)
        return self.first[i], np.where(some, self.first[j] + self.parts[j] - self.first[i], 0)

    def own(self, n: np.ndarray, tid: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.lengths, n)
        mixed = (tid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[i] + (mixed % self.parts[i].astype(np.uint64)).astype(int)


def _in_tiles(counted: DataFrame, own: Blocks, others: Blocks, miss: float, names: tuple[str, str]) -> DataFrame:
    """Each title in every tile of its block and a block with lengths that a similar one can have."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tid = batch.column("n").to_numpy(), batch.column("tid").to_numpy()
            start, many = others.met(*_reach(n, miss)) if len(others.lengths) else (n, n * 0)
            row = np.repeat(np.arange(len(n)), many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            tiles = {names[0]: own.own(n, tid)[row], names[1]: start[row] + step}
            for at in range(0, len(row), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(tiles[c][part], pa.int32()) for c in ("i", "j")] + batch.take(pa.array(row[part])).columns, ["i", "j", *batch.schema.names])

    spelled = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    return counted.mapInArrow(each, f"i int, j int, {spelled}")


def _may_be_similar(left: pa.Table, right: pa.Table, miss: float) -> pa.Table:
    """(l, r) of a tile: pairs whose counts of characters allow the ratio."""
    def side(t: pa.Table) -> tuple:
        t = t.sort_by("n")
        words = np.stack([t.column(f"h{k}").to_numpy() for k in range(PLACES // 8)]).view(np.uint64)
        spelled = lambda c, width: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, width)
        round_ = np.zeros(256, np.uint8)
        round_[RING] = range(16)
        counts = round_[np.ascontiguousarray(words.T).view(np.uint8)] + spelled("laps", PLACES).astype(np.int32) * 16
        n = t.column("n").to_numpy()
        return t.column("tid").to_numpy(), n, words, counts, spelled("pairs", PAIRED), np.searchsorted(n, LONG)

    def near(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        runs = [slice(p, p + RUN // 16) for p in range(0, len(i), RUN // 16)]
        return np.concatenate([np.abs(a[i[p]] - b[j[p]].astype(np.int32)).sum(axis=1) for p in runs] or [i]) <= most

    if not (left.num_rows and right.num_rows):
        return pa.table({"l": pa.array([], pa.int64()), "r": pa.array([], pa.int64())})
    lid, ln, lw, lc, lp, l_long = side(left)
    rid, rn, rw, rc, rp, r_long = side(right)
    found = []
    for n in np.unique(ln):
        low, high = _reach(n, miss)
        begin, end = np.searchsorted(rn, low), np.searchsorted(rn, high, "right")
        mine = range(np.searchsorted(ln, n), np.searchsorted(ln, n, "right"))
        room = np.floor(miss * (n + rn[begin:end]) + 1e-9).astype(np.int32)
        roomy = np.minimum(room, 255).astype(np.uint8)
        step = max(1, RUN // max(1, end - begin))
        for at in range(mine.start, mine.stop, step) if begin < end else ():
            x, y = slice(at, min(at + step, mine.stop)), slice(begin, end)
            # Two words tell most pairs apart; the others are looked at for what is left, then the counts in full.
            apart = np.bitwise_count(lw[0, x, None] ^ rw[0, y]) + np.bitwise_count(lw[1, x, None] ^ rw[1, y])
            i, j = np.divmod(np.flatnonzero(apart <= roomy), end - begin)
            rest = room[j] - apart[i, j]
            i, j = i + at, j + begin
            for k in range(2, len(lw)):
                rest = rest - np.bitwise_count(lw[k, i] ^ rw[k, j])
                still = rest >= 0
                i, j, rest = i[still], j[still], rest[still]
            still = near(lc, rc, i, j, room[j - begin])
            i, j = i[still], j[still]
            still = (i < l_long) | (j < r_long)
            longs = np.flatnonzero(~still)
            still[longs] = near(lp, rp, i[longs] - l_long, j[longs] - r_long, 3 * room[j[longs] - begin])
            found.append((lid[i[still]], rid[j[still]]))
    l, r = (np.concatenate([f[k] for f in found]) if found else np.array([], np.int64) for k in (0, 1))  # noqa: E741
    return pa.table({"l": l, "r": r})


def similar_titles(left: DataFrame, right: DataFrame, min_ratio: float, above: bool = False) -> DataFrame:
    """(lt, rt, ratio) for all pairs of distinct titles (columns t) with at least this ratio, or more than it if `above`.

    Titles of a side are dealt into blocks by length, and meet in tiles of two blocks whose lengths a similar pair can have,
    so that no length is one task's. What meets is numbers only, compared in numpy, and a pair leaves its tile only if the
    counts of its characters allow the ratio, which loses none and leaves about one of a thousand. Edit distance on the
    JVM and the exact ratio in Arrow batches decide on these. Null and empty titles are similar to none; ratios have to be
    over 50."""
    if not 50 < min_ratio <= 100:
        raise ValueError("min_ratio has to be over 50")
    miss = 1 - min_ratio / 100.0
    a = _numbered(left.filter(F.col("t") != ""))
    b = a if right is left else _numbered(right.filter(F.col("t") != ""))
    blocks = Blocks(a), Blocks(b)
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = _in_tiles(_counted(a), *blocks, miss, ("i", "j")).repartition(parts, "i", "j")
    y = _in_tiles(_counted(b), *blocks[::-1], miss, ("j", "i")).repartition(parts, "i", "j")
    pairs = x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(lambda s, t: _may_be_similar(s, t, miss), "l long, r long")
    named = pairs.join(a.select(F.col("tid").alias("l"), F.col("t").alias("lt")), "l").join(b.select(F.col("tid").alias("r"), F.col("t").alias("rt")), "r")
    close = named.filter(may_reach(F.col("lt"), F.col("rt"), min_ratio)).select("lt", "rt")
    rated = close.withColumn("ratio", ratio(F.col("lt"), F.col("rt")))
    return rated.filter(F.col("ratio") > min_ratio if above else F.col("ratio") >= min_ratio)


def first_comers(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, o, c, h, barred) with `created`: one by one in the order o, a row is created unless it is barred, an
    earlier row with the same h was created, or one of a class that `edges` (c, d) lead to from its class c.

    Rounds settle all rows that can be: those with a created row before them go, and those with no open row before them
    among their classes and in their h are created. Classes and h pass on only their first open and first created row, so
    that a group of any size costs one row per task. Null c or h meet nothing. Edges of a class to itself are implied."""
    own = rows.filter(F.col("c").isNotNull()).select("c", F.col("c").alias("d"))
    both = cut_lineage(edges.select("c", "d").union(own).distinct())
    state = cut_lineage(rows.withColumn("created", F.when(F.col("barred"), F.lit(False))))
    while not state.filter(F.col("created").isNull()).isEmpty():
        reach = firsts(state, "c", F.col("created").isNull(), F.col("created"))
        around = both.join(reach.withColumnRenamed("c", "d"), "d").groupBy("c").agg(F.min("open").alias("c_open"), F.min("hit").alias("c_hit"))
        same = firsts(state, "h", F.col("created").isNull(), F.col("created")).toDF("h", "h_open", "h_hit")
        j = state.join(around, "c", "left").join(same, "h", "left")
        gone = before("c_hit") | before("h_hit")
        free = ~before("c_open") & ~before("h_open")
        state = cut_lineage(j.withColumn("created", F.coalesce("created", F.when(gone, F.lit(False)).when(free, F.lit(True)))).drop("c_open", "c_hit", "h_open", "h_hit"))
    return state


def firsts(state: DataFrame, group: str, is_open: Column, is_hit: Column) -> DataFrame:
    """Per group the first open and the first hit row, by o."""
    return state.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(F.when(is_open, F.col("o"))).alias("open"), F.min(F.when(is_hit, F.col("o"))).alias("hit"))


def before(c: str) -> Column:
    return F.coalesce(F.col(c) < F.col("o"), F.lit(False))
