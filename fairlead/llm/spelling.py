"""Spelling variants: words one edit apart, each led to the most frequent spelling.

Every word of the vocabulary generates its deletions and replacements as hashes, computed from its own hash by numpy.
They are probed against blocked Bloom filters, one for each word length, broadcast in rounds of bounded size; what passes
is joined with the vocabulary by hash and compared as text, so that false positives only cost their row in that shuffle.
Insertions need no probes: they are deletions seen from the other word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.shared import dealt_afresh, given_back, map_text, sliced, written
from fairlead.llm.shingles import BASE, BASE_INVERSE, VALUES, mix

#: Words are runs of the letters a-z and À-ÿ; every 199th loses a letter.
EVERY = 199
OUTSIDE = re.compile("[^a-zÀ-ÿ]")
#: Words that a counting task remembers before it hands on its counts; longest run (bytes) whose checksum is combined.
MOST_WORDS, SHORT = 200_000, 64
#: Longer words share the last filter. Bits of a filter for each word, and bits set for each.
LONGEST, BITS, SET = 64, 16, 4
#: Words of 64 bits in one row of a filter, and probes made at once.
CHUNK, PROBES = 4096, 1 << 20


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


def blocks(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts that end between words."""
    at = 0
    while len(text) - at > most:
        end = OUTSIDE.search(text, at + most)
        if end is None:
            break
        yield text[at:end.start()]
        at = end.start()
    yield text[at:] if at else text


class Numbering(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


class Counts:
    """Words of documents with their counts. The checksum of an id and a run together is combined from theirs (appending
    bytes is linear in the checksum before them), so that a run is read once and its occurrences are counted in numpy."""

    def __init__(self, least: int):
        self.find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
        self.least, self.table = least, crc_table()
        self.clear()

    def clear(self) -> None:
        self.known = Numbering()
        self.words: list[str] = []
        self.crcs, self.sizes, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cut: Counter[str] = Counter()

    def add(self, ids: list[int | None], texts: list[bytes], most: int = 500_000) -> None:
        begun = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
        shifted = np.empty((len(ids), SHORT + 1), np.uint32)
        shifted[:, 0] = begun
        for size in range(SHORT):
            shifted[:, size + 1] = self.table[shifted[:, size] & 255] ^ (shifted[:, size] >> 8)
        found, rows, held = [], [], []
        for row, text in enumerate(texts):
            for block in blocks(text.lower().decode()):
                words = self.find(block)
                found += words
                rows.append(row)
                held.append(len(words))
                if len(found) >= most:
                    self.count(found, np.repeat(rows, held), shifted, begun)
                    found, rows, held = [], [], []
        self.count(found, np.repeat(np.array(rows, np.int64), held), shifted, begun)

    def count(self, found: list[str], rows: np.ndarray, shifted: np.ndarray, begun: np.ndarray) -> None:
        known = self.known
        at = np.array([known[w] for w in found], np.int64)
        fresh = list(known)[len(self.words):] if len(known) > len(self.words) else []
        raw = [w.encode() for w in fresh]
        self.words += fresh
        self.crcs = np.concatenate([self.crcs, np.array([zlib.crc32(r) for r in raw], np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.array([len(r) for r in raw], np.int64)])
        self.n = np.concatenate([self.n, np.zeros(len(raw), np.int64)]) + np.bincount(at, minlength=len(known))
        sizes = self.sizes[at]
        sums = shifted[rows, np.minimum(sizes, SHORT)] ^ self.crcs[at]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            sums[i] = zlib.crc32(found[i].encode(), int(begun[rows[i]]))
        for i in np.flatnonzero(sums % EVERY == 0).tolist():
            word = found[i]
            self.n[at[i]] -= 1
            place = int(sums[i]) % len(word)
            self.cut[word[:place] + word[place + 1:]] += 1

    def given(self) -> Iterator[pa.RecordBatch]:
        words, n = self.words + list(self.cut), np.concatenate([self.n, np.fromiter(self.cut.values(), np.int64, len(self.cut))])
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at:at + 50_000], pa.string()), pa.array(n[at:at + 50_000])], names=["word", "n"])
        self.clear()


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, size, h) of all words that are long and frequent enough, with code points and hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(least_length)
        for batch in batches:
            for part in sliced(batch):
                counts.add(part.column("id").to_pylist(), [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                if len(counts.words) > MOST_WORDS:
                    yield from counts.given()
        yield from counts.given()
        given_back()

    counted = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count).where(F.length("word") >= least_length)

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            return {"word": batch.column("word"), "n": batch.column("n"), "size": np.array([len(w) for w in raw], np.int32), "h": np.array([hash_of(w) for w in raw], np.uint64).view(np.int64)}

        return each

    return map_text(words, "word string, n long, size int, h long", start)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) if n else np.zeros(0, np.uint64)


def hash_of(word: bytes) -> np.uint64:
    """A mixed polynomial in the word's letters (their Latin-1 bytes), so that edits can be hashed by differences."""
    data = np.frombuffer(word, np.uint8)
    return mix((VALUES[data] * powers(BASE, len(data))).sum(dtype=np.uint64, keepdims=True))[0]


class Filters:
    """Blocked Bloom filters side by side: offset and blocks (a power of two) by shard, a shard being a word length and a
    part of the hashes. A key sets SET bits of one 64-bit block."""

    def __init__(self, shards: dict[tuple[int, int], tuple[int, int]], parts: dict[int, int], data: np.ndarray):
        wide = max(parts.values(), default=1)
        self.offset, self.mask = np.full((LONGEST + 1, wide), -1, np.int64), np.zeros((LONGEST + 1, wide), np.int64)
        self.parts = np.ones(LONGEST + 1, np.uint64)
        for size, n in parts.items():
            self.parts[size] = n
        for (size, part), (offset, blocks) in shards.items():
            self.offset[size, part], self.mask[size, part] = offset, blocks - 1
        self.data = data

    def place(self, h: np.ndarray, size: int) -> np.ndarray:
        """The block of each key, or -1 where these filters don't hold its shard."""
        size = min(size, LONGEST)
        part = ((h >> np.uint64(52)) & (self.parts[size] - np.uint64(1))).astype(np.int64)
        offset = self.offset[size][part]
        return np.where(offset < 0, -1, offset + ((h >> np.uint64(24)).astype(np.int64) & 0xFFFFFFF & self.mask[size][part]))

    @staticmethod
    def bits(h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for k in range(SET):
            out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return out

    def holds(self, h: np.ndarray, size: int) -> np.ndarray:
        """Whether each key may be there."""
        place = self.place(h, size)
        bits = self.bits(h)
        return (place >= 0) & (self.data[place] & bits == bits) if len(self.data) else np.zeros(len(h), bool)


def rounds_of(held: dict[int, int], most_bytes: int) -> tuple[list[dict[tuple[int, int], tuple[int, int]]], dict[int, int]]:
    """From words by length: rounds of shards with offset and blocks, each round of at most most_bytes; parts by length.
    A length that is too large for a round is cut by hash into parts."""
    parts, rounds, used = {}, [{}], 0
    for size, n in sorted(held.items()):
        blocks = 1 << max(3, (n * BITS // 64).bit_length())
        parts[size] = max(1, min(1 << 12, blocks * 8 // most_bytes))
        blocks = min(max(8, blocks // parts[size]), most_bytes // 8, 1 << 28)
        for part in range(parts[size]):
            if (used + blocks) * 8 > most_bytes:
                rounds, used = [*rounds, {}], 0
            rounds[-1][size, part] = used, blocks
            used += blocks
    return rounds, parts


def filters_of(words: DataFrame, shards: dict, parts: dict[int, int]) -> Filters:
    """The filters of one round: each task sets the bits of its words, rows of blocks are merged by Spark."""
    blank = Filters(shards, parts, np.zeros(0, np.uint64))
    total = sum(blocks for _, blocks in shards.values())

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            h, sizes = batch.column("h").to_numpy().view(np.uint64), np.minimum(batch.column("size").to_numpy(), LONGEST)
            place = np.full(len(h), -1, np.int64)
            for size in np.unique(sizes).tolist():
                place[sizes == size] = blank.place(h[sizes == size], size)
            keep = place >= 0
            return {"block": place[keep], "bits": Filters.bits(h[keep]).view(np.int64)}

        return each

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bits = batch.column("block").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
            for c in np.unique(block // CHUNK).tolist():
                inside = block // CHUNK == c
                rows.setdefault(c, np.zeros(CHUNK, np.uint64))[block[inside] % CHUNK] = bits[inside]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], names=["chunk", "blocks"])

    bits = map_text(words, "block long, bits long", start).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    packed = bits.repartition(F.expr(f"block div {CHUNK}")).mapInArrow(pack, "chunk long, blocks binary")
    data = np.zeros(-(-total // CHUNK) * CHUNK, np.uint64)
    for row in packed.collect():
        data[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(row["blocks"], np.uint64)
    return Filters(shards, parts, data)


def edits(words: list[bytes], letters: np.ndarray, least_length: int, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, hashes) of edits of words of one length that the filters let pass. Of two words that differ by a letter,
    the one with the smaller letter generates the other; of equal neighbouring letters, the last is deleted."""
    size, n = len(words[0]), len(words)
    data = np.frombuffer(b"".join(words), np.uint8).reshape(n, size)
    up, down = powers(BASE, size), BASE_INVERSE
    parts = VALUES[data] * up
    whole = parts.sum(axis=1, dtype=np.uint64)[:, None]
    if size > least_length:
        before = np.cumsum(parts, axis=1) - parts
        made = mix(before + (whole - before - parts) * down)
        last = np.ones((n, size), bool)
        last[:, :-1] = data[:, :-1] != data[:, 1:]
        row, _ = np.nonzero(last)
        made = made[last]
        passed = filters.holds(made, size - 1)
        yield row[passed], made[passed]
    step = max(1, PROBES // (n * max(1, len(letters))))
    for at in range(0, size, step):
        here = slice(at, min(at + step, size))
        made = ((whole - parts[:, here])[:, :, None] + (VALUES[letters][None, :] * up[here][:, None])[None])
        above = letters[None, None, :] > data[:, here, None]
        row = np.nonzero(above)[0]
        made = mix(made[above])
        passed = filters.holds(made, size)
        yield row[passed], made[passed]


def positives(words: DataFrame, filters: Filters, letters: np.ndarray, least_length: int) -> DataFrame:
    """(word, n, h) of all edits that may be words."""
    shared = words.sparkSession.sparkContext.broadcast((filters, letters))

    def start():
        filters, letters = shared.value

        def each(batch: pa.RecordBatch) -> dict:
            words, n = [w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("n").to_numpy()
            sizes = np.array([len(w) for w in words], np.int64)
            rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                step = max(1, PROBES // (size * max(1, len(letters))))
                for at in range(0, len(some), step):
                    for row, h in edits([words[i] for i in some[at:at + step]], letters, least_length, filters):
                        rows.append(some[at:at + step][row])
                        hashes.append(h)
            row = np.concatenate(rows)
            return {"word": batch.column("word").take(pa.array(row)), "n": n[row], "h": np.concatenate(hashes).view(np.int64)}

        return each

    return map_text(words.select("word", "n"), "word string, n long, h long", start)


def near_words(words: DataFrame, least_length: int = 6, most_bytes: int = 64 << 20) -> DataFrame:
    """(word, n, near, near_n) for every two words one edit apart, both ways. words is a written vocabulary; most_bytes
    bounds the filters that are broadcast at once, and larger vocabularies take more rounds."""
    held = {r["size"]: r["held"] for r in words.groupBy(F.least("size", F.lit(LONGEST)).alias("size")).agg(F.count("*").alias("held")).collect()}
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect()
    letters = np.array(sorted(ord(r["letter"]) for r in used if r["letter"]), np.uint8)
    rounds, parts = rounds_of(held, most_bytes)
    found = None
    for shards in rounds:
        passed = positives(words, filters_of(words, shards, parts), letters, least_length)
        found = passed if found is None else found.union(passed)
    there = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "h")
    pairs = written(found.join(dealt_afresh(there, "h"), "h").where("levenshtein(word, near, 1) = 1").select("word", "n", "near", "near_n"))
    return pairs.union(pairs.selectExpr("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to their end, each round over twice as many steps."""
    found = written(forms.select("word", F.col("form").alias("root")))
    while True:
        there = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(there, "root", "left_semi").isEmpty():
            return found
        found = written(found.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, id: str = "doc_id", text: str = "text", most_bytes: int = 64 << 20) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n. Words are runs of letters, A-Z as a-z, of
    least_length code points that occur least_count times (every 199th run, by checksum of id and run, loses a letter
    first). Its form is the word one edit away that occurs most, if `times` as often; its root is where forms lead.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count each time; of equally
    frequent near words the first in code-point order is the form; words and texts of any length are taken whole; an
    empty table gives no rows; other columns are not read."""
    words = written(vocabulary(docs, least_length, least_count, id, text))
    best = near_words(words, least_length, most_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = words.select("word", "n").join(best, "word", "left")
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    led = written(led.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["near"].alias("form"), (-form["less"]).alias("form_n")))
    ends = roots(led.where("form IS NOT NULL"))
    return led.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
