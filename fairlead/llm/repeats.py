"""Removal of byte strings that occur more than once in a corpus, by suffix arrays over shards of its repeated passages.

A string of `length` bytes is stood for by its smallest `gram` (by hash, the leftmost): equal strings have it at the same
place. The strings that share one lie side by side and make a passage; its gram is the key by which passages that may
have a string in common meet. Keys met once are done with; equal passages are folded, and repeat as a whole. What is
left, one copy of each passage that competes with others, goes to shards by key. A shard's suffix array and common
prefixes tell which of its strings repeat. A key with more passages than a shard takes is spread over several shards, and
these are merged by binary search over the place of the string: the passages are halved, keyed by the bytes that all
strings of a half share, folded, and halved again where still too many meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.shared import emptied, given_back, map_text, written
from fairlead.llm.shingles import BASE, BASE_INVERSE, mix
from fairlead.llm.suffixes import common_prefixes, suffix_array

#: Bytes whose strings are looked at together, and bytes of one suffix array.
TOGETHER, SHARD = 1 << 18, 1 << 20
#: A passage's first and last place of its key within a string, as one number.
WIDE = 1 << 16
RUNS = "array<struct<first:int,last:int>>"
_rng = np.random.default_rng(20260711)
#: A random value for each byte.
OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def passages(data: np.ndarray, ends: np.ndarray, length: int, gram: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, gram's place, key, digest) of all passages of texts that stand one after the other in data, each
    ending at its `ends`. first and last are the places of a passage's first and last string."""
    size, wide = len(data), length - gram + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(OF_BYTE[data] * up[:size], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: size - gram + 1])
    places = np.uint64((1 << 24) - 1)
    rated = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(rated, wide) & places
    begins = np.concatenate([[0], ends[:-1]])
    strings = np.maximum(ends - begins - length + 1, 0)
    to = np.concatenate([[0], np.cumsum(strings)])
    at = np.arange(to[-1]) + np.repeat(begins - to[:-1], strings)
    least = least[at].astype(np.int64)
    change = np.ones(len(at), bool)
    change[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place, first, last = least[first], at[first], at[last]
    digest = mix((total[last + length] - total[first]) * down[first] + np.uint64(1))
    return first, last, place, grams[place], digest


def sliding_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of every `wide` values in a row, from minima towards both ends of blocks of that width."""
    n = len(values) - wide + 1
    padded = np.full(-(-len(values) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    cut = padded.reshape(-1, wide)
    right = np.minimum.accumulate(cut, axis=1).reshape(-1)
    left = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n], right[wide - 1:wide - 1 + n])


def pieces(offsets: np.ndarray, length: int, together: int) -> Iterator[list[tuple[int, int, int]]]:
    """(row, from, to) in lists of about `together` bytes; a longer text comes in pieces that overlap by length - 1 bytes, so
    that each of its strings is in one."""
    held, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b - length + 1, together):
            end = min(b, at + together + length - 1)
            held.append((row, at, end))
            size += end - at
            if size >= together:
                yield held
                held, size = [], 0
    if held:
        yield held


def places_of(texts: DataFrame, length: int, gram: int, together: int = TOGETHER) -> DataFrame:
    """(tid, at, key, digest, o, w) of every passage of the texts (tid, data, copies)."""
    def start():
        most = 2 * (together + length)
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE))

        def each(batch: pa.RecordBatch) -> dict:
            column = batch.column("data").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
            out: dict[str, list] = {c: [np.zeros(0, np.int64)] for c in ("row", "at", "key", "digest", "o")}
            for held in pieces(offsets, length, together):
                joined = data[held[0][1]:held[0][2]] if len(held) == 1 else np.concatenate([data[a:b] for _, a, b in held])
                ends = np.cumsum([b - a for _, a, b in held])
                first, last, place, key, digest = passages(joined, ends, length, gram, up, down)
                piece = np.searchsorted(ends, first, side="right")
                rows = np.array([row for row, _, _ in held])[piece]
                shift = np.array([a - offsets[row] for row, a, _ in held]) - np.concatenate([[0], ends[:-1]])
                out["row"].append(rows)
                out["at"].append(first + shift[piece])
                out["key"].append(key.view(np.int64))
                out["digest"].append(digest.view(np.int64))
                out["o"].append((place - first) * WIDE + (place - last))
            made = {c: np.concatenate(x) for c, x in out.items()}
            row = pa.array(made.pop("row"))
            return {"tid": batch.column("tid").take(row), "w": batch.column("w").take(row), "at": made["at"].astype(np.int32), "o": made["o"].astype(np.int32), "key": made["key"], "digest": made["digest"]}

        return each

    return map_text(texts, "tid binary, at int, key long, digest long, o int, w int", start)


def cut_out(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The wanted passages (tid, at, key, digest, o, n) with their bytes."""
    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct("at", "key", "digest", "o", "n")).alias("wanted"))
    both = texts.select("tid", "data").join(lists, "tid").select("data", "wanted")

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            wanted = batch.column("wanted")
            flat, counts = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
            o, at = flat.field("o").to_numpy(), flat.field("at").to_numpy()
            ends = (at + length + o // WIDE - o % WIDE).tolist()
            data, texts = [], [memoryview(t.as_buffer()) for t in batch.column("data")]
            for row, a, b in zip(np.repeat(np.arange(batch.num_rows), counts).tolist(), at.tolist(), ends):
                data.append(bytes(texts[row][a:b]))
            return {"key": flat.field("key"), "digest": flat.field("digest"), "o": flat.field("o"), "n": flat.field("n"), "data": data}

        return each

    return map_text(both, "key long, digest long, o int, n long, data binary", start)


def repeated_strings(data: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the passages, which of its strings of `length` bytes occur in another place of them."""
    sizes = np.array([len(d) for d in data])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
    gaps = begins[1:] - 1
    codes = np.zeros(256, np.int64)
    present = np.flatnonzero(np.bincount(raw, minlength=256))
    codes[present] = np.arange(len(present)) + 2  # 1 ends a passage
    symbols = codes[raw]
    symbols[gaps] = 1
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order, length)
    rest = np.repeat(gaps, sizes + 1) - np.arange(len(raw))
    whole = rest[order] >= length
    same = (shared >= length) & whole
    same[1:] &= whole[:-1]
    twice = np.zeros(len(raw), bool)
    twice[order] = same | np.concatenate([same[1:], [False]])
    return [twice[a:a + n - length + 1] for a, n in zip(begins[:-1].tolist(), sizes.tolist())]


def runs_of(flags: np.ndarray) -> list[dict[str, int]]:
    """First and last place of every run of true ones."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return [{"first": a, "last": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())]


def in_shards(wanted: DataFrame, length: int) -> DataFrame:
    """(key, digest, o, runs) of the passages met once of which strings repeat in their shard. The passages of a key are
    in one shard, and a shard's are sorted by key, so that a suffix array is made of whole keys and bounded in size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("o", pa.int32()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
        held: list[tuple] = []

        def settled() -> pa.RecordBatch:
            flags = repeated_strings([h[4] for h in held], length)
            rows = [{"key": k, "digest": d, "o": o, "runs": runs_of(f)} for (k, d, o, n, _), f in zip(held, flags) if n == 1 and f.any()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "o", "n", "data"))):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield settled()
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settled()
        given_back()

    dealt = wanted.select("key", "digest", "o", "n", "data").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"key long, digest long, o int, runs {RUNS}")


def whole_run() -> str:
    return f"array(named_struct('first', 0, 'last', o div {WIDE} - o % {WIDE}))"


def halves(wanted: DataFrame, step: int, length: int) -> DataFrame:
    """Passages cut where the place of their key within a string passes a multiple of `step`: (key, digest, o of the whole,
    key2, digest2, o2, n, data, by), keyed anew by the bytes that strings with their key in this range have in common; `by`
    is how many strings of the whole come before."""
    high, low = f"o div {WIDE}", f"o % {WIDE}"
    cut = wanted.withColumn("part", F.expr(f"explode(sequence({low} div {step}, {high} div {step}))"))
    cut = cut.withColumn("high", F.expr(f"least({high}, (part + 1) * {step} - 1)")).withColumn("low", F.expr(f"greatest({low}, part * {step})"))
    cut = cut.withColumn("by", F.expr(f"{high} - high")).withColumn("part_data", F.expr(f"substring(data, by + 1, {length} + high - low)"))
    common = F.expr(f"substring(part_data, high - part * {step} + 1, {length - step + 1})")
    return cut.select("key", "digest", "o", F.xxhash64("key", "part", F.lit(step), common).alias("key2"), F.xxhash64("part_data").alias("digest2"), F.expr(f"CAST(high * {WIDE} + low AS INT)").alias("o2"), "n", F.col("part_data").alias("data"), "by")


def repeated(wanted: DataFrame, length: int, most: int, step: int) -> DataFrame:
    """(key, digest, o, runs) of the passages (key, digest, o, n, data) met once of which strings repeat. Keys with more
    than `most` passages are halved."""
    crowded = written(wanted.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > most).select("key"))
    if crowded.isEmpty():
        return written(in_shards(wanted, length))
    few = in_shards(wanted.join(crowded, "key", "left_anti"), length)
    step //= 2
    parts = written(halves(wanted.join(crowded, "key", "left_semi"), step, length))
    names = [F.col("key2").alias("key"), F.col("digest2").alias("digest"), F.col("o2").alias("o")]
    folded = written(parts.select(*names, "n", "data").groupBy("key", "digest", "o").agg(F.sum("n").alias("n"), F.first("data").alias("data")))
    contested = folded.join(folded.groupBy("key").agg(F.count("*").alias("held"), F.min("n").alias("least")).where("held > 1 AND least = 1").select("key"), "key", "left_semi")
    found = repeated(written(contested), length, most, step)
    known = written(found.union(folded.where("n > 1").selectExpr("key", "digest", "o", f"{whole_run()} AS runs")))
    back = parts.where("n = 1").select("key", "digest", "o", "by", *(F.col(c) for c in ("key2", "digest2", "o2")))
    back = back.join(known.select(F.col("key").alias("key2"), F.col("digest").alias("digest2"), F.col("o").alias("o2"), "runs"), ["key2", "digest2", "o2"])
    back = back.select("key", "digest", "o", F.expr("transform(runs, r -> named_struct('first', CAST(r.first + by AS INT), 'last', CAST(r.last + by AS INT)))").alias("runs"))
    return written(few.union(back.groupBy("key", "digest", "o").agg(F.flatten(F.collect_list("runs")).alias("runs"))))


def removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(tid, n_bytes, n_removed, n_spans, kept_sha256) of the texts without what the spans (tid, first, last) cover."""
    lists = spans.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    both = texts.select("tid", "data").join(lists, "tid", "left")

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for data, spans in zip(batch.column("data"), batch.column("spans")):
                data, kept, n, runs, done = memoryview(data.as_buffer()), hashlib.sha256(), 0, 0, 0
                if spans.is_valid:
                    first, last = (spans.values.field(c).to_numpy() for c in ("first", "last"))
                    sort = np.argsort(first, kind="stable")
                    first, last = first[sort], np.maximum.accumulate(last[sort])
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
                    for a, b in zip(first[new].tolist(), last[np.concatenate([new[1:], [len(last)]]) - 1].tolist()):
                        kept.update(data[done:a])
                        n, runs, done = n + b - a, runs + 1, b
                kept.update(data[done:])
                for c, v in zip(out, (len(data), n, runs, kept.hexdigest())):
                    out[c].append(v)
            return {"tid": batch.column("tid")} | out

        return each

    return map_text(both, "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string", start)


def without_repeats(docs: DataFrame, length: int = 400, gram: int = 128, most: int = 1500, together: int = TOGETHER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256. A byte of a text (UTF-8) is removed if
    a string of `length` bytes that covers it also starts anywhere else, in this text or another.

    A null text counts as an empty one; null and repeated ids are kept as they are; equal rows repeat each other, so that
    texts of at least `length` bytes that come twice go whole; texts of any length are read whole, long ones in pieces; an
    empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).withColumn("tid", F.unhex(F.md5("data")))
    ids = rows.select("doc_id", "tid")
    texts = written(rows.groupBy("tid").agg(F.first("data").alias("data"), F.least(F.count("*"), F.lit(2)).cast("int").alias("w")))
    places = written(places_of(texts.where(F.length("data") >= length), length, gram, together))
    shared = places.groupBy("key").agg(F.sum("w").alias("held")).where("held > 1").select(F.bitwise_not(F.bitwise_not("key")).alias("key"))
    met = written(places.join(shared, "key"))
    emptied(places)
    folded = written(met.groupBy("key", "digest", "o").agg(F.sum("w").alias("n"), F.min(F.struct("tid", "at")).alias("one")).select("key", "digest", "o", "n", "one.*"))
    crowds = folded.groupBy("key").agg(F.count("*").alias("held"), F.min("n").alias("least")).where("held > 1 AND least = 1").select(F.bitwise_not(F.bitwise_not("key")).alias("key"))
    wanted = written(cut_out(written(folded.join(crowds, "key")), texts, length))
    found = repeated(wanted, length, most, 1 << (length - gram).bit_length())
    known = written(found.union(folded.where("n > 1").selectExpr("key", "digest", "o", f"{whole_run()} AS runs")))
    spans = met.join(known, ["key", "digest", "o"]).select("tid", "at", F.explode("runs").alias("run"))
    told = written(removed(texts, spans.select("tid", F.expr("at + run.first").alias("first"), F.expr(f"at + run.last + {length}").alias("last"))))
    return ids.join(told, "tid").drop("tid")
