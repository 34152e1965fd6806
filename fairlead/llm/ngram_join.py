"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered by how many documents hold them (rare ones first, by a sketch of all counts). Two sets that overlap
in t shingles share at least l of the first (size - t + l) of each, for every l. Each document picks its own l: a longer
prefix costs more rows, but a candidate then has to share l of them. A pair uses the smaller l of its two documents.

Groups of near copies would turn into all their pairs. So the join first ties every document to one pivot per group,
verifies those few pairs, and then looks only at candidates that lie in different components: a link within a component
changes nothing in the result. Links across components are all found and verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.components import components
from fairlead.llm.shared import dealt_afresh, emptied, given_back, map_text, sliced, written
from fairlead.llm.shingles import mix, sets_of

#: Counters of the sketch, and how many of them one row of it holds.
SKETCH_BITS = 20
CHUNK = 4096
#: Per octave so many steps of the order, which fits a byte for counts below 2**32.
STEPS = 8
#: The largest l a document may pick, and the costs that it weighs: a row of a prefix, a meeting of two rows, a candidate.
MOST_MATCHES = 4
ROW, MEETING, CANDIDATE = 1.0, 0.05, 5.0
KEY = np.uint64(0xD6E8FEB86659FD93)


def counted(docs: DataFrame) -> DataFrame:
    """One pass over the texts: for each row its set's size and 128-bit key (ident, ident2), and for each task the
    counters of the sketch in rows of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, waiting, held = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def settle() -> None:
            nonlocal waiting, held
            if waiting:
                places, n = np.unique(np.concatenate(waiting), return_counts=True)
                sketch[places] += n.astype(np.uint32)
            waiting, held = [], 0

        for batch in batches:
            for part in sliced(batch):
                n, one, two = [], [], []
                for _, found, at in sets_of(part.column("_text")):
                    n.append(np.diff(at))
                    for keys, mask in ((one, KEY), (two, ~KEY)):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ mask))])
                        keys.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                    waiting.append((found >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                    held += len(found)
                    if held > 1 << 18:
                        settle()
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)),
                    pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                ], names=["doc_id", "n", "ident", "ident2", "chunk", "counters"])
        settle()
        chunks = sketch.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(some), kind), *(pa.nulls(len(some), pa.int64()) for _ in range(3)),
            pa.array(some.astype(np.int32)), pa.array([chunks[c].tobytes() for c in some], pa.binary()),
        ], names=["doc_id", "n", "ident", "ident2", "chunk", "counters"])
        given_back()

    kind = pa.int64()
    return docs.mapInArrow(run, "doc_id long, n long, ident long, ident2 long, chunk int, counters binary")


def order_of(sketch: DataFrame) -> tuple[bytes, float]:
    """The sketch's counters summed over all tasks, as one byte each (log scale), and their mean. Its size is fixed by
    SKETCH_BITS: one megabyte, whatever the corpus."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counters in zip(batch.column("chunk").to_pylist(), batch.column("counters").to_pylist(), strict=True):
                total[c] = total.get(c, 0) + np.frombuffer(counters, np.uint32).astype(np.int64)
        for c, counters in total.items():
            steps = np.minimum(255, np.log2(1.0 + counters) * STEPS).astype(np.uint8)
            yield pa.RecordBatch.from_pylist([{"chunk": c, "steps": steps.tobytes(), "total": int(counters.sum())}], schema=pa.schema([("chunk", pa.int32()), ("steps", pa.binary()), ("total", pa.int64())]))

    steps, total = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK), 0
    for row in sketch.repartition("chunk").mapInArrow(add, "chunk int, steps binary, total long").collect():
        steps[row["chunk"]] = np.frombuffer(row["steps"], np.uint8)
        total += row["total"]
    return steps.tobytes(), total / steps.size


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap that a set of n shingles has with any set at this Jaccard similarity."""
    return (percent * n + 99) // 100


def matches(sizes: np.ndarray, n: int, t: int, noise: float) -> int:
    """The l of a document of n shingles of which the first in order are held by about `sizes` documents: the cheapest of
    1 .. MOST_MATCHES by rows written, meetings with other rows, and candidates, of which there are at most meetings / l.
    `noise` is what a counter shows for a shingle that is held once."""
    meet = np.cumsum(np.maximum(sizes - noise, 0))
    lengths = n - t + np.arange(1, min(MOST_MATCHES, t) + 1)
    met = meet[lengths - 1]
    return int(np.argmin(ROW * lengths + MEETING * met + CANDIDATE * met / (lengths - n + t))) + 1


def prefixes(docs: DataFrame, steps: bytes, mean: float, percent: int) -> DataFrame:
    """(doc_id, ident, n, matched, tokens) per row of docs with a set: its prefix in order. A set that came before in the
    same task is left out, so that copies do not add up."""
    shared = docs.sparkSession.sparkContext.broadcast(steps)

    def start():
        order, seen = np.frombuffer(shared.value, np.uint8), set()
        about, noise = 2.0 ** (np.arange(256) / STEPS), mean + 4 * mean**0.5 + 1

        def each(batch: pa.RecordBatch) -> dict:
            ids = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {c: [] for c in ("doc_id", "n", "matched", "tokens")}
            for first, found, at in sets_of(batch.column("_text")):
                place = order[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ KEY))])
                idents = (total[at[1:]] - total[at[:-1]]).tolist()
                for row, (a, b, ident) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), idents, strict=True)):
                    if a == b or ids[first + row] is None or (ident, b - a) in seen:
                        continue
                    seen.add((ident, b - a))
                    n, t = b - a, least_overlap(b - a, percent)
                    sort = np.argsort(place[a:b], kind="stable")[: n - t + min(MOST_MATCHES, t)]
                    matched = matches(about[place[a:b][sort]], n, t, noise)
                    out["doc_id"].append(ids[first + row])
                    out["n"].append(n)
                    out["matched"].append(matched)
                    out["tokens"].append(found[a:b][sort[: n - t + matched]].view(np.int64))
            return out

        return each

    return map_text(docs, "doc_id long, n long, matched int, tokens array<bigint>", start)


def whole_sets(docs: DataFrame, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """(id, tokens) of the wanted documents, and maybe of a few others: a bitmap of fixed size tells whose text has to be
    looked at, so that no text is shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = wanted.select(place("id").alias("p")).groupBy(F.expr("CAST(p DIV 32 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 32 AS INT)))").alias("set")).collect()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    for row in words:
        bitmap[row["word"]] = row["set"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def start():
        bitmap = np.frombuffer(shared.value, np.uint32)

        def each(batch: pa.RecordBatch) -> dict:
            p = batch.column("p").to_numpy(zero_copy_only=False).astype(np.int64)
            chosen = batch.take(pa.array(np.flatnonzero(bitmap[p >> 5] >> (p & 31).astype(np.uint32) & 1)))
            out: dict[str, list] = {"id": chosen.column("doc_id"), "tokens": []}
            for _, found, at in sets_of(chosen.column("_text")) if chosen.num_rows else ():
                out["tokens"] += [found[a:b].view(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return out

        return each

    return map_text(docs.where("doc_id IS NOT NULL").withColumn("p", place("doc_id")), "id long, tokens array<bigint>", start)


def may_link(a: str, b: str, percent: int):
    """Whether the shingle at a.pos and b.pos counts for this pair: with t the overlap that these sizes need and l the
    matches to be asked for, it has to be among the first (n - t + l) of both."""
    t = f"(({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent})"
    matched = f"least({a}.matched, {b}.matched, {t})"
    return F.expr(f"{t} <= least({a}.n, {b}.n) AND {a}.pos < {a}.n - {t} + {matched} AND {b}.pos < {b}.n - {t} + {matched}"), F.expr(matched)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """A table of the pairs (a, b) whose sets are similar enough, compared whole."""
    pairs = written(pairs)
    sets = written(whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("left", "right")))
    found = written(both.where(F.expr(f"{100 + percent} * common >= {percent} * (size(left) + size(right))")).select("a", "b"))
    emptied(pairs, sets)
    return found


def pivot_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """One pair for each document that shares shingles with the pivot of a group: the pivot met most often. A group is
    all documents with a shingle in their prefix; its pivot has the fewest rarer shingles, that is the fewest differences
    from the others; in later turns it is any one."""
    first = F.struct("pos", "sid", "n", "matched") if turn == 0 else F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "pos", "n", "matched")
    pivots = rows.groupBy("token").agg(F.min(first).alias("p")).select("token", "p.*")
    counts, _ = may_link("a", "p", percent)
    met = rows.alias("a").join(dealt_afresh(pivots, "token").alias("p"), "token").where(F.col("a.sid") != F.col("p.sid")).where(counts).groupBy(F.col("a.sid").alias("a"), F.col("p.sid").alias("b")).agg(F.count("*").alias("n"))
    return met.groupBy("a").agg(F.max(F.struct("n", F.bitwise_not("b").alias("less"))).alias("best")).select("a", F.bitwise_not("best.less").alias("b"))


def across(rows: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components. Of a group, its members outside the pivot's component meet all its
    members, so that a group which is one component gives nothing, and one with few strangers few pairs."""
    main = rows.groupBy("token").agg(F.min(F.struct("pos", "sid", "component")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", F.col("p.component").alias("main"))
    split = rows.join(dealt_afresh(main, "token"), "token")
    counts, matched = may_link("a", "b", percent)
    met = split.where("component <> main").alias("a").join(split.alias("b"), "token").where("a.component <> b.component AND (b.component = b.main OR a.sid < b.sid)").where(counts)
    pairs = met.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"), matched.alias("matched"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("matched").alias("matched")).where("n >= matched").select("a", "b")


def similar_components(docs: DataFrame, percent: int = 80, turns: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest id that links lead to. Two documents are
    linked when 100 * intersection >= percent * union of their sets of five-word shingles.

    Null and empty texts, and those without words, have 0 shingles and no links. Rows that share an id count as one
    document with the links of all; a null id is in no link, but gets the component of equal texts, if they have ids.
    Repeated rows stay. Whole texts of any length count. An empty table gives no rows; other columns aren't read."""
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    told = written(counted(slim))
    steps, mean = order_of(told.where("chunk IS NOT NULL"))
    facts = told.where("chunk IS NULL").select("doc_id", "n", "ident", "ident2")
    groups = facts.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "ident", "ident2").agg(F.min("doc_id").alias("sid"))
    known = written(facts.join(dealt_afresh(groups, "ident"), ["n", "ident", "ident2"], "left").select("doc_id", "n", "sid"))
    emptied(told)

    prefix = written(prefixes(slim, steps, mean, percent))
    rows = prefix.select("doc_id", "n", "matched", F.posexplode("tokens").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token")
    ids = known.where("sid IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "sid").distinct()
    rows = written(rows.join(dealt_afresh(shared, "token"), "token").join(ids, "doc_id").groupBy("token", "sid", "n", "matched").agg(F.min("pos").alias("pos")))
    emptied(prefix)

    several = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    links = ids.join(dealt_afresh(several, "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("sid").alias("b"))
    found = with_component(rows, None)
    for turn in range(turns):
        links = links.union(verified(pivot_pairs(found, percent, turn), slim, percent))
        tied = components(links)
        before, found = found, written(mixed(with_component(rows, tied)))
        emptied(*[before] * (turn > 0))
    links = links.union(verified(across(found, percent), slim, percent))
    tied = components(links)
    named = tied.select(F.col("node").alias("sid"), "component")
    return known.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "sid", "doc_id").alias("component_id"))


def with_component(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    if tied is None:
        return rows.withColumn("component", F.col("sid"))
    return rows.join(tied.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def mixed(rows: DataFrame) -> DataFrame:
    """The rows of shingles whose group is not one component yet."""
    several = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return rows.join(dealt_afresh(several, "token"), "token")
