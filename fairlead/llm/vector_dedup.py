"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned so that their leading coordinates carry most of what tells them apart. Linked vectors are close in
every coordinate, so cells over the first two bound who can be linked; the vectors of a cell and of its neighbours meet in
tiles of fixed size. In a tile, products are accumulated over leading coordinates first; what the others can still add is
bounded by the norms of the two rests, and pairs that cannot reach the threshold any more are left there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.components import components
from fairlead.llm.shared import dealt_afresh, map_text, written

#: Vectors on one side of a tile; coordinates after which a tile is thinned out; room for rounding in the bounds.
TILE = 512
STOPS = (8, 16, 32)
ROOM = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """Distinct vectors per label: (label, embedding, node, copies, key). Nulls, zeros and non-finite components are left out."""
    finite = "embedding IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return rows.where(finite).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("key", F.xxhash64("embedding"))


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the unit vectors, by falling spread: sums of products are made per task and per entry, so that
    width * width numbers come back, whatever the number of vectors."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("embedding").to_pylist(), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "v"])

    rows = vectors.where(F.size("embedding") == width).select("embedding").mapInArrow(products, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(width * width)
    for row in rows:
        total[row["at"]] = row["v"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1]


def matrix(vectors: list, width: int) -> np.ndarray:
    """Unit vectors in double precision, scaled by the largest component first so that no square overflows."""
    if not len(vectors):
        return np.zeros((0, width))
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned(vectors: DataFrame, width: int, threshold: float) -> DataFrame:
    """Adds the turned vector and its cell along the two leading axes. A cell is as wide as linked vectors can be apart."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    shared = vectors.sparkSession.sparkContext.broadcast(axes(vectors, width))

    def start():
        rotation = shared.value

        def each(batch: pa.RecordBatch) -> dict:
            z = matrix(batch.column("embedding").to_pylist(), width) @ rotation
            cells = np.floor(z[:, :2] / reach).astype(np.int32)
            return {c: batch.column(c) for c in ("label", "node", "copies", "key")} | {"z": list(z), "x0": cells[:, 0], "x1": cells[:, -1]}

        return each

    kinds = dict(vectors.dtypes)
    return map_text(vectors, f"label {kinds['label']}, node long, copies long, key long, z array<double>, x0 int, x1 int", start)


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with left[i] . right[j] >= threshold, by leading coordinates first."""
    width = left.shape[1]
    rest = lambda x, d: np.sqrt(np.maximum(0, (x[:, d:] ** 2).sum(axis=1)))
    first = min(STOPS[0], width)
    products = left[:, :first] @ right[:, :first].T
    i, j = np.nonzero(products + np.outer(rest(left, first), rest(right, first)) >= threshold - ROOM)
    sums = products[i, j]
    for begin, end in zip((first, *STOPS[1:]), (*STOPS[1:], width)):
        begin, end = min(begin, width), min(end, width)
        for at in range(0, len(i), 1 << 16) if begin < end else ():
            part = slice(at, at + (1 << 16))
            sums[part] += np.einsum("kd,kd->k", left[i[part], begin:end], right[j[part], begin:end])
        still = sums >= threshold if end == width else sums + rest(left, end)[i] * rest(right, end)[j] >= threshold - ROOM
        i, j, sums = i[still], j[still], sums[still]
    return i, j


def compare(tile: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """What one tile adds: for each vector the linked ones on the other side (copies counted), and the smallest node that
    links inside the tile lead to. Whole groups of near copies thus leave a tile as one row per vector, not as pairs."""
    sides = [tile[tile.side == s] for s in (0, 1)]
    alone = sides[1].empty
    rows = sides[0] if alone else pd.concat(sides)
    z, copies, nodes = np.stack(rows.z.to_numpy()), rows.copies.to_numpy(np.int64), rows.node.to_numpy(np.int64)
    cut = len(rows) if alone else len(sides[0])
    i, j = linked(z[:cut], z if alone else z[cut:], threshold)
    j = j if alone else j + cut
    keep = i < j
    i, j = i[keep], j[keep]
    found = np.bincount(i, copies[j], len(rows)).astype(np.int64) + np.bincount(j, copies[i], len(rows)).astype(np.int64)
    root = nodes.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    some = found > 0
    return pd.DataFrame({"label": rows.label[some], "node": nodes[some], "key": rows.key[some], "found": found[some], "root": root[some]})


def tiles(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tile, side, label, x0, x1, block): every block with itself, with the later blocks of its cell, and with all blocks
    of the neighbour cells that come after. Only block numbers meet here, not vectors."""
    near = cells.select("label", "x0", "x1", F.explode(F.expr("array(struct(0 AS d0, 0 AS d1), struct(0 AS d0, 1 AS d1), struct(1 AS d0, -1 AS d1), struct(1 AS d0, 0 AS d1), struct(1 AS d0, 1 AS d1))")).alias("d")).select("label", "x0", "x1", (F.col("x0") + F.col("d.d0")).alias("y0"), (F.col("x1") + F.col("d.d1")).alias("y1"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = near.alias("n").join(a, F.expr("n.label = a.label AND n.x0 = a.x0 AND n.x1 = a.x1")).join(b, F.expr("n.label = b.label AND n.y0 = b.x0 AND n.y1 = b.x1"))
    pairs = pairs.where("a.x0 <> b.x0 OR a.x1 <> b.x1 OR a.block <= b.block")
    key = "concat_ws(',', a.label, a.x0, a.x1, a.block, b.x0, b.x1, b.block)"
    same = "a.x0 = b.x0 AND a.x1 = b.x1 AND a.block = b.block"
    side = lambda c, s: f"struct({s} AS side, {c}.label AS label, {c}.x0 AS x0, {c}.x1 AS x1, {c}.block AS block)"
    return pairs.select(F.expr(key).alias("tile"), F.explode(F.expr(f"CASE WHEN {same} THEN array({side('a', 0)}) ELSE array({side('a', 0)}, {side('b', 1)}) END")).alias("s")).select("tile", "s.*")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows with the same label and a cosine of at least threshold),
    component_id (the smallest id that links lead to) and kept (it is its own component's).

    Null vectors and labels, empty and zero vectors, and those with null or non-finite components link with nothing;
    vectors of different length don't either. Equal vectors are compared once, and count as often as they occur. Rows that
    share an id count as one in components. A vector that occurs only under null ids is compared with its equals alone and
    has no component. An empty table gives no rows; other columns aren't read. The cosine is in double precision."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    distinct = usable(rows)
    widths = [r["w"] for r in distinct.select(F.size("embedding").alias("w")).distinct().limit(65).collect()]
    if len(widths) > 64:
        raise ValueError("more than 64 lengths of vectors in one table")
    known = written(distinct)
    parts = [written(turned(known.where(F.size("embedding") == w).where("node IS NOT NULL"), w, threshold).withColumn("width", F.lit(w))) for w in widths]
    links, edges = None, None
    for part in parts:
        sizes = part.groupBy("label", "x0", "x1").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("n"))
        blocks = sizes.select("label", "x0", "x1", F.explode(F.expr("sequence(0, n - 1)")).alias("block"))
        dealt = part.join(dealt_afresh(sizes, "x0"), ["label", "x0", "x1"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        in_tiles = dealt.join(tiles(sizes.select("label", "x0", "x1"), blocks), ["label", "x0", "x1", "block"]).select("tile", "side", "label", "node", "copies", "key", "z")
        kind = dict(part.dtypes)["label"]
        found = written(in_tiles.groupBy("tile").applyInPandas(lambda t: compare(t, threshold), f"label {kind}, node long, key long, found long, root long"))
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = links.groupBy("label", "node", "key").agg(F.sum("found").alias("found"))
    per_vector = known.join(counts, ["label", "node", "key"], "left").select("label", "embedding", "node", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = written(rows.join(per_vector, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node"))
    edges = links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found.where("vec_id <> node").select("vec_id", "node"))
    tied = components(edges)
    named = tied.select(F.col("node").alias("vec_id"), "component")
    out = found.join(named, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
