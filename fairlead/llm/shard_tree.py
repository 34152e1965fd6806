"""Sharding by a hierarchical weighted hash tree: region, rack and shard are each drawn by weighted hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Draws are from the 2**52 multiples of 2**-52, shifted by half a step, all of which a double holds.
DRAWS = 1 << 52


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree_of(leaves: list[Leaf]) -> dict[str, list[tuple[str, float]]]:
    """The children of each node with their weights; a node weighs what the shards below it weigh together. Nodes are
    named by their path, so that a draw depends on the node and not on what else there is."""
    found: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        path = ""
        for name in (leaf.region, leaf.rack, str(leaf.shard)):
            child = f"{path}/{name}"
            level = found.setdefault(path, {})
            level[child] = level.get(child, 0.0) + leaf.weight
            path = child
    return {path: sorted(level.items()) for path, level in found.items()}


def default_tree(shards: int) -> list[Leaf]:
    """Two shards to a rack, two racks to a region."""
    return [Leaf(f"region{i // 4}", f"rack{i // 2}", i) for i in range(shards)]


def grown_tree(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, as the only one of a new region. All other nodes keep their weights, hence their
    draws among each other: the only rows that move are those that draw the new region, and they go to its one shard."""
    shard = max((leaf.shard for leaf in leaves), default=-1) + 1
    return [*leaves, Leaf(f"grown{shard}", f"grown{shard}", shard, weight)]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key. On each level every child draws -ln(hash) / weight and the least wins: a child is chosen in
    proportion to its weight, and a changed weight moves keys to or from this child only."""
    tree = {path: level for path, level in tree_of(leaves).items() if level}
    if not tree:
        raise ValueError("a tree needs a shard")
    children = F.create_map(*[c for path, level in tree.items() for c in (F.lit(path), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in level]))])

    def descend(node: Column) -> Column:
        draw = lambda child: -F.log((F.pmod(F.xxhash64(key, child["name"]), F.lit(DRAWS)) + F.lit(0.5)) / F.lit(float(DRAWS))) / child["weight"]
        drawn = F.transform(F.element_at(children, node), lambda child: F.struct(draw(child).alias("draw"), child["name"].alias("name")))
        return F.array_min(drawn)["name"]

    path = F.lit("")
    for _ in range(3):
        path = descend(path)
    return F.element_at(F.split(path, "/"), -1).cast("int")


def numbered(rows: DataFrame, group: str, columns: list[str], buckets: int = 1024) -> DataFrame:
    """rows with `slot`, which counts the rows of each group from 0 without gaps. Equal rows are counted before they are
    dealt out, and unfolded at the end; what remains is dealt to hash buckets, whose sizes are summed up per group, so that
    no task ever orders a whole group."""
    counted = rows.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    sizes = counted.groupBy(group, "bucket").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(group, "bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(starts, [group, "bucket"]).withColumn("first", F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return placed.select(*columns, F.explode(F.expr("sequence(first, first + copies - 1)")).alias("slot"))


def assign(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law `key`, shard, slot (gapless in
    the shard) and grown_shard (where the row is with the tree `grown`, by default one more shard).

    The id alone decides, so rows with the same id share a shard, null ids too. A null text has size 1 and the checksum of
    no bytes. Equal rows get different slots. An empty table gives no rows; other columns aren't read."""
    raw = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(id).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    key = F.col("doc_id")
    placed = slim.withColumn("shard", place(key, leaves)).withColumn("grown_shard", place(key, grown or grown_tree(leaves)))
    out = numbered(placed, "shard", ["doc_id", "size", "text_crc32", "shard", "grown_shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
