"""Merkle manifest of a table: a tree of hashes per group, one above the groups' roots, and a proof for every row.

Rows get their places in a group from a range sort and the sizes of its parts, so no group is ever in one task. Levels
are made by grouping runs of `fan_out` nodes. Proofs come from pointer jumping: every node above the leaves points to its
parent and holds the segment of siblings there; joining the pointers with themselves doubles the distance and appends
the segments, until all point to the root. Leaves take their run's path in one last jump, run by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.shared import emptied, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node's siblings in its run, as hex text: those before it and those after it.
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def key(level: int | Column, at: Column, tree: Column) -> Column:
    return F.concat_ws(":", F.lit(level) if isinstance(level, int) else level, at, tree)


def placed(leaves: DataFrame) -> DataFrame:
    """leaves with `at`, the place in its tree by (id, leaf) from 0, and `size`, the number of the tree's leaves. Parts of
    a range sort are numbered by themselves; the leaves of a tree that lie in parts before are added."""
    parts = leaves.repartitionByRange("tree", "id", "leaf").sortWithinPartitions("tree", "id", "leaf")
    parts = written(parts.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = parts.groupBy("tree", "part").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    of_tree = Window.partitionBy("tree")
    sizes = sizes.select("tree", "part", "first", F.sum("n").over(of_tree).alias("size"), F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.join(sizes, ["tree", "part"]).withColumn("at", F.col("before") + F.col("line") - F.col("first")).drop("part", "line", "first", "before")


def runs_of(nodes: DataFrame, fan_out: int, *more: str) -> DataFrame:
    """One row per run of consecutive nodes (tree, at, hash, size): its place, the nodes in order, and its hash. A tree's
    only node is a run too, and stays as it is."""
    runs = nodes.groupBy("tree", F.expr(f"at div {fan_out}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "hash", *more))).alias("kids"), F.max("size").alias("size"))
    joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    return runs.withColumn("up", F.when(F.col("size") == 1, F.col("kids")[0]["hash"]).otherwise(F.sha2(joined, 256)))


def siblings(place: Column) -> Column:
    """The segment of the kid at this place of its run."""
    text = lambda part: F.array_join(F.transform(part, lambda k: k["hash"]), "")
    return F.array(F.struct(text(F.slice("kids", F.lit(1), place)).alias("left"), text(F.slice("kids", place + 2, F.size("kids"))).alias("right")))


def climbed(nodes: DataFrame, level: int, size: int, fan_out: int) -> tuple[DataFrame, DataFrame | None]:
    """From nodes (tree, at, hash, size, key) of trees of at most `size` nodes up to one node per tree (tree, hash, key);
    and the pointers met on the way: (key, up, path) to the parents."""
    links = None
    while size > 1:
        runs = written(runs_of(nodes, fan_out, "key").withColumn("own", F.when(F.col("size") == 1, F.col("kids")[0]["key"]).otherwise(key(level + 1, F.col("run"), F.col("tree")))))
        found = runs.where("size > 1").select("own", "kids", F.posexplode("kids").alias("place", "kid")).select(F.col("kid.key").alias("key"), F.col("own").alias("up"), siblings(F.col("place")).alias("path"))
        links = found if links is None else links.union(found)
        nodes = runs.select("tree", F.col("run").alias("at"), F.col("up").alias("hash"), F.expr(f"(size + {fan_out - 1}) div {fan_out}").alias("size"), F.col("own").alias("key"))
        level, size = level + 1, -(-size // fan_out)
    return nodes.select("tree", "hash", "key"), links


def height(size: int, fan_out: int) -> int:
    levels = 0
    while size > 1:
        levels, size = levels + 1, -(-size // fan_out)
    return levels


def jumped(links: DataFrame, distance: int) -> DataFrame:
    """Pointers to the end of every way, at most `distance` steps off, each with the segments of the whole way: every
    round doubles what a pointer spans. A target has one row, so that targets of very many pointers can be split."""
    found, spans = written(links), 1
    while spans < distance:
        there = found.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("path").alias("rest"))
        before, found = found, written(found.join(there, "up", "left").select("key", F.coalesce("next", "up").alias("up"), F.concat("path", F.coalesce("rest", F.array().cast(PATH))).alias("path")))
        emptied(before)
        spans *= 2
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash and a path of siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", fan_out: int = 16, every: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the hash of the columns. The leaves of a group stand by id; every fan_out of them become one node, and so on
    up to the group's subroot; subroots, by group, lead to the root in the same way. folded_root is recomputed from the
    leaf and its siblings; where `every` divides the id's crc32, from a leaf whose text has lost its capitals.

    Nulls: a null column is marked in its leaf, null groups are one group (the first), null ids come first in their group
    and are never tampered with. Equal ids stand by leaf; repeated rows are leaves of their own with equal neighbours.
    Empty and very long texts are hashed whole. An empty table gives no rows. Columns not named are never read."""
    fields = lambda lower: [field(F.translate(c, UPPER, LOWER) if lower and c == text else F.col(c)) for c in columns]
    hit = F.coalesce(F.crc32(F.col(id).cast("string")) % every == 0, F.lit(False))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = placed(docs.select(F.col(id).alias("id"), tree.alias("tree"), digest(*fields(False)).alias("leaf"), F.when(hit, digest(*fields(True))).alias("tampered")))
    runs = runs_of(leaves.withColumn("hash", F.col("leaf")), fan_out, "id", "tampered")
    runs = written(runs.withColumn("own", key(F.when(F.col("size") == 1, 0).otherwise(1), F.col("run"), F.col("tree"))))

    most = runs.agg(F.max("size")).first()[0]
    if most is None:
        return runs.selectExpr("kids[0].id AS doc_id", "up AS leaf", "up AS subroot", "up AS root", "up AS proof_sha256", "up AS folded_root", "true AS verified")
    most = max(1, -(-most // fan_out))
    nodes = runs.select("tree", F.col("run").alias("at"), F.col("up").alias("hash"), F.expr(f"(size + {fan_out - 1}) div {fan_out}").alias("size"), F.col("own").alias("key"))
    subroots, links = climbed(nodes, 1, most, fan_out)
    subroots = written(subroots)
    groups = subroots.count()
    top = placed(subroots.select(F.lit("*").alias("tree"), F.col("tree").alias("id"), F.col("hash").alias("leaf"), "key"))
    root, above = climbed(top.select("tree", "at", F.col("leaf").alias("hash"), "size", "key"), 0, groups, fan_out)
    root = root.first()["hash"]

    ways = [x for x in (links, above) if x is not None]
    none = F.array().cast(PATH)
    if ways:
        way = jumped(ways[0].union(ways[1]) if len(ways) > 1 else ways[0], height(most, fan_out) + height(groups, fan_out))
        runs = runs.join(way.select(F.col("key").alias("own"), F.col("path").alias("way")), "own", "left").withColumn("path", F.coalesce("way", none))
    else:
        runs = runs.withColumn("path", none)
    each = runs.join(subroots.select("tree", F.col("hash").alias("subroot")), "tree").select("subroot", "path", "kids", "size", F.posexplode("kids").alias("place", "kid"))
    each = each.select("subroot", "kid", F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(siblings(F.col("place")), "path")).alias("path"))
    shown = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    told = each.select(F.col("kid.id").alias("doc_id"), F.col("kid.hash").alias("leaf"), "subroot", F.lit(root).alias("root"), shown.alias("proof_sha256"), folded(F.coalesce("kid.tampered", "kid.hash"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
