"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0 .. 1. Its integral says how many of the source's words are due by
a time; its inverse gives each document, by where its words lie in the source's own order, the time at which it is due.
Sorting by that time mixes the sources: in proportion to their schedules at every moment, and to their targets over all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.shared import WORD

#: Fixed values of the registered query: weights of the sources in order, in turn; words taken as a share of all; and
#: how often a source may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


@dataclass(frozen=True)
class Schedule:
    """Weights at points of time, linear in between; times run from 0 to 1. Only their proportions count."""

    points: tuple[tuple[float, float], ...]

    def knots(self) -> list[tuple[float, float, float, float]]:
        """(area before, time, weight, slope) of each piece, with a whole area of 1."""
        pieces = [(t, w, (v - w) / (u - t), (v + w) / 2 * (u - t)) for (t, w), (u, v) in zip(self.points, self.points[1:])]
        whole, area, out = sum(p[3] for p in pieces), 0.0, []
        for t, w, slope, part in pieces:
            out.append((area / whole, t, w / whole, slope / whole))
            area += part
        return out


#: Falling, even and rising, in turn: sources of the first kind come early, of the last late.
SCHEDULES = (Schedule(((0.0, 1.5), (1.0, 0.5))), Schedule(((0.0, 1.0), (1.0, 1.0))), Schedule(((0.0, 0.5), (1.0, 1.5))))


def inverse(share: Column, turn: Column, schedules: tuple[Schedule, ...] = SCHEDULES) -> Column:
    """The time by which this share of a source's words is due: in the piece where it falls, area + w x + slope x x / 2
    solved for x, in the form that needs no division by the slope."""
    pieces = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("area", "time", "weight", "slope"), k, strict=True)]) for k in s.knots()]) for s in schedules])
    piece = F.array_max(F.filter(F.get(pieces, turn), lambda k: k["area"] <= share))
    over = share - piece["area"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["weight"] * piece["weight"] + 2 * piece["slope"] * over))
    return F.least(F.lit(1.0), piece["time"] + F.when(over > 0, 2 * over / (piece["weight"] + root)).otherwise(0.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, turn, source_size, target) from (source, source_size). Targets are in proportion to the weights, up to
    `most` times a source's size; what is cut off goes to the others by weight. That is min(limit, level * weight) for
    one level: with sources by limit / weight, it is the largest of the levels at which the first k are at their limits.
    The windows run over one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("turn", (F.row_number().over(ordered) - 1).cast("int"))
    weighed = numbered.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") % len(weights))).withColumn("limit", F.col("source_size") * float(most))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("limit") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    full = weighed.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = full.withColumn("level", (F.sum("source_size").over(everything) * share - F.col("used")) / F.col("left"))
    level = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(everything)
    return levels.withColumn("_level", level).select("source", "turn", "source_size", F.least(F.col("limit"), F.col("_level") * F.col("weight")).alias("target"))


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The kept columns and size, the number of words."""
    return docs.select(*keep, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def placed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, size, turn, source_size, target, middle (where the middle of the document's
    words lies in its source) and passes (how often it is taken).

    Equal rows are counted before they are dealt out. Sums over a source go by buckets of the hash that orders it, so
    that no task orders a whole source."""
    rows = sized(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    counted = counted.withColumn("mixed", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))).withColumn("bucket", F.substring("mixed", 1, 3)).withColumn("words", F.col("size") * F.col("copies"))
    buckets = counted.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"))
    known = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = starts.alias("s").join(known.alias("k"), F.expr("s.source <=> k.source")).select("s.source", "bucket", "start", "turn", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = counted.alias("c").join(starts.alias("s"), F.expr("c.source <=> s.source AND c.bucket = s.bucket")).select("c.*", "start", "turn", "source_size", "target")
    found = found.withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    each = found.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("middle", F.expr("start + copy * size + size / 2D"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - F.col("whole") * F.col("source_size")
    return each.withColumn("whole", whole).withColumn("passes", F.least(F.lit(most).cast("long"), F.col("whole") + (F.col("middle") < left).cast("long"))).select("doc_id", "source", "size", "turn", "source_size", "target", "middle", "passes")


def due(words: Column, schedules: tuple[Schedule, ...]) -> Column:
    """The time at which so many words of a source are due."""
    return F.when(F.col("target") > 0, inverse(F.least(F.lit(1.0), words / F.col("target")), F.col("turn") % len(schedules), schedules))


def mixed(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (of its source, in words), taken (words that the mix takes,
    repeats counted), passes (how often the document is taken) and position (the time at which it is first due, 0 .. 1;
    null if it isn't taken), sorted by position.

    Within a source documents follow a hash of their id. A source is taken whole as often as its target allows; of the
    rest, a document is taken when its middle lies within. So a source's words differ from the target by half a document
    at most, no document is taken more than `most` times, and the same rows give the same mix on every run.

    A null text has size 0, a null source is a source and comes last, null ids are equal ids. Equal rows each get their
    own place; rows with the same id are ordered by size. An empty table gives no rows; other columns aren't read."""
    position = F.when(F.col("passes") > 0, due(F.col("middle"), schedules))
    out = placed(docs, **options).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "source", "size")


def occurrences(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, **options) -> DataFrame:
    """One row for each time that a document is taken: doc_id, source, size, pass (from 0) and position."""
    each = placed(docs, **options).where("passes > 0").withColumn("pass", F.explode(F.expr("sequence(0L, passes - 1)")))
    return each.select("doc_id", "source", "size", "pass", due(F.col("middle") + F.col("pass") * F.col("source_size"), schedules).alias("position"))
