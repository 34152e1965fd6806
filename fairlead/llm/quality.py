"""Quality rules whose thresholds follow the data: quantile sketches per language and source, then a joined filter.

A measure's sketch is a table of counts by bin. Values are whole thousandths; a bin keeps their seven leading binary
digits, so that a quantile is off by less than 1/64 of itself. Sketches merge by adding counts: exactly, in any order,
and upwards, from sources to languages to everything, which is what serves groups too small for thresholds of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.shared import SPACES, written

DIGITS = 7
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails documents whose measure lies beyond the median by more than `times` the distance from the median to the outer
    quartile of their group, plus `slack` thousandths, which is what counts as a difference where there is no spread."""

    measure: str
    above: bool
    times: float
    slack: int


RULES = [
    Rule("word_length", True, 8.0, 1000), Rule("word_length", False, 8.0, 1000),
    Rule("symbols", True, 8.0, 150), Rule("dup_lines", True, 8.0, 400), Rule("repeats", True, 8.0, 250),
]
MEASURES = ["word_length", "symbols", "dup_lines", "repeats"]


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(raw, F.lit(SPACES))
    base = docs.select(*keep, raw.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"), F.filter(F.split(raw, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    hashed = base.withColumn("_hashes", F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))))
    at = ", ".join(f"_hashes[i + {k}]" for k in range(WINDOW))
    windows = hashed.withColumn("_windows", F.expr(f"CASE WHEN _hashes IS NOT NULL THEN transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({at})) END"))
    return windows.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words().alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
    )


def repeated_words() -> Column:
    """Words that lie in a window found twice or more. Only texts with a repeated window go beyond the first test: their
    windows are sorted with their places, those next to an equal one are taken, and the places put in order again; then
    each place covers what reaches beyond the one before, at most a window."""
    return F.expr(f"""
        CASE WHEN _windows IS NULL OR size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE aggregate(
            array_sort(transform(filter({SORTED}, x -> x.twice), x -> x.place)),
            struct(0L AS covered, 0L AS reached),
            (a, p) -> struct(a.covered + p + {WINDOW}L - greatest(a.reached, CAST(p AS BIGINT)) AS covered, p + {WINDOW}L AS reached),
            a -> a.covered) END""")


#: Windows in order of their hash, each with whether a neighbour is equal. The inner array is bound once by a one-element
#: transform, so that it isn't sorted again for every place.
SORTED = """flatten(transform(
    array(sort_array(transform(_windows, (w, i) -> struct(w AS w, i AS place)))),
    s -> transform(s, (x, i) -> struct(x.place AS place, (i > 0 AND s[greatest(i - 1, 0)].w = x.w) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].w = x.w) AS twice))))"""


def with_values(rows: DataFrame) -> DataFrame:
    """The measures in whole thousandths: of a word, or of the lines."""
    share = lambda part, whole: F.expr(f"CASE WHEN {whole} > 0 THEN 1000 * {part} DIV {whole} ELSE 0L END")
    return rows.select("*", share("word_chars", "n_words").alias("word_length"), share("n_symbols", "n_words").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"))


def sketches(values: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(level, groups..., measure, bin, held): level 0 by both groups, 1 by the first, 2 over all."""
    wide = F.expr(f"greatest(0, length(bin(value)) - {DIGITS})")
    pairs = values.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("m")).select(*groups, "m.*")
    fine = pairs.withColumn("wide", wide.cast("int")).withColumn("bin", F.expr("shiftleft(shiftright(value, wide), wide)"))
    level0 = fine.groupBy(*groups, "measure", "bin").agg(F.count("*").alias("held"))
    level1 = level0.groupBy(groups[0], "measure", "bin").agg(F.sum("held").alias("held"))
    level2 = level1.groupBy("measure", "bin").agg(F.sum("held").alias("held"))
    nothing = F.lit(None).cast("string")
    return level0.select(F.lit(0).alias("level"), *groups, "measure", "bin", "held").union(level1.select(F.lit(1), groups[0], nothing, "measure", "bin", "held")).union(level2.select(F.lit(2), nothing, nothing, "measure", "bin", "held"))


def thresholds(sketch: DataFrame, rules: list[Rule] = RULES, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(level, groups..., size, low_/high_ per measure) from the quartiles of each sketch; null where no rule is."""
    group = ["level", *groups, "measure"]
    upto, whole = Window.partitionBy(*group).orderBy("bin"), Window.partitionBy(*group)
    ranked = sketch.withColumn("upto", F.sum("held").over(upto)).withColumn("size", F.sum("held").over(whole))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("size") * q, F.col("bin")))
    known = ranked.groupBy(*group).agg(F.max("size").alias("size"), *[quartile(q).alias(f"q{q}") for q in (1, 2, 3)])

    def limit(rule: Rule) -> Column:
        edge = F.col("q2") + rule.times * (F.col("q3") - F.col("q2")) + rule.slack if rule.above else F.col("q2") - rule.times * (F.col("q2") - F.col("q1")) - rule.slack
        return F.max(F.when(F.col("measure") == rule.measure, edge)).alias(f"{'high' if rule.above else 'low'}_{rule.measure}")

    return known.groupBy("level", *groups).agg(F.max("size").alias("size"), *[limit(r) for r in rules])


def filtered(docs: DataFrame, rules: list[Rule] = RULES, own: int = 300, groups: tuple[str, str] = ("lang", "source"), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts of `measured`, base_failed (under 20 words, or over 30 % of them in
    repeated windows) and kept: not base_failed, and inside the thresholds of its language and source; groups of fewer
    than `own` documents take their language's, and those of a small language the ones over all.

    Sketches are made of the documents that pass the base. Null and empty texts have no words, so they fail it. Null
    languages and sources are groups of their own. Repeated rows stay and count as often as they occur; an empty table
    gives no rows; other columns aren't read. The counts are written once, so that texts are read once."""
    slim = docs.select(F.col(id).alias("doc_id"), *groups, F.col(text).alias("text"))
    rows = written(measured(slim, ("doc_id", *groups)))
    base = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    values = with_values(base)
    limits = thresholds(sketches(values.where(~F.col("base_failed")), groups), rules, groups)
    bounds = [f"{'high' if r.above else 'low'}_{r.measure}" for r in rules]
    take = lambda level, keys: limits.where(F.col("level") == level).where(F.col("size") >= (own if level < 2 else 0)).select(*[F.col(k).alias(f"_{k}{level}") for k in keys], F.struct(*bounds).alias(f"_at{level}"))
    a, b = groups
    joined = values.join(take(0, groups), F.col(a).eqNullSafe(F.col(f"_{a}0")) & F.col(b).eqNullSafe(F.col(f"_{b}0")), "left")
    joined = joined.join(take(1, groups[:1]), F.col(a).eqNullSafe(F.col(f"_{a}1")), "left").withColumn("_all", F.lit(2)).join(limits.where("level = 2").select(F.col("level").alias("_all"), F.struct(*bounds).alias("_at2")), "_all", "left")
    joined = joined.withColumn("_at", F.coalesce("_at0", "_at1", "_at2"))
    inside = F.lit(True)
    for rule, bound in zip(rules, bounds, strict=True):
        inside = inside & (F.col(rule.measure) <= F.col("_at")[bound] if rule.above else F.col(rule.measure) >= F.col("_at")[bound])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
