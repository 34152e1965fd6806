"""Deadline parsing and day arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.rules import fact_rules as fr
from fairlead.functions.text import any_contains, let

DATE_FORMATS = ["d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy-MM-dd", "MMMM yyyy", "MMM yyyy"]
_NAMED = (rf"(?i)((?:\d{{1,2}}\s+)?(?:{fr.MONTHS})\.?(?:\s+\d{{1,2}})?(?:\s*,)?\s*\d{{4}}"
          r"|\d{4}-\d{2}-\d{2})")


def parse_date(raw: Column) -> Column:
    """Date found inside free text by an ordered list of formats; a missing day reads as the first."""
    flat = F.regexp_replace(raw, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    found = F.regexp_extract(flat, _NAMED, 1)
    tidy = F.trim(F.regexp_replace(F.regexp_replace(found, r"[,.]", " "), r"\s+", " "))
    tidy = F.regexp_replace(tidy, r"(?i)\bsept\b", "Sep")
    tidy = F.when(tidy.rlike("[A-Za-z]"), F.initcap(tidy)).otherwise(tidy)
    return let(tidy, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]))


def _sane(ts: Column) -> Column:
    return let(ts, lambda d: F.when((F.year(d) >= 2020) & (F.year(d) <= 2035), d))


def parse_deadline(text: Column) -> Column:
    """Date after the first cue word that leads to one (deadline, due, apply by, closes)."""
    return F.coalesce(*[parse_date(F.regexp_extract(text, cue, 1)) for cue in fr.DEADLINE_CUES])


def derive_deadline(text: Column) -> Column:
    """struct(deadline, note): cue line, ISO date, inline month date, then a rolling hint anywhere."""
    inline_cue = fr.INLINE_DATE.replace("(?i)", "(?i)(", 1) + ")"

    def by_date(t: Column, line: Column) -> Column:
        dated = F.coalesce(_sane(parse_date(line)), _sane(parse_date(F.regexp_extract(t, f"({fr.ISO_DATE})", 1))),
                           _sane(parse_date(F.regexp_extract(t, inline_cue, 1))))
        return let(dated, lambda d: F.struct(
            d.alias("deadline"),
            F.when(d.isNull() & any_contains(F.lower(t), fr.ROLLING_HINTS), "rolling").alias("note")))

    def by_line(t: Column, line: Column) -> Column:
        return let(F.lower(line), lambda low: F.when(
            (low != "") & any_contains(low, fr.ROLLING_HINTS), _undated("rolling")).when(
            (low != "") & any_contains(low, fr.UNKNOWN_HINTS), _undated("unspecified")).otherwise(by_date(t, line)))

    return let(text, lambda t: let(F.trim(F.regexp_extract(t, fr.DEADLINE_LINE, 1)), lambda line: by_line(t, line)))


def _undated(note: str) -> Column:
    return F.struct(F.lit(None).cast("timestamp").alias("deadline"), F.lit(note).alias("note"))


def _seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def days_until(deadline: Column, as_of: Column) -> Column:
    """Whole days away from now, rounded outwards on both sides of today."""
    s = _seconds_between(deadline, as_of)
    return (F.signum(s) * F.ceil(F.abs(s) / 86400)).cast("bigint")


def floor_days(later: Column, earlier: Column) -> Column:
    return F.floor(_seconds_between(later, earlier) / 86400)


def deadline_bucket(days: Column) -> Column:
    return (F.when(days.isNull(), "unknown").when(days < 0, "overdue").when(days == 0, "today")
            .when(days <= 3, "within_3_days").when(days <= 7, "within_7_days").when(days <= 30, "within_30_days")
            .otherwise("later"))


def urgency_label(days: Column) -> Column:
    weeks = F.floor(days / 7)
    return (F.when(days.isNull(), F.lit(None).cast("string")).when(days < 0, "Expired").when(days == 0, "Due today")
            .when(days == 1, "1 day left").when(days <= 30, F.concat(days.cast("string"), F.lit(" days left")))
            .otherwise(F.concat(weeks.cast("string"), F.when(weeks == 1, " week left").otherwise(" weeks left"))))


def urgency_score(days: Column) -> Column:
    return (F.when(days.isNull() | (days < 0), 0.0).when(days <= 7, 1.0).when(days <= 14, 0.8)
            .when(days <= 30, 0.6).otherwise(0.3))


def deadline_compare(claimed: Column, primary: Column) -> Column:
    """struct(match, similarity, note): day gap by floor then absolute value, tolerance seven days."""
    gap = F.abs(floor_days(claimed, primary))
    g = gap.cast("string")
    both = claimed.isNull() & primary.isNull()
    one = claimed.isNull() | primary.isNull()
    return F.struct(
        F.when(both, True).when(one, False).otherwise(gap <= 7).alias("match"),
        F.when(both, 1.0).when(one, 0.0).when(gap <= 7, 1.0 - F.least(gap / 7.0, F.lit(1.0)) * 0.3)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - gap / 60.0)).alias("similarity"),
        F.when(both, "both_missing").when(one, "one_missing")
        .when(gap <= 7, F.concat(F.lit("within_"), g, F.lit("_days")))
        .otherwise(F.concat(F.lit("delta_"), g, F.lit("_days"))).alias("note"))
