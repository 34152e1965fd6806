"""Scores, vectors and lookups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.rules import fact_rules as fr

def zero() -> Column:
    return F.lit(0.0)


def one() -> Column:
    return F.lit(1.0)


def clamp(x: Column) -> Column:
    return F.greatest(zero(), F.least(one(), x))


def noisy_or(parts: list[Column]) -> Column:
    product = one()
    for p in parts:
        product = product * (one() - clamp(p))
    return one() - product


def fit_level(score: Column, hard_failed: Column) -> Column:
    return (F.when(hard_failed & (score >= fr.MODERATE_FIT), "moderate").when(hard_failed, "weak")
            .when(score >= fr.STRONG_FIT, "strong").when(score >= fr.MODERATE_FIT, "moderate").otherwise("weak"))


def dot(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero(), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 for missing, empty, unequal or zero vectors. Norms may be carried along as columns."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.coalesce(F.when(usable, dot(a, b) / (na * nb)), zero())


def calibrate(raw: Column, provider: str | Column = "default") -> Column:
    """Rescale a raw cosine by the band of the model that made it."""
    name = F.lit(provider) if isinstance(provider, str) else F.lower(F.coalesce(provider, F.lit("default")))
    low, high = F.lit(fr.COSINE_BANDS["default"][0]), F.lit(fr.COSINE_BANDS["default"][1])
    for key, (lo, hi) in fr.COSINE_BANDS.items():
        low = F.when(name == key, F.lit(lo)).otherwise(low)
        high = F.when(name == key, F.lit(hi)).otherwise(high)
    return clamp((raw - low) / (high - low))


def composite(parts: dict[str, tuple[Column, Column]]) -> Column:
    """Weighted mean over the available components only."""
    top, bottom = zero(), zero()
    for name, (score, available) in parts.items():
        w = F.lit(fr.COMPONENT_WEIGHTS[name])
        top = top + F.when(available, w * score).otherwise(zero())
        bottom = bottom + F.when(available, w).otherwise(zero())
    return F.when(bottom == 0, zero()).otherwise(top / bottom)


def applied_weights(available: dict[str, Column]) -> Column:
    """Map of component to weight, of those that are available."""
    entries = F.array(*[F.when(on, F.struct(F.lit(name).alias("key"), F.lit(fr.COMPONENT_WEIGHTS[name]).alias("value"))) for name, on in available.items()])
    return F.map_from_entries(F.array_compact(entries))


def status_base(status: Column) -> Column:
    out = F.lit(0.5)
    for name, value in fr.STATUS_SIGNAL.items():
        out = F.when(status == name, F.lit(value)).otherwise(out)
    return out


def positive_weight(status: Column) -> Column:
    return F.when(status == "saved", 0.6).when(status.isin("in_progress", "applied"), 1.0).otherwise(0.0)


def negative_weight(status: Column, dismiss_reason: Column) -> Column:
    return (F.when(status == "archived", 0.5)
            .when((status == "dismissed") & (F.coalesce(dismiss_reason, F.lit("")) != ""), 0.85)
            .when(status == "dismissed", 0.5).otherwise(0.0))


def trust_state(status: Column) -> Column:
    return (F.when(status == "primary_confirmed", "verified").when(status == "aggregator_only", "aggregator_only")
            .when(status == "stale", "conflict").otherwise("unchecked"))


def lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
