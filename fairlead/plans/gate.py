"""Gate queries: every listing as a feed item of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import Bindings
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.operators import gate as G
from fairlead.operators.profiles import compile_filter_config
from fairlead.plans.registry import query
from fairlead.rules import gate_rules as gr
from fairlead.session import written

# One user's terms; the listings of the bound tables hold some of each kind.
TERMS = G.ProfileTerms(
    disciplines=["research", "beta", "epsilon", "oceanography"],
    regions=["Germany", "International", "Iberia"],
    degrees=["Masters", "PhD"],
    hard_drop=["self-funded", "rolling admission only"],
    extra_type_terms=["monthly stipend", "workshop", "doctoral position", "fellowship"],
)


LANE_COLUMNS = ("source_id", "listing_id", "pos", "verdict")


def items(b: Bindings) -> DataFrame:
    """Listings with the regions of their source. These are written first: Spark then knows that they are few and leaves
    the texts where they were read, whereas dealt out by source a task would judge all texts of a source."""
    src = written(b.sources.select(F.col("id").alias("source_id"), F.col("regions").alias("source_regions")))
    return b.listings.select("listing_id", "source_id", F.col("listing_id").alias("pos"), "url", "title", "summary").join(
        src, "source_id", "left")


def decisions(b: Bindings) -> DataFrame:
    return G.evaluate(items(b), TERMS)


def _sig(name: str):
    s = F.col(name)
    return [s["matched"].alias("matched"), F.round(s["strength"], 4).alias("strength"),
            T.joined(s["evidence"]).alias("evidence"), s["found_in"].alias("found_in")]


@query("g01_candidates")
def g01(b: Bindings):
    return G.candidates(items(b)).select("listing_id", F.md5("n_title").alias("title_md5"), "n_url", F.md5("n_summary").alias("summary_md5"),
                                         F.md5("blob").alias("blob_md5"), F.col("text_length").cast("bigint").alias("text_length"))


@query("g02_scan_signal")
def g02(b: Bindings):
    return G.candidates(items(b)).withColumn("s", G.scan_signal(gr.FUNDING_LEXICON)).select("listing_id", *_sig("s"))


def _one(name: str, column: str):
    @query(name)
    def run(b: Bindings):
        return decisions(b).select("listing_id", *_sig(column))

    return run


_one("g04_funding_signal", "funding")
_one("g05_application_signal", "application")
_one("g06_discipline_signal", "discipline")
_one("g06_degree_signal", "degree")
_one("g07_region_signal", "region")
_one("g08_negative_signal", "negative")
_one("g09_editorial_signal", "editorial")


@query("g03_type_signal")
def g03(b: Bindings):
    return decisions(b).select("listing_id", "type_label", *_sig("opportunity_type"))


@query("g10_looks_like_single")
def g10(b: Bindings):
    return b.listings.select("listing_id", G.looks_like_single(T.normalize_text("title")).alias("single"))


@query("g11_sufficiency")
def g11(b: Bindings):
    c = G.candidates(items(b))
    return c.select("listing_id", F.round(G.sufficiency(F.col("listing_id") % 10 == 0, F.col("text_length")), 4).alias("sufficiency"))


@query("g12_gate_score")
def g12(b: Bindings):
    return decisions(b).select("listing_id", *[F.round(c, 4).alias(c) for c in ("corpus_score", "fit_score", "score")])


@query("g13_gate_verdict")
def g13(b: Bindings):
    return decisions(b).select("listing_id", "verdict", "reason")


@query("g14_explain")
def g14(b: Bindings):
    return decisions(b).select("listing_id", T.joined(G.evidence_summary()).alias("evidence"),
                               T.joined(G.matched_signals()).alias("matched"), G.explain().alias("explanation"))


@query("g15_triage")
def g15(b: Bindings):
    return G.triage(decisions(b).select(*LANE_COLUMNS), max_items=40, budget=5).select("source_id", "listing_id", "verdict", "lane")


def details(b: Bindings) -> DataFrame:
    """Landed detail text of each listing: its document."""
    return b.documents.select(
        F.col("doc_id").alias("listing_id"), F.lit("").alias("detail_title"),
        F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit(" Fellowship. Apply now, closing date 1 May.")).otherwise("")).alias("detail_summary"))


@query("g15_triage_all")
def g15_all(b: Bindings):
    return G.triage(decisions(b).select(*LANE_COLUMNS), budget=5).select("source_id", "listing_id", "verdict", "lane")


@query("g16_rescore_with_detail")
def g16(b: Bindings):
    lanes = G.triage(decisions(b).select(*LANE_COLUMNS, "url", "title", "summary", "source_regions"))
    queue = lanes.filter(F.col("lane").isin("admitted", "investigate"))
    return G.rescore_with_detail(queue, details(b), TERMS).select(
        "listing_id", "verdict", "reason", F.round("score", 4).alias("score"), "lane")


@query("g17_pending_queue")
def g17(b: Bindings):
    d = decisions(b).select("source_id", "listing_id", "url", "title", "pos", "verdict")
    old = d.filter(F.col("listing_id") % 3 == 0)
    deferred = G.with_verdict(d, "investigate")
    done = d.filter(F.col("listing_id") % 7 == 0)
    return G.pending_queue(old, deferred, done, cap=20).select("source_id", "url")


@query("g18_profile_terms")
def g18(b: Bindings):
    t = G.profile_terms(compile_filter_config(_docs(b)))
    return t.select("user_id", *[T.joined(c).alias(c) for c in ("disciplines", "regions", "degrees", "hard_drop", "extra_type_terms")])


@query("g19_merge_envelopes")
def g19(b: Bindings):
    return G.merge_envelopes(compile_filter_config(_docs(b)))


def _docs(b: Bindings):
    from fairlead.plans.profiles import documents

    return documents(b)


@query("g20_verdict_report")
def g20(b: Bindings):
    return G.verdict_report(decisions(b))


@query("g21_low_fit_admitted")
def g21(b: Bindings):
    return decisions(b).select("listing_id", G.low_fit_admitted().alias("low_fit"))


@query("u05_noisy_or_grouped")
def u05(b: Bindings):
    """Grouped noisy-OR: probability that any listing of a source is a hit, in log space."""
    d = decisions(b).select("source_id", F.least(F.col("score"), F.lit(0.999)).alias("s"))
    return d.groupBy("source_id").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("s")))), 4).alias("any_hit"))
