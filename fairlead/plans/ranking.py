"""Ranking queries over all users and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.functions import scoring as S
from fairlead.functions import text as T
from fairlead.functions.matching import add_phrase_hits
from fairlead.operators import ranking as R
from fairlead.operators.feed import response_view
from fairlead.plans.registry import query


def now():
    return F.lit(AS_OF).cast("timestamp")


def r4(c, digits: int = 4):
    """Rounded for comparison across engines; the nudge keeps exact decimal ties on one side."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def interaction_scores(b: Bindings):
    """Scores of the pairs that users have reacted to."""
    pairs = b.feedback.select("user_id", "listing_id", "status")
    side, users = R.prepared(b.listings, b.profiles, b.vectors, pairs)
    return R.score_pairs(pairs, side, users, R.affinity_profile(b.feedback, b.listings), now())


@query("r01_cosine")
def r01(b: Bindings):
    pairs = b.feedback.select("user_id", "listing_id")
    u = R.attach_vectors(pairs, b.vectors, "user_id", "user_vec")
    p = R.attach_vectors(u, b.vectors, "listing_id", "vec")
    c = S.cosine(F.col("user_vec"), F.col("vec"), F.col("user_vec_norm"), F.col("vec_norm"))
    return p.select("user_id", "listing_id", F.round(c, 4).alias("cosine"))


@query("r02_calibrate")
def r02(b: Bindings):
    provider = F.element_at(T.str_array(["default", "openai", "gemini", "fastembed"]), (F.col("listing_id") % 4 + 1).cast("int"))
    return b.feedback.select("user_id", "listing_id", F.round(S.calibrate(F.col("fit_score"), provider), 4).alias("calibrated"))


@query("r03_lexical_similarity")
def r03(b: Bindings):
    users = R.user_side(b.profiles)
    side = R.with_hits(R.listing_side(b.listings), users).select("listing_id", "tf")
    p = b.feedback.select("user_id", "listing_id").join(side, "listing_id").join(users.select("user_id", "profile_tokens"), "user_id")
    return p.select("user_id", "listing_id", F.round(R.lexical_similarity(F.col("profile_tokens"), F.col("tf")), 4).alias("lexical"))


@query("r04_semantic_score")
def r04(b: Bindings):
    return interaction_scores(b).select("user_id", "listing_id", F.round("sem.score", 4).alias("score"), F.round("sem.raw", 4).alias("raw"),
                                        F.col("sem.method").alias("method"), F.col("sem.available").alias("available"))


@query("r05_evaluate_eligibility")
def r05(b: Bindings):
    r = interaction_scores(b)
    return r.select("user_id", "listing_id", "elig_score", "hard_failed",
                    T.joined(F.transform("elig_reasons", lambda x: x["code"])).alias("codes"),
                    T.joined(F.transform("elig_reasons", lambda x: x["label"])).alias("labels"))


@query("r06_opportunity_degrees")
def r06(b: Bindings):
    return R.listing_side(b.listings).select("listing_id", T.joined(F.col("opp_degrees")).alias("degrees"))


@query("r07_affinity_profile")
def r07(b: Bindings):
    return R.affinity_profile(b.feedback, b.listings).select("user_id", "kind", "key", F.round("pos", 4).alias("pos"), F.round("neg", 4).alias("neg"))


@query("r08_affinity_score")
def r08(b: Bindings):
    keys = b.listings.select("listing_id", R.affinity_keys().alias("aff_keys"))
    pairs = b.feedback.select("user_id", "listing_id", "status").join(keys, "listing_id")
    return R.affinity_score(pairs, R.affinity_profile(b.feedback, b.listings)).select(
        "user_id", "listing_id", r4("affinity").alias("affinity"))


@query("r05_large_vocabulary")
def r05_large(b: Bindings):
    """Hits of some thousand phrases, taken from the texts themselves: six per document, whole or cut inside a word."""
    texts = b.documents.select("doc_id", F.lower("text").alias("t"))
    words = F.split("t", " ")
    pair = lambda k: F.concat_ws(" ", F.get(words, k * 7), F.get(words, k * 7 + 1))
    cut = lambda k: F.when(k % 2 == 0, pair(k)).otherwise(F.substring(pair(k), 2, 200))
    phrases = texts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), cut)).alias("term")).filter(F.trim("term") != "").distinct()
    found = add_phrase_hits(texts, "doc_id", {"hits": "t"}, phrases)
    return found.select("doc_id", F.size("hits").cast("bigint").alias("n_hits"), F.md5(F.array_join("hits", "|")).alias("hits_md5"))


@query("r05_shared_word")
def r05_shared(b: Bindings):
    """Hits of up to five thousand phrases that share their longest word, in texts that all hold it."""
    named = F.concat(F.lit("university of town"), (F.col("doc_id") % 5000).cast("string"))
    texts = b.documents.select("doc_id", F.lower(F.concat(named, F.lit(" "), F.col("text"))).alias("t"))
    found = add_phrase_hits(texts, "doc_id", {"hits": "t"}, b.documents.select(named.alias("term")).distinct())
    return found.select("doc_id", F.array_join("hits", "|").alias("hits"))


def weights_text(weights):
    return T.joined(F.transform(F.map_entries(weights), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 2).cast("string"))))


@query("r09_composite")
def r09(b: Bindings):
    parts = {"semantic": (F.col("semantic"), F.col("has_semantic")), "eligibility": (F.col("eligibility"), F.lit(True)),
             "urgency": (F.col("urgency"), F.col("has_urgency")), "affinity": (F.col("fit_score"), ~F.col("hide_percent"))}
    return b.feedback.select("user_id", "listing_id", r4(S.composite(parts)).alias("composite"),
                             weights_text(S.applied_weights({name: on for name, (_, on) in parts.items()})).alias("weights"))


@query("r10_fit_reasons")
def r10(b: Bindings):
    r = R.fit_reasons(interaction_scores(b))
    return r.select("user_id", "listing_id", T.joined(F.transform("reasons", lambda x: x["code"])).alias("codes"), "fit_explanation", "hide_percent",
                    T.joined(F.col("evidence")).alias("evidence"))


@query("r11_score_breakdown")
def r11(b: Bindings):
    s = R.fit_reasons(interaction_scores(b)).select("user_id", "listing_id", "composite", R.score_breakdown().alias("s"))
    return s.select("user_id", "listing_id", *[F.col("s." + c).alias(c) for c in (
        "semantic", "semantic_method", "eligibility", "urgency", "affinity", "hard_eligibility_failed")], r4("composite").alias("composite"),
        T.joined(F.col("s.components_available")).alias("components"), weights_text(F.col("s.weights_applied")).alias("weights"))


@query("r12_rank_for_users")
def r12(b: Bindings):
    r = R.rank_for_users(b.listings, b.profiles, b.vectors, b.feedback, now())
    return r.select("user_id", "listing_id", "rank_position", r4("composite", 3).alias("fit_score"), "fit_level")


@query("r13_expired_rows")
def r13(b: Bindings):
    return R.expired_rows(b.listings, b.profiles, now())


@query("r14_recompute_affinity")
def r14(b: Bindings):
    changed = b.feedback.filter(F.col("status").isin("saved", "dismissed")).select("user_id", "listing_id")
    return R.recompute_affinity(b.feedback, changed, b.listings).select(
        "user_id", "listing_id", r4("affinity").alias("affinity"), r4("composite").alias("composite"), "new_level")


@query("r15_response_view")
def r15(b: Bindings):
    rows = b.feedback.join(b.listings.drop("created_at"), "listing_id")
    return response_view(rows, now()).select(
        "user_id", "listing_id", "fit_percent", "fit_explanation", "trust_state", "trust_label", "days_until_deadline", "urgency_label", "deadline_bucket")


@query("r16_rerank_all")
def r16(b: Bindings):
    """Ranked and expired rows of all users together: what a full re-rank writes, counted per user and level."""
    ranked = R.rank_for_users(b.listings, b.profiles, b.vectors, b.feedback, now()).select("user_id", "fit_level", "rank_position")
    gone = R.expired_rows(b.listings, b.profiles, now()).select("user_id", "fit_level", "rank_position")
    return ranked.unionByName(gone).groupBy("user_id", "fit_level").agg(
        F.count("*").alias("n"), F.count("rank_position").alias("ranked"), F.max("rank_position").alias("last_rank"))
