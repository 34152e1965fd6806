"""Relevance gate: evidence signals, score and verdict for every candidate, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import scoring as S
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.operators.synonyms import expand_list
from fairlead.rules import gate_rules as gr
from fairlead.session import cut_lineage

SIGNALS = ("opportunity_type", "funding", "application", "discipline", "degree", "region")


@dataclass
class ProfileTerms:
    """Preferences that raise scores; only hard_drop can reject. Lists are parameters of a run."""

    disciplines: Sequence[str] = field(default_factory=list)
    regions: Sequence[str] = field(default_factory=list)
    degrees: Sequence[str] = field(default_factory=list)
    hard_drop: Sequence[str] = field(default_factory=list)
    extra_type_terms: Sequence[str] = field(default_factory=list)


def has_degree_hint(term: Column) -> Column:
    return T.let(T.normalize_text(term), lambda t: T.any_contains(t, gr.DEGREE_HINTS))


def profile_terms(envelopes: DataFrame) -> DataFrame:
    """Scoring terms of each envelope row: must-match words naming a degree count as degrees."""
    def dedupe(c: Column) -> Column:
        return F.array_distinct(F.filter(c, lambda t: t.isNotNull() & (t != "")))

    must = F.filter("must_match_any", lambda t: t.isNotNull() & (t != ""))
    return envelopes.select(
        "user_id",
        dedupe(F.concat("profile_match_any", "institution_match_any")).alias("disciplines"),
        dedupe(F.col("region_match_any")).alias("regions"),
        dedupe(F.concat("target_degree_levels", F.filter(must, has_degree_hint))).alias("degrees"),
        dedupe(F.col("hard_drop_any")).alias("hard_drop"),
        dedupe(F.filter(must, lambda t: ~has_degree_hint(t))).alias("extra_type_terms"),
    )


def _tagged(key: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(key).alias("key"), t.alias("term")))


def merge_envelopes(envelopes: DataFrame) -> DataFrame:
    """(key, term): positive terms of any user; drop terms (lower case) that every user has."""
    keys = ("must_match_any", "profile_match_any", "region_match_any", "institution_match_any")
    pairs = F.flatten(F.array(*[
        _tagged(k, F.filter(k, lambda t: t != "")) for k in keys]))
    positive = envelopes.select(F.inline(pairs)).distinct()
    drops = envelopes.select(F.explode(F.array_distinct(F.transform(
        F.filter("hard_drop_any", lambda t: t != ""), lambda t: F.lower(t)))).alias("term"))
    counted = drops.groupBy("term").agg(F.count("*").alias("n"))
    users = envelopes.agg(F.count("*").alias("n"))
    shared = counted.join(users, "n", "left_semi").select(F.lit("hard_drop_any").alias("key"), "term")
    return positive.unionByName(shared)


def candidates(items: DataFrame) -> DataFrame:
    """Normalised fields next to the raw ones; an item without a title takes one from its URL."""
    title = F.when(F.coalesce("title", F.lit("")) == "", U.title_from_slug("url")).otherwise(F.col("title"))
    raw = items.withColumn("title", title)
    if "content" not in items.columns:
        raw = raw.withColumn("content", F.lit(""))
    if "detail_fetched" not in items.columns:
        raw = raw.withColumn("detail_fetched", F.lit(False))

    def size_of(c: str) -> Column:
        return F.length(F.coalesce(F.col(c), F.lit("")))

    staged = raw.withColumns({
        "n_title": T.normalize_text("title"),
        "n_url": T.url_words("url"),
        "n_summary": T.normalize_text("summary"),
        "n_content": T.normalize_text("content"),
        "text_length": size_of("title") + size_of("summary") + size_of("content"),
    })
    return staged.withColumns({
        **{"t_" + f: T.gate_tokens(F.col("n_" + f)) for f in gr.FIELD_PRIORITY},
        "headline": F.trim(F.concat("n_title", F.lit(" "), "n_summary")),
        "blob": F.array_join(F.filter(F.array("n_title", "n_summary", "n_content", "n_url"), lambda x: x != ""), " "),
        "raw_blob": F.array_join(F.filter(F.array("title", "summary", "content"),
                                          lambda x: x.isNotNull() & (x != "")), " "),
    })


def _signal(matched: Column, strength: Column, evidence: Column, found_in: Column) -> Column:
    return F.struct(matched.alias("matched"), strength.cast("double").alias("strength"), evidence.alias("evidence"),
                    found_in.cast("string").alias("found_in"))


def _silent() -> Column:
    return _signal(F.lit(False), F.lit(0.0), T.no_strings(), F.lit(None))


def hits_in(field: str, rules: Column, limit: int = 8) -> Column:
    return T.find_terms(F.col("n_" + field), rules, limit, F.col("t_" + field))


def scan_signal(terms: Sequence[str]) -> Column:
    """Hits over title, url, summary and content; the strongest field plus a bonus for further terms."""
    if not terms:
        return _silent()
    rules = T.term_rules(terms)
    return score_hits(F.array(*[hits_in(f, rules) for f in gr.FIELD_PRIORITY]))


def score_hits(per_field: Column) -> Column:
    """Signal from the hit lists of the four fields."""

    def score(hits: Column) -> Column:
        conf = [F.when(F.size(hits[i]) > 0, F.lit(gr.FIELD_CONFIDENCE[f])).otherwise(0.0)
                for i, f in enumerate(gr.FIELD_PRIORITY)]
        best = F.greatest(*conf)
        where = F.coalesce(*[F.when((best > 0) & (c == best), F.lit(f)) for c, f in zip(conf, gr.FIELD_PRIORITY)])
        return T.let(F.array_distinct(F.flatten(hits)), lambda ev: _signal(
            F.size(ev) > 0,
            F.when(F.size(ev) > 0, F.least(F.lit(1.0), best + F.least(F.size(ev) - 1, F.lit(2)) * 0.05)).otherwise(0.0),
            ev, where))

    return T.let(per_field, score)


def funding_signal() -> Column:
    """Lexicon hits, raised to title confidence by any stated amount."""
    def with_amounts(v: Column) -> Column:
        sig, amounts = v["sig"], v["amounts"]
        return F.when(F.size(amounts) == 0, sig).otherwise(_signal(
            F.lit(True), F.least(F.lit(1.0), F.greatest(sig["strength"], F.lit(gr.FIELD_CONFIDENCE["title"]))),
            F.concat(amounts, F.filter(sig["evidence"], lambda e: ~F.array_contains(amounts, e))),
            F.coalesce(sig["found_in"], F.lit("title"))))

    return T.let(F.struct(scan_signal(gr.FUNDING_LEXICON).alias("sig"),
                          T.find_amounts("raw_blob").alias("amounts")), with_amounts)


def region_signal(regions: Sequence[str]) -> Column:
    """Text evidence, else the regions the source declares, else a marker of worldwide reach."""
    if not regions:
        return _silent()
    terms = expand_list(regions, gr.SYNONYMS)
    declared = T.normalize_text(F.array_join("source_regions", " "))

    words = F.array_union(F.array_union("t_title", "t_url"), F.array_union("t_summary", "t_content"))

    def worldwide(found: Column) -> Column:
        return F.when(F.size(found) > 0, _signal(F.lit(True), F.lit(gr.FIELD_CONFIDENCE["summary"]), found, F.lit("text"))).otherwise(_silent())

    def pick(v: Column) -> Column:
        return (F.when(v["sig"]["matched"], v["sig"])
                .when(F.size(v["reg"]) > 0, _signal(F.lit(True), F.lit(gr.FIELD_CONFIDENCE["registry"]), v["reg"], F.lit("registry")))
                .otherwise(T.let(T.find_terms(F.col("blob"), T.term_rules(gr.GLOBAL_MARKERS), 2, words), worldwide)))

    return T.let(F.struct(scan_signal(terms).alias("sig"), T.find_terms(declared, T.term_rules(terms)).alias("reg")), pick)


def negative_signal(hard_drop: Sequence[str]) -> Column:
    """Title and summary only: hard phrases weigh 1.0, page boilerplate 0.6 in the title or 0.2 below it."""
    hard = T.term_rules([*gr.HARD_NEGATIVE, *hard_drop])
    soft = T.term_rules(gr.SOFT_NEGATIVE)
    words = F.array_union("t_title", "t_summary")
    found = F.struct(
        T.find_terms(F.col("headline"), hard, 8, words).alias("hard"), hits_in("title", hard, 1).alias("hard_title"),
        T.find_terms(F.col("headline"), soft, 8, words).alias("soft"), hits_in("title", soft, 1).alias("soft_title"))

    def where(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, "title").otherwise("summary")

    return T.let(found, lambda v: (
        F.when(F.size(v["hard"]) > 0, _signal(F.lit(True), F.lit(1.0), v["hard"], where(v["hard_title"])))
        .when(F.size(v["soft"]) > 0, _signal(
            F.lit(True), F.when(F.size(v["soft_title"]) > 0, 0.6).otherwise(0.2), v["soft"], where(v["soft_title"])))
        .otherwise(_silent())))


def looks_like_single(n_title: Column) -> Column:
    """Title of one named listing: a hint matches and no plural round-up vetoes it."""
    def judge(t: Column) -> Column:
        veto = F.lit(False)
        for p in gr.ROUNDUP_VETOES:
            veto = veto | t.rlike(p)
        hint = F.lit(False)
        for p in gr.SINGLE_TITLE_HINTS:
            hint = hint | t.rlike("(?i)" + p)
        return ~(t.rlike(gr.ROUNDUP_PLURAL) & veto) & hint

    return T.let(n_title, judge)


def editorial_signal(url_patterns: Sequence[str] = gr.EDITORIAL_URL_PATTERNS, strict_url_patterns: bool = False) -> Column:
    """Round-ups, guides, reviews and hubs, by headline, by URL, or as numbered drafts.

    URL patterns run on the normalised address (every separator is a slash), where hyphenated ones never
    match; strict_url_patterns runs them on the raw address instead.
    """
    open_ = ~F.col("single")
    head_hit = F.when(open_, T.let(F.col("headline"), lambda t: T.first_match(t, gr.EDITORIAL_TITLE_PATTERNS)))
    title_hit = F.when(open_, T.let(F.col("n_title"), lambda t: T.first_match(t, gr.EDITORIAL_TITLE_PATTERNS)))
    address = F.lower("url") if strict_url_patterns else F.replace("n_url", F.lit(" "), F.lit("/"))
    url_hit = F.when(open_, T.let(address, lambda t: T.first_match(t, url_patterns)))
    draft = F.contains(F.lower(F.coalesce("url", F.lit(""))), F.lit("?p=")) & (
        F.col("n_title").isin("", *gr.DRAFT_TITLES) | (F.size(F.split("n_title", " ")) <= 3))

    def yes(evidence: Column, where: Column) -> Column:
        return _signal(F.lit(True), F.lit(1.0), F.array(evidence), where)

    return T.let(F.struct(title_hit.alias("t"), head_hit.alias("h"), url_hit.alias("u")), lambda v: (
        F.when(v["h"].isNotNull(), yes(v["h"], F.when(v["t"].isNotNull(), "title").otherwise("summary")))
        .when(v["u"].isNotNull(), yes(v["u"], F.lit("url")))
        .when(draft, yes(F.lit("wordpress draft url"), F.lit("url")))
        .otherwise(_silent())))


def sufficiency(detail_fetched: Column, text_length: Column) -> Column:
    low, full = gr.SUFFICIENCY["title_only_chars"], gr.SUFFICIENCY["full_text_chars"]
    return (F.when(detail_fetched, gr.SUFFICIENCY["after_detail_fetch"]).when(text_length <= low, 0.15)
            .when(text_length >= full, 1.0).otherwise(0.15 + 0.85 * ((text_length - low) / float(full - low))))


def type_label(per_field: Column) -> Column:
    """Bucket of the first field (title first) that names a kind of listing.

    Hits come in taxonomy order, so the first hit of a field is of its first bucket.
    """
    table = T.literal({t: k for k, v in gr.TYPE_LEXICON.items() for t in v}, "map<string,string>")
    labels = F.transform(per_field, lambda hits: F.try_element_at(table, F.get(hits, F.lit(0))))
    return F.get(F.array_compact(labels), F.lit(0))


def _group(names: Sequence[str]) -> Column:
    return S.noisy_or([F.when(F.col(n)["matched"], gr.SIGNAL_WEIGHTS[n] * F.col(n)["strength"]).otherwise(0.0)
                       for n in names])


def signals(cands: DataFrame, terms: ProfileTerms) -> DataFrame:
    all_types = [t for v in gr.TYPE_LEXICON.values() for t in v] + list(terms.extra_type_terms)
    rules = T.term_rules(all_types)
    out = cands.withColumns({
        "single": looks_like_single(F.col("n_title")),
        "type_hits": F.array(*[hits_in(f, rules) for f in gr.FIELD_PRIORITY]),
    })
    return out.withColumns({
        "opportunity_type": score_hits(F.col("type_hits")),
        "funding": funding_signal(),
        "application": scan_signal(gr.APPLICATION_LEXICON),
        "discipline": scan_signal(expand_list(terms.disciplines, gr.SYNONYMS)),
        "degree": scan_signal(expand_list(terms.degrees, gr.SYNONYMS)),
        "region": region_signal(terms.regions),
        "editorial": editorial_signal(),
        "negative": negative_signal(terms.hard_drop),
        "type_label": type_label(F.col("type_hits")),
        "sufficiency": sufficiency(F.col("detail_fetched"), F.col("text_length")),
        "title_amount": F.size(T.find_amounts("title", 1)) > 0,
    })


def scored(sig: DataFrame) -> DataFrame:
    out = sig.withColumns({
        "corpus_score": _group(("opportunity_type", "funding", "application")),
        "fit_score": _group(("discipline", "region", "degree")),
    })
    base = gr.GROUP_WEIGHTS["corpus"] * F.col("corpus_score") + gr.GROUP_WEIGHTS["fit"] * F.col("fit_score")
    return out.withColumn("score", F.when(
        F.col("negative.matched"), F.greatest(F.lit(0.0), base - F.col("negative.strength") * 0.5)).otherwise(base))


def verdicts(df: DataFrame) -> DataFrame:
    """First rule that applies decides; see the fixed thresholds for the numbers. Plain columns, so that a query that asks
    for neither verdict nor reason does not compute what only these need; with_verdict takes the rows of one verdict."""
    th = gr.THRESHOLDS
    rich = F.col("sufficiency") >= th["min_sufficiency_to_reject"]
    score, applied, single = F.col("score"), F.col("application.matched"), F.col("single")
    typed = F.col("opportunity_type.matched")
    low = score <= th["reject"]
    evidence_text = F.coalesce(F.get("negative.evidence", F.lit(0)), F.lit("negative phrase"))
    confirmed = rich | applied | F.col("title_amount") | (single & typed)
    ladder = (
        F.when(F.col("editorial.matched"),
               F.concat(F.lit("reject;editorial:"), F.get("editorial.evidence", F.lit(0))))
        .when(F.col("negative.matched") & (F.col("negative.strength") >= th["hard_negative"]),
              F.concat(F.lit("reject;hard_negative:"), evidence_text))
        .when(~(typed | F.col("funding.matched") | single), F.lit("reject;no_opportunity_signal"))
        .when((score >= th["admit"]) & confirmed, F.lit("admit;score_above_admit"))
        .when(score >= th["admit"], F.lit("investigate;needs_detail_confirmation"))
        .when(F.col("negative.matched") & low, F.concat(F.lit("reject;boilerplate:"), evidence_text))
        .when(rich & low, F.lit("reject;low_score_with_full_text"))
        .when(~applied & ~rich, F.lit("investigate;needs_detail_for_application"))
        .when(~low & ~rich & single, F.lit("investigate;ambiguous_listing_title"))
        .otherwise(F.lit("reject;below_admit_threshold")))
    return df.withColumn("outcome", ladder).withColumns({
        "verdict": F.split_part("outcome", F.lit(";"), F.lit(1)), "reason": F.regexp_replace("outcome", "^[^;]*;", "")}).drop("outcome")


def with_verdict(decisions: DataFrame, verdict: str) -> DataFrame:
    """Decisions of one verdict. The filter stays above the one-row inline, else the optimizer would copy every signal
    expression into it once per mention."""
    told = [c for c in ("verdict", "reason") if c in decisions.columns]
    return decisions.select(*[c for c in decisions.columns if c not in told], F.inline(F.array(F.struct(*told)))).filter(F.col("verdict") == verdict)


def evaluate(items: DataFrame, terms: ProfileTerms | None = None) -> DataFrame:
    """Signals, scores, verdict and reason for every item; narrow, one pass over the text."""
    return verdicts(scored(signals(candidates(items), terms or ProfileTerms())))


EVIDENCE_ORDER = ("opportunity_type", "funding", "discipline", "region", "degree", "application")


def evidence_summary(limit: int = 6) -> Column:
    def labelled(n: str) -> Column:
        return F.transform(F.slice(F.col(n)["evidence"], 1, 2), lambda t: F.concat(F.lit(n + ":"), t))

    labels = F.flatten(F.array(*[labelled(n) for n in EVIDENCE_ORDER]))
    return F.slice(F.array_distinct(labels), 1, limit)


def matched_signals() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n)["matched"], F.lit(n)) for n in SIGNALS]))


def explain() -> Column:
    ev = evidence_summary(4)
    tail = F.when(F.size(ev) > 0, F.concat(F.lit("evidence="), F.array_join(ev, ", "))).otherwise("no positive signals")
    return F.concat_ws(" | ", F.concat(F.col("verdict"), F.lit(" score="), F.format_string("%.2f", F.bround("score", 2))), "reason", tail)


def low_fit_admitted() -> Column:
    return (F.col("fit_score") < 0.15) & (F.col("corpus_score") >= 0.55)


def first_items(items: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows per key. The rank filter lets Spark cut every group before and after the shuffle."""
    return items.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def triage(decisions: DataFrame, max_items: int | None = None, budget: int = gr.INVESTIGATION_BUDGET) -> DataFrame:
    """Lane per item: admitted, investigate (within the budget of its source), deferred or rejected.

    All items of a source get a lane; max_items cuts it to its first ones. Only the items to investigate are numbered,
    and of these only the first `budget` have to be known, which Spark keeps per task before it deals them out. Items
    are met twice, so they are written out with the columns given, and judged once.
    """
    head = cut_lineage(decisions if max_items is None else first_items(decisions, "source_id", [F.col("pos")], max_items))
    chosen = first_items(head.filter(F.col("verdict") == "investigate").select("source_id", "pos"), "source_id", [F.col("pos")], budget)
    last = chosen.groupBy("source_id").agg(F.max("pos").alias("_last"))
    return head.join(last, "source_id", "left").withColumn("_place", F.when(F.col("pos") <= F.col("_last"), 0).otherwise(budget + 1)).withColumn("lane", F.when(F.col("verdict") == "admit", "admitted").when(
        F.col("verdict") == "reject", "rejected").when(F.col("_place") <= budget, "investigate").otherwise("deferred")).drop("_place", "_last")


def rescore_with_detail(queue: DataFrame, details: DataFrame, terms: ProfileTerms | None = None) -> DataFrame:
    """Second pass over admitted and investigated items whose detail page has landed; only admits survive."""
    keep = ["listing_id", "source_id", "pos", "url", "summary", "source_regions"]
    joined = queue.select(*keep, F.col("title").alias("item_title")).join(details, "listing_id")
    items = joined.select(*keep, F.coalesce(F.nullif("detail_title", F.lit("")), F.col("item_title")).alias("title"),
                          F.col("detail_summary").alias("content"), F.lit(True).alias("detail_fetched"))
    return evaluate(items, terms).withColumn(
        "lane", F.when(F.col("verdict") == "admit", "admitted").otherwise("rejected_after_detail"))


def pending_queue(old: DataFrame, deferred: DataFrame, processed: DataFrame, cap: int = gr.MAX_PENDING) -> DataFrame:
    """Queue of (source_id, url, title, pos): old entries first, unseen deferred ones after, capped, done ones gone."""
    both = old.select("source_id", "url", "title", "pos", F.lit(0).alias("age")).unionByName(
        deferred.select("source_id", "url", "title", "pos", F.lit(1).alias("age"))).filter(F.coalesce("url", F.lit("")) != "")
    unique = both.groupBy("source_id", "url").agg(F.min(F.struct("age", "pos", "title")).alias("e"))
    flat = unique.select("source_id", "url", "e.age", "e.pos", "e.title")
    capped = first_items(flat, "source_id", [F.col("age"), F.col("pos"), F.col("url")], cap)
    return capped.join(processed.select("source_id", "url"), ["source_id", "url"], "left_anti")


def merge_pending(items: DataFrame, queue: DataFrame) -> DataFrame:
    """Items of the next batch plus queued ones that did not come back."""
    extra = queue.join(items.select("source_id", "url"), ["source_id", "url"], "left_anti")
    return items.unionByName(extra.select("source_id", "url", "title", "pos"), allowMissingColumns=True)


def verdict_report(decisions: DataFrame) -> DataFrame:
    """Found, admitted, investigated and rejected per source, with a total row (source NULL)."""
    return decisions.rollup("source_id").agg(
        F.count("*").alias("found"), F.count_if(F.col("verdict") == "admit").alias("admit"),
        F.count_if(F.col("verdict") == "investigate").alias("investigate"),
        F.count_if(F.col("verdict") == "reject").alias("reject"))
