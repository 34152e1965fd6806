"""Queries over the scalar functions: every listing or page through each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.functions import dates as D
from fairlead.functions import scoring as S
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.operators.synonyms import expand_terms
from fairlead.plans.registry import query
from fairlead.rules import fact_rules as fr
from fairlead.rules import gate_rules as gr

STRIP = ["utm_source", "ref"]


def now():
    return F.lit(AS_OF).cast("timestamp")


def body():
    return F.concat_ws(" ", "title", "summary")


@query("p01_canonicalize_url")
def p01(b: Bindings):
    return b.pages.select("page_id", U.canonicalize_url("url", STRIP).alias("canonical"))


@query("p02_hashes")
def p02(b: Bindings):
    return b.pages.select("page_id", U.hash_url("url").alias("url_hash"), U.hash_content("html").alias("content_hash"))


@query("p03_domains")
def p03(b: Bindings):
    return b.pages.select("page_id", U.extract_domain("url").alias("domain"))


@query("p04_normalize_text")
def p04(b: Bindings):
    return b.documents.select("doc_id", F.md5(T.normalize_text("text")).alias("norm_md5"))


@query("p05_find_terms")
def p05(b: Bindings):
    text = T.normalize_text(body())
    rules = T.term_rules(gr.FUNDING_LEXICON + gr.APPLICATION_LEXICON)
    return b.listings.select("listing_id", T.joined(T.find_terms(text, rules)).alias("terms"))


@query("p06_find_amounts")
def p06(b: Bindings):
    return b.listings.select("listing_id", T.joined(T.find_amounts(body())).alias("amounts"))


@query("p07_expand_terms")
def p07(b: Bindings):
    return b.profiles.select("user_id", T.joined(expand_terms("research_interests", gr.SYNONYMS)).alias("terms"))


@query("p08_strip_html")
def p08(b: Bindings):
    return b.pages.select("page_id", F.md5(T.strip_html("html")).alias("text_md5"))


@query("p09_classify_type")
def p09(b: Bindings):
    return b.listings.select("listing_id", T.classify_type("title", "summary").alias("kind"))


@query("p10_parse_deadline")
def p10(b: Bindings):
    return b.listings.select("listing_id", F.date_format(D.parse_deadline(body()), "yyyy-MM-dd").alias("deadline"))


@query("p11_extract_requirements")
def p11(b: Bindings):
    return b.listings.select("listing_id", T.joined(T.extract_requirements(body())).alias("requirements"))


@query("p12_detect_funding_extract")
def p12(b: Bindings):
    return b.listings.select("listing_id", T.detect_funding_extract(body()).alias("funding"))


@query("p13_detect_degrees")
def p13(b: Bindings):
    return b.listings.select("listing_id", T.joined(T.detect_degrees(body())).alias("degrees"))


@query("p18_derive_deadline")
def p18(b: Bindings):
    d = D.derive_deadline(body())
    return b.listings.select("listing_id", F.date_format(d["deadline"], "yyyy-MM-dd").alias("deadline"),
                             d["note"].alias("note"))


@query("p19_detect_funding_facts")
def p19(b: Bindings):
    f = T.detect_funding_facts(F.lower(body()))
    return b.listings.select("listing_id", f["type"].alias("funding"), f["evidence"].alias("evidence"),
                             f["amount"].alias("amount"))


@query("p20_detect_multi")
def p20(b: Bindings):
    low = F.lower(body())
    return b.listings.select(
        "listing_id",
        T.joined(T.detect_multi(low, fr.DEGREE_NEEDLES, 4)).alias("degrees"),
        T.joined(T.detect_multi(low, fr.REGION_NEEDLES, 4)).alias("regions"),
        T.joined(T.detect_multi(low, fr.THEME_NEEDLES, 5)).alias("themes"),
        T.joined(T.detect_multi(low, fr.FORMAT_NEEDLES, 2)).alias("formats"))


@query("p23_days_until")
def p23(b: Bindings):
    late = F.col("deadline") + F.expr("make_dt_interval(0, CAST(listing_id % 24 AS INT))")
    return b.listings.select("listing_id", D.days_until(late, now()).alias("days"))


@query("p24_deadline_bucket")
def p24(b: Bindings):
    days = D.days_until(F.col("deadline"), now())
    return b.listings.select("listing_id", D.deadline_bucket(days).alias("bucket"), D.urgency_label(days).alias("label"))


@query("p25_urgency_score")
def p25(b: Bindings):
    return b.listings.select("listing_id", D.urgency_score(D.days_until(F.col("deadline"), now())).alias("urgency"))


@query("p26_fit_level")
def p26(b: Bindings):
    return b.feedback.select("user_id", "listing_id", S.fit_level(F.col("fit_score"), F.col("hard_failed")).alias("level"))


@query("p27_trust_state")
def p27(b: Bindings):
    st = S.trust_state(F.col("verification_status"))
    return b.listings.select("listing_id", st.alias("state"), S.lookup(st, fr.TRUST_LABELS).alias("label"),
                             S.lookup(st, fr.TRUST_HINTS).alias("hint"))


@query("p28_funding_category")
def p28(b: Bindings):
    return b.listings.select("listing_id", T.funding_category(F.concat_ws(" ", "funding_type", "title", "summary")).alias("category"))


@query("p29_org_names")
def p29(b: Bindings):
    org = U.guess_org_name(F.col("title"), F.col("institution"))
    return b.listings.select("listing_id", org.alias("org"), U.org_key(org).alias("org_key"))


@query("p30_domain_classes")
def p30(b: Bindings):
    d = F.coalesce(U.extract_domain("url"), F.lit(""))
    alt = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("m."), F.lit("medium.com"))) \
        .when(F.col("page_id") % 5 == 1, F.concat(d, F.lit(".ac.uk"))).otherwise(d)
    return b.pages.select("page_id", U.is_institutional(alt).alias("institutional"), U.is_non_primary(alt).alias("non_primary"))


@query("p31_domain_matches_org")
def p31(b: Bindings):
    org = F.concat(F.split_part("host", F.lit("."), F.lit(1)), F.lit(" "), F.col("title"))
    return b.page_hits.select("page_id", U.domain_matches_org(U.bare_host(F.col("host")), org).alias("matches"))


@query("p32_scam_phrases")
def p32(b: Bindings):
    spiced = F.concat(F.col("title"), F.when(F.col("listing_id") % 9 == 0, " pay to apply, wire transfer").otherwise(""))
    return b.listings.select("listing_id", T.joined(T.phrases_in(F.lower(F.concat_ws(" ", spiced, "summary")), fr.SCAM_PHRASES)).alias("hits"))


@query("p34_article_urls")
def p34(b: Bindings):
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://"), "host", F.lit("/blog/post-"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return b.page_hits.select("page_id", U.is_article_url(u).alias("article"), U.best_url_for_domain(u).alias("best_url"))


@query("p35_chunk_text")
def p35(b: Bindings):
    c = b.documents.select("doc_id", F.inline(T.chunk_text(F.col("text"))))
    return c.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.md5("chunk").alias("chunk_md5"))


@query("p36_matched_terms")
def p36(b: Bindings):
    terms = F.split(F.lit("Research,the,Scholarship,scholarship,in,Doctoral position,stipend,and,prize,monthly"), ",")
    return b.listings.select("listing_id", T.joined(T.matched_terms(terms, body())).alias("terms"))


@query("p37_normalize_degree")
def p37(b: Bindings):
    return b.profiles.select("user_id", T.normalize_degree(F.col("degree_level")).alias("level"),
                             T.normalize_degree(F.get("research_interests", F.lit(0))).alias("from_interest"))


@query("p38_search_text")
def p38(b: Bindings):
    return b.listings.select("listing_id", F.md5(F.substring(F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("summary", F.lit("")))), 1, 8000)).alias("search_md5"))


@query("p33_page_looks_stale")
def p33(b: Bindings):
    from fairlead.operators.trust import page_looks_stale

    return b.page_hits.select("page_id", page_looks_stale(F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("<p>Applications closed</p>"), "html")).otherwise(F.col("html"))).alias("stale"))


@query("s13_title_from_slug")
def s13(b: Bindings):
    return b.pages.select("page_id", U.title_from_slug("url").alias("title"))
