"""Fact and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.bindings import Bindings
from fairlead.functions import text as T
from fairlead.operators import facts as X
from fairlead.plans.registry import query


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("p14_extract_from_feed_item")
def p14(b: Bindings):
    items = b.listings.select(F.col("listing_id").alias("item_id"), "title", F.concat(F.lit("<p>"), "summary", F.lit("</p>")).alias("summary"))
    r = X.extract_from_feed_item(items)
    return r.select("item_id", "title", F.md5("summary").alias("summary_md5"), day("deadline").alias("deadline"), "opportunity_type",
                    T.joined(F.col("requirements")).alias("requirements"), "funding_type",
                    T.joined(F.col("degree_levels")).alias("degree_levels"), "confidence")


def landed(b: Bindings):
    """Pages, some carrying embedded data or page metadata, some with a stated deadline."""
    ld = F.format_string('<script type="application/ld+json">{"name":"Grant %d","description":"Fully funded doctoral grant","endDate":"2026-10-05","provider":{"name":"Org %d"}}</script>',
                         "page_id", F.col("page_id") % 7)
    og = F.format_string('<meta property="og:title" content="Open call %d"><meta property="og:description" content="Partial funding for master students">', "page_id")
    due = F.format_string("<p>Deadline: %d October 2026</p>", F.col("page_id") % 27 + 1)
    html = (F.when(F.col("page_id") % 5 == 0, F.concat(ld, "html")).when(F.col("page_id") % 5 == 1, F.concat(og, "html"))
            .when(F.col("page_id") % 5 == 2, F.concat(due, "html")).otherwise(F.col("html")))
    return b.pages.select("page_id", html.alias("html"), F.lit("").alias("fallback_title"),
                          F.when(F.col("page_id") % 2 == 0, "A stipend is paid").otherwise("").alias("fallback_summary"))


def _page_columns(r):
    return r.select("page_id", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), "institution", day("deadline").alias("deadline"),
                    "opportunity_type", T.joined(F.col("requirements")).alias("requirements"), "funding_type",
                    T.joined(F.col("degree_levels")).alias("degree_levels"), "confidence", "title_from", "summary_from", "deadline_from")


@query("p15_extract_structured_page")
def p15(b: Bindings):
    return _page_columns(X.extract_structured_page(landed(b)))


def markdown(b: Bindings):
    head = F.format_string("# Call %d\n\n![Image 1: Organization](https://x.org/i.png) Org %d\n![Image 2: Location](https://x.org/l.png) Nairobi\n![Image 3: Deadline](https://x.org/d.png) %d May 2027\n**Type:** fellowship\n",
                           "doc_id", F.col("doc_id") % 9, F.col("doc_id") % 28 + 1)
    tail = F.lit("\nMasters fellowship, transcript needed.\n## Related Programs\nother")
    body = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat(head, F.col("text"), tail))
    return b.documents.select(F.col("doc_id").alias("page_id"), body.alias("body"), F.lit("Fallback title").alias("fallback_title"),
                              F.when(F.col("doc_id") % 8 == 0, "Short summary").otherwise("").alias("fallback_summary"))


@query("p16_extract_from_markdown_page")
def p16(b: Bindings):
    return _page_columns(X.extract_from_markdown_page(markdown(b)))


@query("p17_extract_detail")
def p17(b: Bindings):
    md = markdown(b).withColumn("content_format", F.lit("markdown"))
    html = landed(b).select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.col("html").alias("body"), "fallback_title", "fallback_summary",
                            F.lit("html").alias("content_format"))
    both = md.unionByName(html)
    return X.extract_detail(both).groupBy("summary_from", "title_from", "confidence").agg(F.count("*").alias("n"))


@query("p17_should_fetch_detail")
def p17b(b: Bindings):
    c = F.when(F.col("id") % 3 == 0, "full_in_feed").when(F.col("id") % 3 == 1, "full").otherwise("snippet_only")
    d = F.when(F.col("id") % 4 == 0, "required").when(F.col("id") % 4 == 1, "never")
    return b.sources.select("id", X.should_fetch_detail(c, d).alias("fetch"))


@query("p21_derive_facts")
def p21(b: Bindings):
    r = X.derive_facts(b.listings)
    return r.select("listing_id", day("f_deadline").alias("deadline"), F.col("f_note").alias("note"), F.col("f_source").alias("source"),
                    F.col("f_funding").alias("funding"), F.col("f_evidence").alias("evidence"), F.col("f_amount").alias("amount"),
                    *[T.joined(F.col("f_" + c)).alias(c) for c in ("degrees", "regions", "themes", "formats")],
                    F.col("f_remote").alias("remote"), F.col("f_text_length").cast("bigint").alias("text_length"))


@query("p22_backfill_facts")
def p22(b: Bindings):
    r = X.backfill_facts(X.derive_facts(b.listings))
    return r.select("listing_id", day("deadline").alias("deadline"), "funding_type", *[T.joined(F.col(c)).alias(c) for c in (
        "degree_levels", "countries", "tags", "written")])
