"""Facts recovered from listing text, feed items and landed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import dates as D
from fairlead.functions import text as T
from fairlead.rules import fact_rules as fr


def text_or_blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def listing_text() -> Column:
    return F.concat_ws(" ", text_or_blank("title"), text_or_blank("summary"),
                       F.array_join("requirements", " "), text_or_blank("institution"), F.lit(""))


def derive_facts(listings: DataFrame) -> DataFrame:
    """Adds f_* columns: stored values first, then what the text states; order kept, duplicates dropped."""
    staged = listings.withColumn("f_text", listing_text()).withColumn("f_low", F.lower("f_text"))
    low = F.col("f_low")
    dated = staged.withColumns({
        "_due": F.when(F.col("deadline").isNull(), D.derive_deadline(F.col("f_text"))),
        "_money": T.detect_funding_facts(low),
        "_title_formats": T.detect_multi(F.lower(text_or_blank("title")), fr.FORMAT_NEEDLES, 2),
    })
    stored_funding = F.coalesce(F.col("funding_type"), F.lit("")) != ""
    remote = T.let(low, lambda t: F.when(T.any_contains(t, fr.REMOTE_PHRASES), True)
                   .when(T.any_contains(t, fr.ONSITE_PHRASES), False))
    return dated.withColumns({
        "f_deadline": F.coalesce("deadline", F.col("_due.deadline")),
        "f_note": F.col("_due.note"),
        "f_source": F.when(F.col("deadline").isNotNull(), "column").when(F.col("_due.deadline").isNotNull(), "text").otherwise("none"),
        "f_funding": F.when(stored_funding, F.col("funding_type")).otherwise(F.col("_money.type")),
        "f_evidence": F.when(stored_funding, "listed funding type").otherwise(F.col("_money.evidence")),
        "f_amount": F.col("_money.amount"),
        "f_degrees": F.array_distinct(F.concat(F.transform("degree_levels", F.lower), T.detect_multi(low, fr.DEGREE_NEEDLES, 4))),
        "f_regions": F.array_distinct(F.concat("countries", T.detect_multi(low, fr.REGION_NEEDLES, 4))),
        "f_themes": F.array_distinct(F.concat(F.transform("tags", F.lower), T.detect_multi(low, fr.THEME_NEEDLES, 5))),
        "f_formats": F.when(F.size("_title_formats") > 0, F.col("_title_formats")).otherwise(T.detect_multi(low, fr.FORMAT_NEEDLES, 2)),
        "f_remote": remote,
        "f_text_length": F.length(F.regexp_replace("f_text", r"^\s+|\s+$", "")),
    }).drop("_due", "_money", "_title_formats")


def backfill_facts(facts: DataFrame) -> DataFrame:
    """Fills only empty columns; ``written`` names the filled ones."""
    fill_deadline = F.col("deadline").isNull() & F.col("f_deadline").isNotNull()
    fill_funding = (F.coalesce("funding_type", F.lit("")) == "") & F.col("f_funding").isNotNull()

    def empty(c: str, f: str) -> Column:
        return (F.size(c) == 0) & (F.size(f) > 0)

    written = F.array_compact(F.array(
        F.when(fill_deadline, "deadline"), F.when(fill_funding, "funding_type"),
        F.when(empty("degree_levels", "f_degrees"), "degree_levels"), F.when(empty("countries", "f_regions"), "countries"),
        F.when(empty("tags", "f_themes"), "tags")))
    return facts.withColumn("written", written).withColumns({
        "deadline": F.coalesce("deadline", "f_deadline"),
        "funding_type": F.when(fill_funding, F.col("f_funding")).otherwise(F.col("funding_type")),
        "degree_levels": F.when(F.size("degree_levels") == 0, F.col("f_degrees")).otherwise(F.col("degree_levels")),
        "countries": F.when(F.size("countries") == 0, F.col("f_regions")).otherwise(F.col("countries")),
        "tags": F.when(F.size("tags") == 0, F.col("f_themes")).otherwise(F.col("tags")),
    })


def _common_fields(title: Column, summary: Column, text: Column) -> list[Column]:
    return [
        T.classify_type(title, summary).alias("opportunity_type"), T.extract_requirements(text).alias("requirements"),
        T.detect_funding_extract(text).alias("funding_type"), T.detect_degrees(text).alias("degree_levels"),
    ]


def extract_from_feed_item(items: DataFrame) -> DataFrame:
    """Item fields to a listing record; input (item_id, title, summary)."""
    clean = items.select("item_id", text_or_blank("title").alias("title"), T.strip_html("summary").alias("summary"))
    text = F.concat(F.col("title"), F.lit("\n"), F.col("summary"))
    return clean.select(
        "item_id", F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("title"),
        F.substring("summary", 1, 4000).alias("summary"), D.parse_deadline(text).alias("deadline"),
        *_common_fields(F.col("title"), F.col("summary"), text),
        F.when(F.col("summary") != "", "medium").otherwise("low").alias("confidence"))


def element_text(html: Column, tag: str) -> Column:
    """Visible text of the first element of a kind."""
    return T.strip_html(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def meta_content(html: Column, prop: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]*property="{prop}"[^>]*content="([^"]*)"', 1), F.lit(""))


def page_deadline(html: Column) -> Column:
    return F.coalesce(*[D.parse_date(F.regexp_extract(html, cue, 1)) for cue in fr.PAGE_DEADLINE_CUES])


def extract_structured_page(pages: DataFrame, content_tag: str | None = None, remove: Sequence[str] = ("nav", "footer", "script")) -> DataFrame:
    """Ladder over embedded data, page metadata, headings and body text.

    Input (page_id, html, fallback_title, fallback_summary). The content element is named by its tag.
    """
    ld = F.regexp_extract("html", r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    staged = pages.withColumn("_ld", F.when(F.trim(ld).startswith("["), F.get_json_object(ld, "$[0]")).otherwise(ld))

    def field(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object("_ld", p), F.lit("")) for p in paths])

    org = field("$.provider.name", "$.organizer.name", "$.provider", "$.organizer")
    body = F.lit("")
    if content_tag:
        inner = F.regexp_extract("html", rf"(?is)<{content_tag}\b[^>]*>(.*)</{content_tag}\s*>", 1)
        for tag in remove:
            inner = F.regexp_replace(inner, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
        body = T.strip_html(inner)
    staged = staged.withColumns({
        "s_title": F.coalesce(field("$.name", "$.headline"), meta_content(F.col("html"), "og:title")),
        "s_summary": F.coalesce(field("$.description"), meta_content(F.col("html"), "og:description")),
        "s_deadline": D.parse_date(field("$.endDate", "$.validThrough")),
        "s_org": org,
        "a_title": element_text(F.col("html"), "h1"),
        "a_body": body,
        "h_deadline": page_deadline(F.col("html")),
    })
    title = F.coalesce(F.col("s_title"), F.nullif("a_title", F.lit("")), F.col("fallback_title"), F.lit(""))
    content = F.coalesce(F.nullif("a_body", F.lit("")), F.col("s_summary"), F.nullif("fallback_summary", F.lit("")),
                         F.substring(T.strip_html("html"), 1, 8000))
    named = staged.withColumns({"title": title, "content": content}).withColumn("text", F.concat("title", F.lit("\n"), "content"))
    origin = (F.when(F.col("a_body") != "", "adapter").when(F.col("s_summary").isNotNull(), "structured")
              .when(F.coalesce("fallback_summary", F.lit("")) != "", "feed").otherwise("heuristic"))
    deadline = F.coalesce("s_deadline", "h_deadline")
    return named.select(
        "page_id", F.substring(F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")), 1, 500).alias("title"),
        F.substring("content", 1, 4000).alias("summary"), F.col("s_org").alias("institution"), deadline.alias("deadline"),
        *_common_fields(F.col("title"), F.col("content"), F.col("text")),
        F.when(F.col("content") == "", "low").when((origin == "adapter") & deadline.isNotNull(), "high").otherwise("medium").alias("confidence"),
        F.when(F.col("s_title").isNotNull(), "structured").otherwise("adapter").alias("title_from"), origin.alias("summary_from"),
        F.when(F.col("s_deadline").isNull() & F.col("h_deadline").isNotNull(), "heuristic").alias("deadline_from"))


def extract_from_markdown_page(pages: DataFrame) -> DataFrame:
    """Reader-style markdown: heading, organisation and deadline image lines, body up to the next section.

    Input (page_id, body, fallback_title, fallback_summary).
    """
    heading = F.trim(F.regexp_extract("body", r"(?m)^#[ \t]+(.+)$", 1))
    org = F.trim(F.regexp_extract("body", r"!\[Image \d+: Organization\]\([^)]+\)\s+([^\n]+)", 1))
    due = F.trim(F.regexp_extract("body", r"!\[Image \d+: Deadline\]\([^)]+\)\s+([^\n]+)", 1))
    rest = F.regexp_extract("body", r"(?ms)^#[ \t]+[^\n]+\n(.*?)(?:\n## |\z)", 1)
    dropped = r"^!\[.*(Organization|Location|Deadline)|^\*\*(Type|Discipline|Keywords):"
    lines = F.filter(F.transform(F.split(rest, "\n"), lambda x: F.trim(x)),
                     lambda x: (x != "") & ~F.regexp_like(x, F.lit(dropped)))
    staged = pages.withColumns({
        "_head": heading, "institution": F.nullif(org, F.lit("")),
        "_due": F.when(~F.contains(due, F.lit("1970")), D.parse_date(due)),
        "_lines": F.when(heading != "", lines).otherwise(T.no_strings()), "_page_due": page_deadline(F.col("body")),
    })
    staged = staged.withColumns({
        "title": F.when(F.col("_head") != "", F.col("_head")).otherwise(text_or_blank("fallback_title")),
        "summary": F.when(F.size("_lines") > 0, F.substring(F.array_join("_lines", " "), 1, 4000)).otherwise(text_or_blank("fallback_summary")),
    })
    text = F.concat("title", F.lit("\n"), "summary")
    origin = F.when(F.size("_lines") > 0, "adapter").when(F.col("summary") != "", "feed").otherwise("heuristic")
    return staged.select(
        "page_id", F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("title"), "summary", "institution",
        F.coalesce("_due", "_page_due").alias("deadline"), *_common_fields(F.col("title"), F.col("summary"), text),
        F.when(F.col("summary") == "", "low").when((origin == "adapter") & F.col("institution").isNotNull(), "high")
        .otherwise("medium").alias("confidence"),
        F.when(F.col("_head") != "", "adapter").alias("title_from"), origin.alias("summary_from"),
        F.when(F.col("_due").isNotNull(), "adapter").when(F.col("_page_due").isNotNull(), "heuristic").alias("deadline_from"))


def should_fetch_detail(completeness: Column, detail_fetch: Column) -> Column:
    return (F.coalesce(completeness, F.lit("")) != "full_in_feed") & F.coalesce(detail_fetch, F.lit("optional")).isin("required", "optional")


def extract_detail(pages: DataFrame, content_tag: str | None = None) -> DataFrame:
    """Markdown pages and HTML pages by their own extractor; input adds content_format."""
    markdown = pages.filter(F.col("content_format") == "markdown")
    html = pages.filter(F.col("content_format") != "markdown").withColumnRenamed("body", "html")
    return extract_from_markdown_page(markdown).unionByName(extract_structured_page(html, content_tag))
