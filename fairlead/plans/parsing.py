"""Parser queries: payloads are assembled from the pages (at most fifty per payload) and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.plans.registry import query
from fairlead.sources import parsers as S


def now():
    return F.lit(AS_OF).cast("timestamp")


def _packed(b: Bindings, element) -> DataFrame:
    """(source_id, page_no, parts): one row per fifty pages, parts in page order."""
    rows = b.page_hits.select("batch_no", "page_id", element.alias("part"))
    return rows.groupBy(F.col("batch_no").alias("source_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "part"))), lambda s: s["part"]).alias("parts")).withColumn("page_no", F.lit(0))


def _escaped(c):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rss(b: Bindings) -> DataFrame:
    item = F.concat(F.lit("<item><title>"), _escaped("title"), F.lit("</title><link>"), _escaped("url"), F.lit("</link><pubDate>Mon, 01 Jun 2026</pubDate><description>"),
                    _escaped("org"), F.lit("</description></item>"))
    return _packed(b, item).select("source_id", F.lit("rss").alias("kind"), "page_no", F.lit("https://feeds.org/").alias("url"),
                                   F.concat(F.lit("<rss><channel>"), F.array_join("parts", ""), F.lit("</channel></rss>")).alias("body"))


def feeds(b: Bindings) -> DataFrame:
    """The same pages as Atom, RDF or RSS, by batch."""
    def of(entry, head: str, tail: str):
        return _packed(b, entry).select("source_id", F.lit("rss").alias("kind"), "page_no", F.lit("https://feeds.org/").alias("url"), F.concat(F.lit(head), F.array_join("parts", ""), F.lit(tail)).alias("body"))

    atom = F.concat(F.lit('<entry><link rel="self" href="https://self.org/"/><link href="'), _escaped("url"), F.lit('"/><title type="text">'), _escaped("title"),
                    F.lit("</title><updated>2026-06-01T00:00:00Z</updated><summary>"), _escaped("org"), F.lit("</summary></entry>"))
    rdf = F.concat(F.lit("<item><title>"), _escaped("title"), F.lit("</title><link>"), _escaped("url"), F.lit("</link><description>"), _escaped("org"), F.lit("</description><dc:date>2026-06-02</dc:date></item>"))
    by = F.col("source_id") % 3
    return (of(atom, '<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>', "</feed>").filter(by == 0)
            .unionByName(of(rdf, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>all</title></channel>', "</rdf:RDF>").filter(by == 1))
            .unionByName(rss(b).filter(by == 2)))


@query("s02_parse_feed_kinds")
def s02_kinds(b: Bindings):
    return S.parse_feed_items(feeds(b)).select("source_id", "pos", "url", F.md5("title").alias("title_md5"), "published", "summary")


@query("s02_parse_rss_all")
def s02_all(b: Bindings):
    return S.parse_rss_items(rss(b)).select("source_id", "pos", "url", F.md5("title").alias("title_md5"), "published", "summary")


@query("s02_parse_rss_items")
def s02(b: Bindings):
    return S.parse_rss_items(rss(b), 40).select("source_id", "pos", "url", F.md5("title").alias("title_md5"), "published", "summary")


def sitemaps(b: Bindings) -> DataFrame:
    def part(odd: int, tail: str):
        rows = _packed(b, F.when(F.col("page_id") % 2 == odd, F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))).otherwise(""))
        name = F.concat(F.lit("https://maps.org/"), F.col("source_id").cast("string"))
        head = F.concat(F.lit("<loc>"), name, F.lit("/post-sitemap.xml</loc>")) if odd == 0 else F.lit("")
        return rows.select("source_id", F.lit("sitemap").alias("kind"), "page_no", F.concat(name, F.lit(tail)).alias("url"),
                           F.concat(F.lit("<urlset>"), head, F.array_join("parts", ""), F.lit("</urlset>")).alias("body"))

    return part(0, ".xml").unionByName(part(1, "/post-sitemap.xml"))


@query("s03_parse_sitemap_all")
def s03_all(b: Bindings):
    return S.parse_sitemap_locs(sitemaps(b)).select("source_id", "url")


@query("s03_parse_sitemap_locs")
def s03(b: Bindings):
    return S.parse_sitemap_locs(sitemaps(b), max_urls=30).select("source_id", "url")


def wp(b: Bindings) -> DataFrame:
    post = F.to_json(F.struct(F.col("url").alias("link"), F.struct(F.col("title").alias("rendered")).alias("title"), F.struct(F.col("org").alias("rendered")).alias("excerpt"),
                              F.lit("2026-06-01").alias("date"), F.array(F.col("page_id") % 3).alias("categories")))
    return _packed(b, post).select("source_id", F.lit("wp_json").alias("kind"), "page_no", F.lit("https://wp.org/posts").alias("url"),
                                   F.concat(F.lit("["), F.array_join("parts", ","), F.lit("]")).alias("body"))


@query("s04_parse_wp_json_items")
def s04(b: Bindings):
    cats = b.page_hits.select((F.col("page_id") % 3).alias("id")).distinct().withColumn("slug", F.when(F.col("id") == 1, "Grants").otherwise("news"))
    return S.parse_wp_json_items(wp(b), ["grants"], cats).select("source_id", "pos", "url", F.md5("title").alias("title_md5"), "published", "summary")


@query("s05_parse_custom_api_items")
def s05(b: Bindings):
    k = F.col("page_id")
    row = F.to_json(F.struct(
        F.when(k % 3 == 0, F.col("url")).alias("link"), F.when(k % 3 == 1, F.concat(F.lit("post-"), k.cast("string"))).alias("slug"), F.struct(F.col("org").alias("rendered")).alias("title"),
        F.when(k % 2 == 0, "Africa").alias("region"), (k % 4 != 3).alias("has-deadline"), (F.lit(1_780_000_000) + k * 86400).cast("string").alias("deadline"),
        F.struct(F.when(k % 5 != 0, "Grants").alias("name"), F.when(k % 3 != 2, "https://posts.org/cat/").alias("link")).alias("category"),
        F.struct(F.concat(F.lit("https://cdn.org/img/pic-"), k.cast("string"), F.lit("-300x200.jpg")).alias("medium")).alias("thumbnail")))
    payloads = _packed(b, row).select("source_id", F.lit("custom_api").alias("kind"), "page_no", F.lit("https://api.org").alias("url"), F.concat(F.lit("["), F.array_join("parts", ","), F.lit("]")).alias("body"))
    return S.parse_custom_api_items(payloads, "https://base.org/").select("source_id", "pos", "url", "title", "summary")


@query("s06_parse_search_api_items")
def s06(b: Bindings):
    k = F.col("page_id")
    row = F.to_json(F.struct(F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("award-"), k.cast("string"))).alias("programTitleSlug"), F.concat(F.lit(" "), "org").alias("programName"),
                             F.when(k % 2 == 0, "2026-01-01").alias("openDate"), F.lit("2026-09-09").alias("closeDate"), F.when(k % 3 == 0, "blurb").alias("blurb"), F.lit("self").alias("programSelfDescription")))
    payloads = _packed(b, row).select("source_id", F.lit("search_api").alias("kind"), "page_no", F.lit("https://api.org").alias("url"), F.concat(F.lit('{"data":['), F.array_join("parts", ","), F.lit("]}")).alias("body"))
    return S.parse_search_api_items(payloads, "https://find.org/{slug}").select("source_id", "pos", "url", "title", "published", "summary")


def pages_as_payloads(b: Bindings) -> DataFrame:
    return b.pages.select(F.col("page_id").alias("source_id"), F.lit("html").alias("kind"), F.lit(0).alias("page_no"), "url", F.col("html").alias("body"))


@query("s07_parse_html_links")
def s07(b: Bindings):
    return S.parse_html_links(pages_as_payloads(b), max_items=80).select("source_id", "pos", "url", "title")


@query("s07_parse_heading_links")
def s07_headings(b: Bindings):
    head = F.concat(F.lit('<h2 class="big entry-title"><a href="/e/'), F.col("page_id").cast("string"), F.lit('"><b>Entry</b> one</a></h2><h2 class="other"><a href="/no">no</a></h2><h2 class="entry-title">Entry <i>two</i> <a href="/f/'),
                    F.col("page_id").cast("string"), F.lit('"><img src="x.png"></a></h2>'))
    payloads = b.pages.select(F.col("page_id").alias("source_id"), F.lit("html").alias("kind"), F.lit(0).alias("page_no"), F.lit("https://list.org/x").alias("url"), F.concat(head, "html").alias("body"))
    return S.parse_html_links(payloads, within=("h2", "entry-title")).select("source_id", "pos", "url", "title")


@query("s08_parse_id_links")
def s08(b: Bindings):
    return S.parse_id_links(pages_as_payloads(b), 'href="/([A-Za-z]+)"', "https://x.org/d/{id}").select("source_id", "pos", "url")


@query("s09_parse_markdown_all")
def s09_all(b: Bindings):
    k = F.col("page_id")
    link = F.concat(F.lit("* [t]("), F.when(k % 5 == 0, F.concat(F.lit("/rel/"), k.cast("string"), F.lit("#frag"))).otherwise(F.col("url")), F.lit(")"))
    payloads = _packed(b, link).select("source_id", F.lit("markdown").alias("kind"), "page_no", F.lit("https://maps.org/x/y").alias("url"),
                                       F.concat(F.lit("Title: [no](https://no.org)\n\nMarkdown Content:\n"), F.array_join("parts", "\n")).alias("body"))
    return S.parse_markdown_links(payloads, r"\]\(([^)]+)\)").select("source_id", "pos", "url")


@query("s09_parse_markdown_links")
def s09(b: Bindings):
    k = F.col("page_id")
    link = F.concat(F.lit("* [t]("), F.when(k % 5 == 0, F.concat(F.lit("/rel/"), k.cast("string"), F.lit("#frag"))).otherwise(F.col("url")), F.lit(")"))
    payloads = _packed(b, link).select("source_id", F.lit("markdown").alias("kind"), "page_no", F.lit("https://maps.org/x/y").alias("url"),
                                       F.concat(F.lit("Title: [no](https://no.org)\n\nMarkdown Content:\n"), F.array_join("parts", "\n")).alias("body"))
    return S.parse_markdown_links(payloads, r"\]\(([^)]+)\)", 45).select("source_id", "pos", "url")


def _strategies(b: Bindings):
    """Two strategies per source; the filters leave the first one nothing in odd sources."""
    raw = S.parse_rss_items(rss(b)).unionByName(S.parse_wp_json_items(wp(b)))
    kept = S.apply_link_filters(raw, exclude=[r"(?i)/fr/"]).filter((F.col("strategy") != "rss") | (F.col("source_id") % 2 == 0))
    base = b.page_hits.select(F.col("batch_no").alias("source_id")).distinct()
    plan = base.select("source_id", F.explode(F.expr("array(named_struct('strategy','rss','priority',0), named_struct('strategy','wp_json','priority',1))")).alias("p")).select("source_id", "p.*")
    return raw, kept, plan


@query("s10_first_successful_strategy")
def s10(b: Bindings):
    raw, kept, plan = _strategies(b)
    return S.first_successful_strategy(kept, plan).select("source_id", "strategy", "url")


@query("s10_strategy_report")
def s10r(b: Bindings):
    r = S.strategy_report(*_strategies(b))
    return r.select("source_id", "strategy", "item_count", "filtered_count", F.array_join(F.coalesce("sample_urls", F.array().cast("array<string>")), "|").alias("samples"), "ok", "error")


@query("s11_apply_link_filters")
def s11(b: Bindings):
    items = b.page_hits.select(F.col("page_id"), "url", "org", F.col("org").alias("title"))
    return S.apply_link_filters(items, require=[r"^https?://"], include=[r"/en/", r"/de/"], exclude=[r"#top$", r"utm_"], include_title=[r"[13579]$"]).select("page_id", "url")


@query("s12_dedupe_items")
def s12(b: Bindings):
    i = b.page_hits.select((F.col("page_id") % 7).alias("source_id"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 9 == 8, "").otherwise(F.col("url")).alias("url"))
    again = i.select("source_id", (F.col("pos") + 100_000).alias("pos"), F.concat(F.lit(" "), F.upper("url")).alias("url"))
    return S.dedupe_items(i.unionByName(again)).select("source_id", "pos", "url")


@query("s19_calendar_export")
def s19(b: Bindings):
    r = S.calendar_export(b.listings, now())
    return r.select("listing_id", F.md5("ics").alias("ics_md5"), F.regexp_extract("template_url", "(&dates=.*)$", 1).alias("tail"))


@query("u01_parser_registry")
def u01(b: Bindings):
    """All kinds through the registry, counted per strategy."""
    payloads = rss(b).unionByName(wp(b)).unionByName(sitemaps(b)).unionByName(pages_as_payloads(b))
    return S.parse_all(payloads, ["rss", "wp_json", "sitemap", "html"]).groupBy("strategy").agg(F.count("*").alias("n"))


@query("s01_load_tables")
def s01(b: Bindings):
    from fairlead.bindings import BASE_TABLES

    out = None
    for t in BASE_TABLES:
        part = b.view(t).groupBy().agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
