"""Parsers of landed payloads: each turns payload rows into item rows (source_id, pos, url, title, published, summary)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import text as T
from fairlead.functions import urls as U

ITEM = ["source_id", "pos", "url", "title", "published", "summary", "strategy"]
RENDERED = "struct<rendered:string>"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _items(df: DataFrame, strategy: str) -> DataFrame:
    out = df
    for c in ("title", "published", "summary"):
        if c not in df.columns:
            out = out.withColumn(c, F.lit(""))
    return out.withColumn("strategy", F.lit(strategy)).select(*ITEM)


def _pos(payloads: DataFrame) -> Column:
    """Place of an item over all payloads of its source: payload number first, then place inside."""
    return (F.col("page_no").cast("bigint") * F.lit(1 << 32) + F.col("i")).cast("bigint")


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    """All rows, or the first n of each source."""
    if n is None:
        return rows
    return rows.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("pos"))).filter(F.col("n") <= n)


ATOM_LINK = "link:array<struct<_href:string,_rel:string,_VALUE:string>>"


def parse_feed_items(payloads: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Entries of feeds of any kind: RSS, Atom (by its feed element) and RDF (items beside their channel)."""
    body = F.col("body")
    atom, rdf = body.rlike(r"(?s)<feed[\s>]"), body.rlike(r"(?s)<rdf:RDF[\s>]")
    kinds = payloads.withColumn("_kind", F.when(atom, "atom").when(rdf, "rdf").otherwise("rss"))
    rss = parse_rss_items(kinds.filter("_kind = 'rss'"), max_entries)
    return rss.unionByName(_atom_items(kinds.filter("_kind = 'atom'"), max_entries)).unionByName(_rdf_items(kinds.filter("_kind = 'rdf'"), max_entries))


def _entries(found: Column, most: int | None) -> Column:
    return F.posexplode(found if most is None else F.slice(found, 1, most)).alias("i", "e")


def _atom_items(payloads: DataFrame, most: int | None) -> DataFrame:
    schema = f"entry array<struct<{ATOM_LINK},title:string,published:string,updated:string,summary:string,content:string>>"
    flat = payloads.select("source_id", "page_no", _entries(F.from_xml("body", schema, {"rowTag": "feed"})["entry"], most))
    own = F.coalesce(F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("e.link", F.lit(0)))["_href"]
    rows = flat.select("source_id", _pos(flat).alias("pos"), F.trim(_blank(own)).alias("url"), F.trim(_blank(F.col("e.title"))).alias("title"),
                       F.coalesce("e.published", "e.updated", F.lit("")).alias("published"), F.coalesce("e.summary", "e.content", F.lit("")).alias("summary"))
    return _items(rows.filter(F.col("url") != ""), "rss")


def _rdf_items(payloads: DataFrame, most: int | None) -> DataFrame:
    """The prefix of the publication date is its own namespace, so the element is named with it."""
    schema = "item array<struct<link:string,title:string,description:string,`dc:date`:string>>"
    flat = payloads.select("source_id", "page_no", _entries(F.from_xml("body", schema, {"rowTag": "rdf:RDF"})["item"], most))
    rows = flat.select("source_id", _pos(flat).alias("pos"), F.trim(_blank(F.col("e.link"))).alias("url"), F.trim(_blank(F.col("e.title"))).alias("title"),
                       _blank(F.col("e.`dc:date`")).alias("published"), _blank(F.col("e.description")).alias("summary"))
    return _items(rows.filter(F.col("url") != ""), "rss")


def parse_rss_items(payloads: DataFrame, max_entries: int | None = None) -> DataFrame:
    schema = "channel struct<item:array<struct<link:string,title:string,pubDate:string,updated:string,description:string,summary:string>>>"
    parsed = payloads.withColumn("x", F.from_xml("body", schema, {"rowTag": "rss"}))
    entries = F.col("x.channel.item") if max_entries is None else F.slice("x.channel.item", 1, max_entries)
    flat = parsed.select("source_id", "page_no", F.posexplode(entries).alias("i", "e"))
    rows = flat.select("source_id", _pos(flat).alias("pos"), F.trim(_blank(F.col("e.link"))).alias("url"), F.trim(_blank(F.col("e.title"))).alias("title"),
                       F.coalesce("e.pubDate", "e.updated", F.lit("")).alias("published"), F.coalesce("e.summary", "e.description", F.lit("")).alias("summary"))
    return _items(rows.filter(F.col("url") != ""), "rss")


def sitemap_locs(body: Column) -> Column:
    """Locations of a sitemap; of reader text, its links without fragments."""
    locs = F.regexp_extract_all(body, F.lit(r"<loc>([^<]+)</loc>"), F.lit(1))
    after = F.when(F.contains(body, F.lit("Markdown Content:")), F.regexp_extract(body, r"(?s)Markdown Content:(.*)", 1)).otherwise(body)
    marked = F.regexp_extract_all(after, F.lit(r"\((https?://[^)]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(after, F.lit(r"""(https?://[^\s\])"'<>]+)"""), F.lit(1))
    links = F.transform(F.when(F.size(marked) > 0, marked).otherwise(bare), lambda u: F.trim(F.split_part(u, F.lit("#"), F.lit(1))))
    return F.when(F.size(locs) > 0, locs).otherwise(F.array_distinct(F.filter(links, lambda u: u != "")))


def parse_sitemap_locs(payloads: DataFrame, include: Sequence[str] = (), max_urls: int | None = None, max_nested: int | None = None) -> DataFrame:
    """Locations of index payloads and of the nested sitemaps they name, the first one of each address.

    A payload is nested if another one of its source names its address; the rest are indexes. max_nested takes the first
    so many of a source, max_urls its first so many addresses.
    """
    locs = payloads.select("source_id", "page_no", F.col("url").alias("from_url"), F.posexplode(sitemap_locs(F.col("body"))).alias("i", "loc"))
    named = locs.filter(F.col("loc") != F.col("from_url")).select("source_id", F.col("loc").alias("from_url")).distinct()
    top = locs.join(named, ["source_id", "from_url"], "left_anti")
    nested = top.filter(F.col("loc").endswith(".xml")).select("source_id", F.struct(F.lit(1).alias("late"), "page_no", "i").alias("place"), F.col("loc").alias("from_url"))
    if max_nested is not None:
        nested = nested.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("place"))).filter(F.col("n") <= max_nested)
    inner = nested.join(locs.select("source_id", "from_url", F.col("i").alias("k"), "loc"), ["source_id", "from_url"]).select(
        "source_id", F.struct("place.late", "place.page_no", "place.i", "k").alias("pos"), F.col("loc").alias("url"))
    direct = top.filter(~F.col("loc").endswith(".xml")).select("source_id", F.struct(F.lit(0).alias("late"), "page_no", "i", F.lit(0).alias("k")).alias("pos"), F.col("loc").alias("url"))
    both = direct.unionByName(inner)
    if include:
        wanted = F.lit(False)
        for p in include:
            wanted = wanted | F.col("url").rlike(p)
        both = both.filter(wanted)
    # The cap counts before repeated addresses go, as a reader that stops at it would.
    once = _first(both, max_urls).groupBy("source_id", "url").agg(F.min("pos").alias("pos"))
    placed = once.withColumn("pos", (F.col("pos.late").cast("bigint") * F.lit(1 << 62) + F.col("pos.page_no").cast("bigint") * F.lit(1 << 42)
                                     + F.col("pos.i").cast("bigint") * F.lit(1 << 21) + F.col("pos.k")).cast("bigint"))
    return _items(placed.withColumn("title", U.title_from_slug("url")), "sitemap")


def parse_wp_json_items(payloads: DataFrame, category_slugs: Sequence[str] = (), categories: DataFrame | None = None) -> DataFrame:
    """Rendered title, excerpt and link of post lists; optional category filter through its slug table."""
    schema = f"array<struct<link:string,title:{RENDERED},excerpt:{RENDERED},date:string,categories:array<bigint>>>"
    flat = payloads.select("source_id", "page_no", F.posexplode(F.from_json("body", schema)).alias("i", "e"))
    rows = flat.select("source_id", _pos(flat).alias("pos"), F.trim(_blank(F.col("e.link"))).alias("url"), _blank(F.col("e.title.rendered")).alias("title"),
                       _blank(F.col("e.date")).alias("published"), _blank(F.col("e.excerpt.rendered")).alias("summary"), F.col("e.categories").alias("cats")).filter(F.col("url") != "")
    if category_slugs and categories is not None:
        ids = categories.filter(F.lower("slug").isin([s.lower() for s in category_slugs])).select(F.col("id").alias("cat"))
        keep = rows.select("source_id", "pos", F.explode("cats").alias("cat")).join(ids, "cat", "left_semi").select("source_id", "pos").distinct()
        rows = rows.join(keep, ["source_id", "pos"], "left_semi")
    return _items(rows.drop("cats"), "wp_json")


def parse_custom_api_items(payloads: DataFrame, default_base: str = "https://example.org/") -> DataFrame:
    """Posts whose address comes from the link, from category base and slug, or from the thumbnail's file name."""
    thumb = "struct<`thumbnail-square`:string,medium:string,full:string>"
    schema = (f"array<struct<link:string,slug:string,title:{RENDERED},date:string,region:string,`has-deadline`:boolean,deadline:string,"
              f"category:struct<name:string,link:string>,thumbnail:{thumb}>>")
    flat = payloads.select("source_id", "page_no", F.posexplode(F.from_json("body", schema)).alias("i", "e"))

    def file_slug(c: str) -> Column:
        name = F.regexp_extract(_blank(F.col(c)), r"([^/]*)$", 1)
        return F.nullif(F.regexp_replace(F.regexp_replace(name, r"-\d+x\d+(?=\.\w+$)", ""), r"\.\w+$", ""), F.lit(""))

    slug = F.coalesce(F.nullif("e.slug", F.lit("")), file_slug("e.thumbnail.thumbnail-square"), file_slug("e.thumbnail.medium"), file_slug("e.thumbnail.full"))
    base = F.rtrim(F.coalesce(F.nullif("e.category.link", F.lit("")), F.lit(default_base)), F.lit("/"))
    url = F.coalesce(F.nullif(F.trim("e.link"), F.lit("")), F.concat(base, F.lit("/"), slug, F.lit("/")))
    due = F.when(F.col("e.has-deadline"), F.concat(F.lit("Deadline: "), F.date_format(F.timestamp_seconds(F.expr("try_cast(e.deadline AS BIGINT)")), "yyyy-MM-dd")))
    summary = F.concat_ws(" · ", F.concat(F.lit("Region: "), F.nullif("e.region", F.lit(""))), due, F.nullif("e.category.name", F.lit("")))
    rows = flat.select("source_id", _pos(flat).alias("pos"), _blank(url).alias("url"), _blank(F.col("e.title.rendered")).alias("title"), _blank(F.col("e.date")).alias("published"),
                       summary.alias("summary"))
    return _items(rows.filter(F.col("url") != ""), "custom_api")


def parse_search_api_items(payloads: DataFrame, url_template: str) -> DataFrame:
    """Rows of a search answer with a slug; the template holds {slug}."""
    schema = "data array<struct<programTitleSlug:string,programName:string,openDate:string,closeDate:string,blurb:string,programSelfDescription:string>>"
    flat = payloads.select("source_id", "page_no", F.posexplode(F.from_json("body", schema)["data"]).alias("i", "e"))
    slug = F.trim(_blank(F.col("e.programTitleSlug")))
    rows = flat.filter(slug != "").select(
        "source_id", _pos(flat).alias("pos"), F.replace(F.lit(url_template), F.lit("{slug}"), slug).alias("url"), F.trim(_blank(F.col("e.programName"))).alias("title"),
        F.coalesce("e.openDate", "e.closeDate", F.lit("")).alias("published"), F.coalesce("e.blurb", "e.programSelfDescription", F.lit("")).alias("summary"))
    return _items(rows, "search_api")


def elements(body: Column, tag: str, css_class: str = "") -> Column:
    """Elements of a tag, and of a class if one is given, with what they hold. Elements of the same tag don't nest."""
    wanted = rf"""[^>]*\bclass\s*=\s*["\'](?:[^"\']*\s)?{css_class}(?:\s[^"\']*)?["\']""" if css_class else ""
    return F.regexp_extract_all(body, F.lit(rf"(?is)(<{tag}\b{wanted}[^>]*>.*?</{tag}\s*>)"), F.lit(1))


def parse_html_links(payloads: DataFrame, link_pattern: str = "", max_items: int | None = None, within: tuple[str, str] | None = None) -> DataFrame:
    """Anchors as absolute addresses with their text; the pattern selects by the written reference.

    within: (tag, class) of the elements whose anchors count, usually headings. An anchor without text of its own, a
    picture say, then takes the text of its element.
    """
    if within is None:
        flat = payloads.select("source_id", "page_no", F.col("url").alias("base"), F.posexplode(elements(F.col("body"), "a")).alias("i", "tag")).withColumn("around", F.lit(""))
    else:
        outer = payloads.select("source_id", "page_no", F.col("url").alias("base"), F.posexplode(elements(F.col("body"), *within)).alias("k", "around"))
        inner = outer.select("source_id", "page_no", "base", "k", "around", F.posexplode(elements(F.col("around"), "a")).alias("j", "tag"))
        flat = inner.withColumn("i", F.col("k").cast("bigint") * 65536 + F.col("j"))
    flat = flat.withColumn("href", F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1)).filter(F.col("href") != "")
    if link_pattern:
        flat = flat.filter(F.col("href").rlike(link_pattern))
    title = F.coalesce(F.nullif(T.strip_html("tag"), F.lit("")), T.strip_html("around"))
    rows = flat.select("source_id", _pos(flat).alias("pos"), U.absolute_url(F.col("href"), F.col("base")).alias("url"), title.alias("title")).filter(F.col("url").startswith("http"))
    return _items(_first(rows, max_items), "html")


def parse_id_links(payloads: DataFrame, id_pattern: str, url_template: str = "") -> DataFrame:
    """Distinct ids of each page in order, as addresses; without a template the page's own with detail=id."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(id_pattern), F.lit(1))))
    flat = payloads.select("source_id", "page_no", F.col("url").alias("base"), F.posexplode(ids).alias("i", "id"))
    own = F.concat(F.regexp_extract("base", "^([^?#]*)", 1), F.lit("?detail="), F.col("id"))
    url = F.replace(F.lit(url_template), F.lit("{id}"), F.col("id")) if url_template else own
    return _items(flat.select("source_id", _pos(flat).alias("pos"), url.alias("url")), "html_paginated")


def parse_markdown_links(payloads: DataFrame, link_pattern: str, max_items: int | None = None) -> DataFrame:
    """Links of reader markdown after its content marker, absolute and without fragment."""
    body = F.when(F.contains("body", F.lit("Markdown Content:")), F.trim(F.regexp_extract("body", r"(?s)Markdown Content:(.*)", 1))).otherwise(F.col("body"))
    flat = payloads.select("source_id", "page_no", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all(body, F.lit(link_pattern), F.lit(1))).alias("i", "raw"))
    clean = F.trim(F.regexp_replace(F.trim("raw"), r"""^["']+|["']+$""", ""))
    full = F.when(clean.startswith("http"), F.regexp_extract(clean, r"""^([^"']*)""", 1)).otherwise(U.absolute_url(clean, F.col("base")))
    rows = flat.select("source_id", _pos(flat).alias("pos"), F.trim(F.split_part(full, F.lit("#"), F.lit(1))).alias("url"))
    return _items(_first(rows, max_items), "markdown")


# Parser by payload kind; register() adds further kinds.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rss": parse_feed_items, "sitemap": parse_sitemap_locs, "wp_json": parse_wp_json_items, "custom_api": parse_custom_api_items, "html": parse_html_links,
}


def register(kind: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[kind] = parser


def parse_all(payloads: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Items of every payload by the parser of its kind; unknown kinds yield nothing."""
    out = None
    for kind in kinds or sorted(PARSERS):
        part = PARSERS[kind](payloads.filter(F.col("kind") == kind))
        out = part if out is None else out.unionByName(part)
    return out


def dedupe_items(items: DataFrame) -> DataFrame:
    """First item per source and case-blind address, as one combining aggregate."""
    key = F.lower(F.trim(F.coalesce("url", F.lit(""))))
    rest = [c for c in items.columns if c not in ("source_id", "pos")]
    first = items.withColumn("_k", key).filter(F.col("_k") != "").groupBy("source_id", "_k").agg(F.min_by(F.struct("pos", *rest), F.struct("pos", "url")).alias("f"))
    return first.select("source_id", "f.pos", *[F.col(f"f.{c}").alias(c) for c in rest])


def apply_link_filters(items: DataFrame, require: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), include_title: Sequence[str] = ()) -> DataFrame:
    def any_of(c: str, patterns: Sequence[str]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            if p:
                hit = hit | F.coalesce(F.col(c), F.lit("")).rlike(p)
        return hit

    out = items
    for column, patterns in (("url", require), ("url", include), ("title", include_title)):
        if patterns:
            out = out.filter(any_of(column, patterns))
    return out.filter(~any_of("url", exclude)) if exclude else out


def strategy_report(raw: DataFrame, filtered: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per (source_id, strategy, priority) of the plan: counts, three sample addresses, outcome."""
    n_raw = raw.groupBy("source_id", "strategy").agg(F.count("*").alias("item_count"))
    place = F.row_number().over(W.partitionBy("source_id", "strategy").orderBy("pos"))
    samples = filtered.withColumn("n", place).filter(F.col("n") <= 3).groupBy("source_id", "strategy").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda s: s["url"]).alias("sample_urls"))
    n_kept = filtered.groupBy("source_id", "strategy").agg(F.count("*").alias("filtered_count"))
    keys = ["source_id", "strategy"]
    out = plan.join(n_raw, keys, "left").join(n_kept, keys, "left").join(samples, keys, "left").na.fill(0, ["item_count", "filtered_count"])
    return out.withColumn("ok", F.col("filtered_count") > 0).withColumn("error", F.when(~F.col("ok"), "no items after filters"))


def first_successful_strategy(filtered: DataFrame, plan: DataFrame) -> DataFrame:
    """Items of the first strategy of each source that has any after filters."""
    live = filtered.select("source_id", "strategy").distinct().join(plan, ["source_id", "strategy"])
    winner = live.groupBy("source_id").agg(F.min_by("strategy", "priority").alias("strategy"))
    return filtered.join(winner, ["source_id", "strategy"], "left_semi")


def calendar_export(listings: DataFrame, as_of: Column, product: str = "-//Fairlead//EN") -> DataFrame:
    """VCALENDAR text and calendar template address per dated listing; the uid derives from the listing."""
    def esc(c: Column) -> Column:
        return F.replace(F.regexp_replace(c, r"([\;,])", r"\\$1"), F.lit("\n"), F.lit("\\n"))

    day, nxt = F.date_format("deadline", "yyyyMMdd"), F.date_format(F.col("deadline") + F.make_dt_interval(F.lit(1)), "yyyyMMdd")
    title, url = F.col("title"), F.coalesce("url", F.lit(""))
    ics = F.concat(F.concat_ws(
        "\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:"), esc(title)),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), day), F.concat(F.lit("DTEND;VALUE=DATE:"), nxt), F.concat(F.lit("DTSTAMP:"), F.date_format(as_of, "yyyyMMdd'T'HHmmss'Z'")),
        F.concat(F.lit("UID:"), F.sha2(F.col("listing_id").cast("string"), 256), F.lit("@fairlead")), F.concat(F.lit("DESCRIPTION:Application deadline\\n"), esc(url)), F.concat(F.lit("URL:"), url),
        F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), F.concat(F.lit("DESCRIPTION:Deadline reminder: "), esc(title)), F.lit("TRIGGER:-P1D"), F.lit("END:VALARM"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR")), F.lit("\r\n"))
    link = F.concat(F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")), F.lit("&dates="), day, F.lit("/"), nxt,
                    F.lit("&details="), F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))
    return listings.filter(F.col("deadline").isNotNull()).select("listing_id", ics.alias("ics"), link.alias("template_url"))
