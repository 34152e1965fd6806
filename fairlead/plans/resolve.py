"""De-duplication and upsert queries: one batch of listings against the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.operators import resolve as X
from fairlead.operators.titles import similar_titles
from fairlead.plans.registry import query


def now():
    return F.lit(AS_OF).cast("timestamp")


def batch(b: Bindings) -> DataFrame:
    """Every listing comes in again: some under their address, some under a new one, some with a small typo."""
    i = F.col("listing_id")
    return b.listings.select(
        (i + 10_000_000).alias("item_id"), ((F.col("source_id") + (i % 2)) % 20).alias("source_id"), i.alias("pos"),
        F.when(i % 3 == 0, F.concat("title", F.lit("x"))).otherwise(F.col("title")).alias("title"), "institution", "deadline", "summary",
        F.when(i % 4 == 0, F.col("url_hash")).when(i % 4 == 1, F.sha2(F.concat(F.lit("new"), (i - i % 8).cast("string")), 256))
        .otherwise(F.sha2(F.concat(F.lit("new"), i.cast("string")), 256)).alias("url_hash"))


@query("d01_exact_match")
def d01(b: Bindings):
    return X.exact_match(batch(b), b.listings).select("item_id", "exact_id")


@query("d02_fuzzy_title_match")
def d02(b: Bindings):
    return X.fuzzy_title_match(batch(b), b.listings).select("item_id", "fuzzy_id", F.round("ratio", 4).alias("ratio"))


@query("d02_recent_window")
def d02w(b: Bindings):
    """The same among the most recently seen listings only."""
    return X.fuzzy_title_match(batch(b), b.listings, window=X.RECENT_WINDOW).select("item_id", "fuzzy_id", F.round("ratio", 4).alias("ratio"))


@query("j09_similar_titles")
def j09(b: Bindings):
    """All pairs of distinct titles of listings with the ratio at which they count as similar."""
    titles = b.listings.select(F.lower("title").alias("t"))
    return similar_titles(titles, titles, 92.0).select(F.col("lt").alias("title"), F.col("rt").alias("other"), F.round("ratio", 4).alias("ratio"))


@query("d02_prefilter")
def d02p(b: Bindings):
    from fairlead.functions.similarity import may_reach

    p = b.listings.select("listing_id", F.lower("title").alias("t"), F.lower(F.concat("title", F.lit(" extra words"))).alias("o"))
    return p.select("listing_id", may_reach(F.col("t"), F.col("o"), 92.0).alias("may"))


@query("d03_resolve_upsert")
def d03(b: Bindings):
    return X.resolve_upsert(batch(b), b.listings).select("item_id", "action", "target_id", "duplicate_of", "first_item", "shadow_of_item")


@query("d03_new_batch")
def d03n(b: Bindings):
    """New items only: what a batch does to itself, without listings."""
    new = batch(b).withColumn("url_hash", F.sha2(F.concat(F.lit("in batch "), (F.col("pos") - F.col("pos") % 8).cast("string")), 256))
    return X.resolve_upsert(new, b.listings.limit(0)).select("item_id", "action", "first_item", "shadow_of_item")


def updates(b: Bindings) -> DataFrame:
    i = F.col("listing_id")
    return b.listings.filter(i % 3 != 2).select(
        "listing_id", F.when(i % 2 == 0, F.col("deadline") + F.make_dt_interval(F.lit(5))).alias("n_deadline"),
        F.when(i % 4 == 0, F.concat(F.coalesce("summary", F.lit("")), F.lit(" longer"))).otherwise("short").alias("n_summary"),
        F.when(i % 5 == 0, F.col("content_hash")).otherwise("changed").alias("n_content_hash"), F.when(i % 6 == 0, "full").otherwise("").alias("n_funding"),
        F.when(i % 7 == 0, T.str_array(["PhD"])).otherwise(T.no_strings()).alias("n_degrees"), F.lit("grant").alias("n_type"),
        F.when(i % 9 == 0, F.create_map(F.lit("gate"), F.lit("admit"), F.lit("run"), F.lit("2"))).alias("n_meta"))


def stored(b: Bindings) -> DataFrame:
    log = F.transform(F.sequence(F.lit(1), (F.col("listing_id") % 25 + 1).cast("int")), lambda k: F.struct(
        F.lit("deadline").alias("field"), F.lit(None).cast("string").alias("from"), k.cast("string").alias("to")))
    return b.listings.withColumns({"field_changes": log, "meta": F.create_map(F.lit("gate"), F.lit("old"), F.lit("kept"), F.lit("1"))})


@query("d04_apply_updates")
def d04(b: Bindings):
    r = X.apply_updates(stored(b), updates(b), now())
    return r.select("listing_id", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), F.length("summary").cast("bigint").alias("summary_length"), "content_hash", "funding_type",
                    T.joined(F.col("degree_levels")).alias("degrees"), "opportunity_type", F.size("field_changes").cast("bigint").alias("changes"),
                    F.get("field_changes", F.lit(0))["to"].alias("oldest"), F.try_element_at("meta", F.lit("gate")).alias("gate"), F.size("meta").cast("bigint").alias("meta_size"), "updated")


@query("d05_record_also_seen")
def d05(b: Bindings):
    def entry(s):
        return F.struct(s.cast("bigint").alias("source_id"), F.concat(F.lit("src"), s.cast("string")).alias("registry_id"), F.concat(F.lit("Source "), s.cast("string")).alias("name"))

    n = (F.col("listing_id") % 12).cast("int")
    seen = F.when(n == 0, F.array().cast(f"array<{X.ENTRY}>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), entry))
    src = F.col("listing_id") % 20
    out = X.record_also_seen(seen, entry(src), F.col("source_id"), src)
    return b.listings.select("listing_id", T.joined(F.transform(out, lambda e: e["registry_id"])).alias("seen"))


def raw_docs(b: Bindings) -> DataFrame:
    i = F.col("listing_id")
    return b.listings.select(i.alias("doc_id"), F.when(i % 3 == 0, F.col("url_hash")).otherwise(F.sha2(F.concat(F.lit("r"), i.cast("string")), 256)).alias("url_hash"),
                             F.when(i % 3 == 1, F.concat("title", F.lit("!"))).otherwise(F.concat(F.lit("Unseen backlog title "), F.md5(i.cast("string")))).alias("title"),
                             F.col("summary"), F.coalesce("summary", F.lit("none")).alias("raw_content"), (i % 2 == 0).alias("processed"), "content_hash", (i % 4 == 0).alias("detail_fetched"))


@query("d06_normalize_backlog")
def d06(b: Bindings):
    return X.normalize_backlog(raw_docs(b), b.listings).select("doc_id", "action", "opportunity_type")


@query("d06_one_call")
def d06c(b: Bindings):
    """One call of the backlog job, which takes so many documents and characters."""
    return X.normalize_backlog(raw_docs(b), b.listings, limit=X.BACKLOG, body=X.BODY).select("doc_id", "action", "opportunity_type")


@query("d07_merge_snapshot")
def d07(b: Bindings):
    i = F.col("listing_id")
    changes = b.listings.filter(i % 3 == 0).select(F.when(i % 2 == 0, i).otherwise(i + 10_000_000).alias("listing_id"), F.concat("title", F.lit(" v2")).alias("title"), "source_id")
    return X.merge_snapshot(b.listings.select("listing_id", "title", "source_id"), changes)


@query("d08_org_domain_upsert")
def d08(b: Bindings):
    def rows(offset):
        k = F.col("page_id") + offset
        return b.page_hits.select(U.org_key(F.col("org")).alias("org_key"), U.bare_host(F.col("host")).alias("canonical_domain"), F.when(k % 4 != 0, F.col("url")).alias("canonical_url"),
                                  ((k % 10) / 10.0).alias("confidence"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + offset).alias("verified_at"))

    return X.org_domain_upsert(rows(0), rows(1).filter(F.col("org_key") < "institute 3")).select("org_key", "canonical_domain", "canonical_url", "confidence")


@query("d08_domain_legitimacy_upsert")
def d08b(b: Bindings):
    hosts = b.page_hits.groupBy(U.bare_host(F.col("host")).alias("domain")).agg(F.min("page_id").alias("k"))
    cache = hosts.filter("k % 3 <> 0").select("domain", ((F.col("k") % 10) / 10.0).alias("trust_score"), F.when(F.col("k") % 2 == 0, F.lit("2015-01-01").cast("timestamp")).alias("registered_at"),
                                              (now() - F.make_dt_interval((F.col("k") % 180).cast("int"))).alias("last_checked_at"))
    fresh = hosts.filter("k % 5 <> 0").select("domain", F.lit(0.75).alias("trust_score"), F.when(F.col("k") % 4 == 0, F.lit("2020-01-01").cast("timestamp")).alias("registered_at"))
    return X.domain_legitimacy_upsert(cache, fresh, now()).select("domain", "trust_score", F.date_format("registered_at", "yyyy-MM-dd").alias("registered"), "kept")


@query("s15_append_raw_documents")
def s15(b: Bindings):
    new = raw_docs(b)
    existing = new.filter("doc_id % 5 = 0").select("url_hash", "content_hash")
    return X.append_raw_documents(new, existing).select("url_hash", "content_hash")


@query("p02_changed_documents")
def p02c(b: Bindings):
    """Documents whose content hash appears more than once: exact copies, counted per hash."""
    return b.listings.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("listing_id").alias("first_id")).filter("copies > 1")
