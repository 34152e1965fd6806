"""Source discovery and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.operators import discovery as C
from fairlead.operators import metrics as M
from fairlead.plans.registry import query


def now():
    return F.lit(AS_OF).cast("timestamp")


def reviewed(b: Bindings) -> DataFrame:
    """Candidates from earlier rounds: one per host."""
    h = b.page_hits.groupBy(U.bare_host(F.col("host")).alias("domain")).agg(F.min("page_id").alias("candidate_id"))
    k = F.col("candidate_id")
    return h.select("domain", "candidate_id", F.when(k % 4 == 0, "approved").when(k % 4 == 1, "rejected").when(k % 4 == 2, "new").otherwise("draft").alias("status"),
                    F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Source "), (k % 60).cast("string"))).alias("name"),
                    F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.lit("rss").alias("source_type"),
                    F.when(k % 3 == 0, "recurring_source").when(k % 3 == 1, "unclear").otherwise("one_off_page").alias("verdict"),
                    ((k * 7 % 100) / 100.0).alias("confidence"), (k % 6).alias("run_id"))


def hits(b: Bindings) -> DataFrame:
    snippet = F.concat(F.lit("Search our scholarship database, "), F.when(F.col("page_id") % 3 == 0, "phd funding").otherwise("news"))
    return b.page_hits.select(F.col("page_id").alias("pos"), "url", "title", snippet.alias("snippet"))


@query("c01_excluded_domains")
def c01(b: Bindings):
    return C.excluded_domains(b.sources, reviewed(b))


@query("c02_candidate_domains")
def c02(b: Bindings):
    r = C.candidate_domains(hits(b), C.excluded_domains(b.sources, reviewed(b)), 20)
    return r.select("domain", "discovered_url", F.md5("title").alias("title_md5"), F.round(F.col("pre_rank_score") + 1e-9, 4).alias("score"))


@query("c03_domain_score")
def c03(b: Bindings):
    d = F.when(F.col("pos") % 5 == 0, F.concat(U.extract_domain("url"), F.lit(".ac.uk"))).when(F.col("pos") % 5 == 1, "reddit.com").otherwise(U.extract_domain("url"))
    return hits(b).select("pos", F.round(C.domain_score(d, F.col("snippet"), F.col("title")) + 1e-9, 4).alias("score"))


def structured(b: Bindings) -> DataFrame:
    """Pages, some with feed links and listing anchors added."""
    extra = (F.when(F.col("page_id") % 4 == 0, F.concat(F.when(F.col("page_id") % 8 == 0, '<link rel="alternate" type="application/rss+xml" href="/feed">').otherwise('<link href="/feed">'), F.lit('<a href="/scholarship/1">x</a>')))
             .when(F.col("page_id") % 4 == 1, F.lit('<a href="/grant/1">a</a><a href="grant/2">b</a><a href="/2026/x">c</a><a href="#top">t</a><a href="https://other.org/grant/9">o</a><div class="x category"><p><a href="#c">c</a></p></div><nav>none</nav>'))
             .when(F.col("page_id") % 4 == 2, F.lit('<a href="/funding/1">a</a><a href="/funding/2">a</a><a href="/funding/3">a</a><a href="/funding/4">a</a><a href="/funding/5">a</a><a href="mailto:a@b.c">m</a>')).otherwise(F.lit("")))
    return b.pages.select("page_id", "url", F.concat(extra, "html").alias("html"))


@query("c04_page_structure")
def c04(b: Bindings):
    s = C.page_structure(structured(b))
    return s.select("page_id", "has_rss_feed", F.col("listing_link_count").cast("bigint").alias("links"), F.get("sample_listing_urls", F.lit(0)).alias("first_link"),
                    F.get("rss_urls", F.lit(0)).alias("feed"), "has_pagination", F.col("suggested_link_selector").isNotNull().alias("selector"))


@query("c05_recurring_structure")
def c05(b: Bindings):
    return C.page_structure(structured(b)).select("page_id", C.recurring_structure().alias("recurring"))


@query("c06_candidate_evaluation")
def c06(b: Bindings):
    s = C.page_structure(structured(b)).filter(F.col("page_id") % 10 != 9)
    j = b.pages.select("page_id", "url").join(s, "page_id", "left")
    e = C.candidate_evaluation(j).withColumn("verdict", F.when(F.col("page_id") % 8 == 3, "recurring_source").otherwise(F.col("verdict")))
    return C.downgrade_unsupported(e).select("page_id", "verdict", F.col("confidence").cast("double").alias("confidence"), "structure_type", "evidence_summary",
                                             F.get_json_object("parser_config", "$.discover.kind").alias("kind"))


@query("c07_strong_recurring")
def c07(b: Bindings):
    return C.strong_recurring(reviewed(b))


@query("c08_order_candidates")
def c08(b: Bindings):
    return reviewed(b).orderBy(*C.candidate_order()).select("domain", "verdict")


@query("c09_promote_candidates")
def c09(b: Bindings):
    taken = b.sources.select(C.registry_slug(F.col("name"), F.lit("")).alias("registry_id"))
    return C.promote_candidates(reviewed(b), taken).select("registry_id", "name", "url", "chip_label", "confidence")


def asking_users(b: Bindings) -> DataFrame:
    u = F.col("user_id")
    return b.profiles.select("user_id", F.when(u % 4 == 0, "MSc").when(u % 4 == 1, "PhD").when(u % 4 == 2, "Fellowship").otherwise("Internship").alias("target_degree"),
                             "target_regions", F.when(u % 3 == 0, T.str_array(["Chip 1", "LinkedIn"])).when(u % 3 == 1, T.str_array(["Web 4"])).otherwise(T.no_strings()).alias("search_sources"),
                             (u % 2 == 0).alias("developing"))


CHIPS = {"Chip 1": "src1", "Web 4": "src4"}


def scored_sources(b: Bindings) -> DataFrame:
    from fairlead.plans.metrics import _thin

    stats = M.outcome_bonus(_thin(b)).select(F.concat(F.lit("src"), F.col("source_id").cast("string")).alias("registry_id"), "bonus", "bonus_reason")
    return C.score_sources(asking_users(b), b.sources, stats, CHIPS, "src8")


def chosen_sources(b: Bindings) -> DataFrame:
    return C.select_sources(scored_sources(b))


@query("c10_score_sources")
def c10(b: Bindings):
    return scored_sources(b).select("user_id", "source", "score", T.joined(F.col("reasons")).alias("reasons"))


@query("c11_select_sources")
def c11(b: Bindings):
    return chosen_sources(b).select("user_id", "source", F.col("priority").cast("bigint").alias("priority"), "user_selected", "selection_reason")


def selection(b: Bindings) -> DataFrame:
    """Selected sources of all users, some under an id the table does not have yet."""
    s = chosen_sources(b).join(b.sources.select(F.col("registry_id").alias("source"), "url", "name"), "source")
    extra = b.profiles.select("user_id", F.lit("extra1").alias("source"), F.lit("https://extra.org/feed/").alias("url"), F.lit("Extra").alias("name")).filter("user_id % 9 = 0")
    moved = b.profiles.select("user_id", F.lit("moved").alias("source"), F.lit("https://www.site19.org/feed/").alias("url"), F.lit("Moved").alias("name")).filter("user_id % 9 = 1")
    return s.select("user_id", "source", "url", "name").unionByName(extra).unionByName(moved).withColumnRenamed("source", "registry_id")


@query("c12_activate_sources")
def c12(b: Bindings):
    """Every third source has left the catalog, and every fifth never had an id."""
    stored = b.sources.withColumn("registry_id", F.when(F.col("id") % 5 != 4, F.col("registry_id")))
    return C.activate_sources(selection(b), stored, b.sources.filter(F.col("id") % 3 != 2))


@query("c13_profile_ingest_sources")
def c13(b: Bindings):
    return C.profile_ingest_sources(selection(b), b.sources)


@query("c14_due_sources")
def c14(b: Bindings):
    nxt = C.next_fetch(now(), F.col("fetch_interval_minutes"))
    return C.due_sources(b.sources, now()).select("id", F.date_format(nxt, "yyyy-MM-dd HH:mm").alias("next_after"))


def registry_entries(b: Bindings) -> DataFrame:
    i = F.col("id")
    conf = (F.when(i % 4 == 0, F.create_map(F.lit("kind"), F.lit("rss"), F.lit("feed_urls"), F.col("url"), F.lit("extract"), F.lit("{}")))
            .when(i % 4 == 1, F.create_map(F.lit("kind"), F.lit("hybrid"), F.lit("extract"), F.lit("{}")))
            .when(i % 4 == 2, F.create_map(F.lit("kind"), F.lit("gopher"))).otherwise(F.create_map().cast("map<string,string>")))
    return b.sources.select("id", "registry_id", F.when(i % 7 != 3, F.col("name")).alias("name"), F.when(i % 5 == 4, "ftp://x").otherwise(F.col("url")).alias("url"), "source_type", "authority",
                            F.when(i % 3 != 0, F.concat(F.lit("adapter"), i.cast("string"))).alias("adapter_id"), F.lit("http").alias("fetch_mode"), conf.alias("parser_config"))


@query("s14_resolve_source_config")
def s14(b: Bindings):
    own = b.sources.select("registry_id", "url", F.when(F.col("id") % 2 == 0, "own").alias("adapter_id"), F.lit("").alias("fetch_mode"), F.when(F.col("id") % 2 == 1, F.col("authority")).alias("authority"),
                           F.when(F.col("id") % 3 == 0, F.create_map(F.lit("note"), F.lit("mine"))).alias("parser_config"))
    r = C.resolve_source_config(own, registry_entries(b).withColumn("authority", F.lit(0.9)))
    pairs = F.transform(F.array_sort(F.map_entries("parser_config")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return r.select("registry_id", "adapter_id", "fetch_mode", "authority", T.joined(pairs).alias("config"))


@query("s17_normalize_source_url")
def s17(b: Bindings):
    listed = F.when(F.col("id") % 2 == 0, F.array("url")).otherwise(F.array("url", F.lit("https://mirror.org")))
    return b.sources.select("id", C.source_url(listed).alias("url"))


@query("s18_validate_registry")
def s18(b: Bindings):
    return C.validate_registry(registry_entries(b))


@query("j07_semi_selected_sources")
def j07(b: Bindings):
    return C.profile_ingest_sources(selection(b), b.sources).select("id").distinct()


@query("j10_registry_lookup")
def j10(b: Bindings):
    return b.listings.join(b.sources.select(F.col("id").alias("source_id"), "name", "authority"), "source_id", "left").select("listing_id", "name", "authority")
