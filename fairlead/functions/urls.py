"""URL and domain functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.text import any_contains, col, str_array
from fairlead.rules import fact_rules as fr

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def url_parts(url: Column | str) -> dict[str, Column]:
    u = F.trim(F.coalesce(col(url), F.lit("")))
    rest = F.regexp_replace(u, _SCHEME, "")
    return {
        "scheme": F.regexp_extract(u, _SCHEME, 1),
        "netloc": F.regexp_extract(rest, r"^//([^/?#]*)", 1),
        "path": F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def canonicalize_url(url: Column | str, strip_params: Sequence[str] = ()) -> Column:
    """Stable address: lower scheme and host, no www, no fragment, first non-blank value per kept key.

    Values stay in their transmitted encoding, so one address has one form.
    """
    p = url_parts(url)
    pairs = F.transform(F.split(p["query"], "&"), lambda kv: F.struct(
        F.split_part(kv, F.lit("="), F.lit(1)).alias("k"), F.regexp_extract(kv, "=(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda s: (s["v"] != "") & ~F.array_contains(str_array(strip_params), s["k"]))
    keys = F.transform(kept, lambda s: s["k"])
    first = F.filter(kept, lambda s, i: F.array_position(keys, s["k"]) == i + 1)
    query = F.array_join(F.transform(first, lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    path = F.rtrim(p["path"], F.lit("/"))
    out = F.concat(
        F.when(p["scheme"] == "", "https").otherwise(F.lower(p["scheme"])), F.lit("://"), bare_host(p["netloc"]),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.trim(F.coalesce(col(url), F.lit(""))) == "", F.lit("")).otherwise(out)


def hash_content(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def hash_url(url: Column | str) -> Column:
    return F.sha2(F.lower(F.trim(col(url))), 256)


def extract_domain(url: Column | str) -> Column:
    p = url_parts(url)
    host = bare_host(F.when(p["netloc"] == "", p["path"]).otherwise(p["netloc"]))
    return F.nullif(host, F.lit(""))


def title_from_slug(url: Column | str) -> Column:
    path = F.trim(url_parts(url)["path"], F.lit("/"))
    slug = F.element_at(F.split(path, "/"), -1)
    words = F.trim(F.replace(slug, F.lit("-"), F.lit(" ")))
    titled = F.array_join(F.transform(
        F.regexp_extract_all(words, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda w: F.initcap(w)), "")
    return F.when(slug.isin("", "fellowship", "fellowships", "scholarships"), F.lit("")).otherwise(titled)


def is_institutional(domain: Column) -> Column:
    return F.coalesce(any_contains(F.lower(domain), fr.INSTITUTIONAL_TOKENS), F.lit(False))


def is_non_primary(domain: Column) -> Column:
    d = F.lower(F.coalesce(domain, F.lit("")))
    known = str_array(fr.NON_PRIMARY_DOMAINS)
    return (d == "") | F.exists(known, lambda k: (d == k) | F.endswith(d, F.concat(F.lit("."), k)))


def org_key(name: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.substring(F.trim(F.regexp_replace(clean, r"\s+", " ")), 1, 255)


def guess_org_name(title: Column, institution: Column) -> Column:
    """The institution when named; else the title before the usual kind words."""
    t = F.trim(F.coalesce(title, F.lit("")))
    for suffix in fr.ORG_SUFFIXES:
        t = F.split_part(t, F.lit(suffix), F.lit(1))
    t = F.substring(t, 1, 255)
    inst = F.trim(F.coalesce(institution, F.lit("")))
    return F.when(F.length(inst) > 2, inst).when(t != "", t).otherwise("Unknown organization")


def domain_matches_org(domain: Column, org: Column) -> Column:
    core = F.regexp_replace(F.regexp_replace(F.lower(domain), r"\.[^.]*$", ""), "[^a-z0-9]", "")
    words = F.filter(F.split(F.lower(org), "[^a-z0-9]+"), lambda t: (F.length(t) >= 4)
                     & ~F.array_contains(str_array(fr.ORG_STOPWORDS), t) & ~F.regexp_like(t, F.lit("^[0-9]+$")))
    present = F.filter(words, lambda t: F.contains(core, t))
    pair = F.concat(F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    return F.coalesce(
        (core != "") & (F.exists(present, lambda t: F.length(t) >= 8) | (F.size(present) >= 2)
                        | F.contains(core, pair)), F.lit(False))


def is_article_url(url: Column | str) -> Column:
    path = url_parts(url)["path"]
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return ((F.length(path) > 80) & (slashes >= 3)) | path.rlike(fr.ARTICLE_PATH)


def best_url_for_domain(url: Column | str) -> Column:
    p = url_parts(url)
    return F.when(is_article_url(url), F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit("/"))).otherwise(col(url))


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a reference against a page address (absolute, scheme-relative, rooted or relative)."""
    b = url_parts(base)
    origin = F.concat(b["scheme"], F.lit("://"), b["netloc"])
    folder = F.concat(origin, F.regexp_replace(F.concat(F.lit("/"), F.ltrim(b["path"], F.lit("/"))), "[^/]*$", ""))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(b["scheme"], F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .when(F.startswith(href, F.lit("?")), F.concat(origin, b["path"], href))
            .otherwise(F.concat(folder, href)))
