"""Text normalisation, term evidence and keyword rules as Column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.rules import fact_rules as fr
from fairlead.rules import gate_rules as gr

def no_strings() -> Column:
    return F.array().cast("array<string>")


def _fold_tables() -> tuple[str, str, list[dict[str, str]]]:
    """Characters that stand for one other character once taken apart and stripped of marks, and those for several."""
    src, dst, several = [], [], []
    for cp in (*range(0xA0, 0x3400), *range(0xFB00, 0xFB07), *range(0xFE50, 0xFFF0)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == ch or unicodedata.combining(ch) or "HANGUL" in unicodedata.name(ch, ""):
            continue
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
        elif base:
            several.append({"k": ch, "v": base})
    return "".join(src), "".join(dst), several


_FOLD_FROM, _FOLD_TO, _SEVERAL = _fold_tables()
_OF_SEVERAL = "".join(x["k"] for x in _SEVERAL)


def _around(chars: str, gap: int = 64) -> str:
    """A pattern class of few ranges that has all these characters, and others beside them."""
    ends: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if ends and cp - ends[-1][1] <= gap:
            ends[-1][1] = cp
        else:
            ends.append([cp, cp])
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ends) + "]"


_NEAR_SEVERAL = _around(_OF_SEVERAL)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it many times inside an expression.

    Array functions re-evaluate every outer expression per element, so costly inputs are bound first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(value, ddl: str) -> Column:
    """A nested constant as one literal, folded at planning time: keeps plans small for long word lists."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def str_array(items: Iterable[str]) -> Column:
    return literal(list(items), "array<string>")


def normalize_text(text: Column | str) -> Column:
    """Accent-free lower case with punctuation as single spaces. Ligatures, fractions and the like are replaced one by
    one, in the rare texts that hold any; a text of ASCII only has nothing to fold."""
    raw = F.coalesce(col(text), F.lit(""))
    table = literal(_SEVERAL, "array<struct<k:string,v:string>>")
    # Looked up in a table character by character; a pattern class of this size is tried member by member.
    some = F.regexp_like(raw, F.lit(_NEAR_SEVERAL)) & (F.length(F.translate(raw, _OF_SEVERAL, "")) < F.length(raw))
    apart = F.when(some, F.aggregate(table, raw, lambda t, x: F.replace(t, x["k"], x["v"]))).otherwise(raw)
    folded = F.regexp_replace(F.translate(apart, _FOLD_FROM, _FOLD_TO), r"\p{M}", "")
    plain = F.when(F.octet_length(raw) == F.length(raw), raw).otherwise(folded)
    # One pattern for both: the class of the ASCII characters alone is ten times slower in Java than that of all letters.
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_$€£%.,/+\-]+", " "))


def normalize_py(term: str | None) -> str:
    """The same for terms known at planning time."""
    apart = unicodedata.normalize("NFKD", term or "")
    kept = [c if c.isalnum() or c in gr.KEPT_MARKS else " " for c in apart.lower() if not unicodedata.combining(c)]
    return " ".join("".join(kept).split())


def url_words(url: Column | str) -> Column:
    return normalize_text(F.translate(F.coalesce(col(url), F.lit("")), "/-", "  "))


_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-/&~#])")


def term_pattern(term: str) -> str:
    """Word-boundary pattern of a term known at planning time; words may be joined by blanks, - or /."""
    words = normalize_py(term).split(" ")
    return "(?<![a-z0-9])" + r"[\s\-/]*".join(_SPECIAL.sub(r"\\\1", w) for w in words) + "(?![a-z0-9])"


def term_rules(terms: Sequence[str]) -> Column:
    """Literal array of (term, first and last word, pattern, plain); duplicates by normalised form keep the first.

    A plain term is one run of letters and digits, so it matches exactly where it is a whole token.
    """
    seen: dict[str, str] = {}
    for t in terms:
        key = normalize_py(t)
        if key and key not in seen:
            seen[key] = t
    rules = [{"term": t, "word": k.split(" ")[0], "last": k.split(" ")[-1], "pattern": term_pattern(t), "plain": bool(re.fullmatch("[a-z0-9]+", k))}
             for k, t in seen.items()]
    return literal(rules, "array<struct<term:string,word:string,last:string,pattern:string,plain:boolean>>")


def term_rules_from(terms: Column | str) -> Column:
    """The same for terms that are data (an array column), in array order, first of each normal form."""
    typed = F.filter(F.transform(col(terms), lambda t: F.struct(t.alias("term"), normalize_text(t).alias("key"))),
                     lambda s: s["key"] != "")
    firsts = let(typed, lambda all_: let(F.transform(all_, lambda s: s["key"]), lambda keys: F.filter(
        all_, lambda s, i: F.array_position(keys, s["key"]) == i + 1)))
    return F.transform(firsts, lambda s: F.struct(
        s["term"].alias("term"),
        F.split_part(s["key"], F.lit(" "), F.lit(1)).alias("word"),
        F.split_part(s["key"], F.lit(" "), F.lit(-1)).alias("last"),
        F.concat(
            F.lit("(?<![a-z0-9])"),
            F.replace(F.regexp_replace(s["key"], r"([\\.^$|?*+()\[\]{}\-/])", r"\\$1"), F.lit(" "), F.lit(r"[\s\-/]*")),
            F.lit("(?![a-z0-9])"),
        ).alias("pattern"),
        F.regexp_like(s["key"], F.lit("^[a-z0-9]+$")).alias("plain"),
    ))


def gate_tokens(norm_text: Column) -> Column:
    """Distinct runs of letters and digits of normalised text."""
    return F.array_distinct(F.split(norm_text, "[^a-z0-9]+"))


def find_terms(text: Column, rules: Column, limit: int = 8, token_set: Column | None = None) -> Column:
    """Terms present in normalised text at word boundaries, in rule order.

    One-word terms are looked up among the tokens, all at once; for the others the plain substring tests come first,
    so a pattern only runs where its first and last words occur.
    """
    tokens = gate_tokens(text) if token_set is None else token_set
    bound = F.struct(text.alias("text"), F.array_intersect(rules["word"], tokens).alias("words"))
    return let(bound, lambda v: F.when(v["text"] == "", no_strings()).otherwise(F.slice(F.transform(F.filter(rules, lambda r: F.when(
        r["plain"], F.array_contains(v["words"], r["word"])).otherwise(
        F.contains(v["text"], r["word"]) & F.contains(v["text"], r["last"]) & F.regexp_like(v["text"], r["pattern"]))), lambda r: r["term"]), 1, limit)))


def find_amounts(text: Column | str, limit: int = 3) -> Column:
    found = F.regexp_extract_all(col(text), F.lit(gr.AMOUNT_PATTERN), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda v: F.trim(v))), 1, limit)


def literal_hint(pattern: str) -> str:
    """Longest plain run that every match of the pattern must contain ('' when there is none)."""
    flat = re.sub(r"\([^()]*\)[?*]?", "\x00", pattern)
    flat = re.sub(r"\\[a-zA-Z](\{\d+\}|[+*?])?", "\x00", flat)
    flat = re.sub(r".[?*]", "\x00", flat)
    runs = re.findall(r"[a-z' -]+", flat)
    return max((r for r in runs), key=len, default="")


def first_match(text: Column, patterns: Sequence[str], width: int = 60) -> Column:
    """Match of the first pattern that hits lower-case text, trimmed and cut; NULL when none does."""
    tries = [F.when(F.contains(text, F.lit(literal_hint(p))), F.nullif(F.regexp_extract(text, f"({p})", 1), F.lit("")))
             for p in patterns]
    return F.substring(F.trim(F.coalesce(*tries)), 1, width)


def any_contains(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """Ordered subset of the phrases that occur as plain substrings."""
    return let(text, lambda t: F.filter(str_array(phrases), lambda p: F.contains(t, p)))


def first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return F.get(phrases_in(text, phrases), F.lit(0))


def label_table(rules: Iterable[tuple[str, Sequence[str]]]) -> Column:
    return literal([{"label": k, "needles": list(v)} for k, v in rules], "array<struct<label:string,needles:array<string>>>")


def detect_multi(text: Column, needles: Mapping[str, Sequence[str]], limit: int) -> Column:
    """Ordered labels with any needle inside the text, cut at the limit."""
    table = label_table(needles.items())
    return let(text, lambda t: F.slice(F.transform(
        F.filter(table, lambda r: F.exists(r["needles"], lambda n: F.contains(t, n))), lambda r: r["label"]), 1, limit))


def first_label(text: Column, rules: Iterable[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Label of the first rule with any needle inside the text."""
    table = label_table(rules)
    hits = let(text, lambda t: F.filter(table, lambda r: F.exists(r["needles"], lambda n: F.contains(t, n))))
    return F.coalesce(F.get(hits, F.lit(0))["label"], F.lit(default).cast("string"))


def classify_type(title: Column | str, summary: Column | str) -> Column:
    text = F.lower(F.concat(col(title), F.lit(" "), F.coalesce(col(summary), F.lit(""))))
    return first_label(text, fr.TYPE_KEYWORDS.items(), "other")


def extract_requirements(text: Column) -> Column:
    return F.transform(phrases_in(F.lower(text), fr.REQUIREMENT_KEYWORDS), lambda p: F.initcap(p))


def detect_funding_extract(text: Column) -> Column:
    low = F.lower(text)
    return first_label(low, [("full", fr.EXTRACT_FULL), ("partial", fr.EXTRACT_PARTIAL), ("self", fr.EXTRACT_SELF)])


def detect_degrees(text: Column) -> Column:
    table = literal([{"k": k, "label": v} for k, v in fr.DEGREE_LABELS], "array<struct<k:string,label:string>>")
    return let(F.lower(text), lambda low: F.array_distinct(F.transform(
        F.filter(table, lambda r: F.contains(low, r["k"])), lambda r: r["label"])))


def money(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, f"({fr.MONEY})", 1)), F.lit(""))


def detect_funding_facts(text_low: Column) -> Column:
    """struct(type, evidence, amount); phrases are tried full, self, partial, stipend, then a bare amount."""

    def classify(low: Column) -> Column:
        full = first_phrase(low, fr.FULL_FUNDING_PHRASES)
        own = first_phrase(low, fr.SELF_FUNDING_PHRASES)
        part = first_phrase(low, fr.PARTIAL_FUNDING_PHRASES)
        paid = first_phrase(low, fr.STIPEND_PHRASES)
        found = F.struct(full.alias("full"), own.alias("self"), part.alias("partial"), paid.alias("stipend"),
                         money(low).alias("award"))
        return let(found, lambda f: F.struct(
            F.when(f["full"].isNotNull(), "full").when(f["self"].isNotNull(), "self")
            .when(f["partial"].isNotNull(), "partial").when(f["stipend"].isNotNull(), "stipend")
            .when(f["award"].isNotNull(), "award").alias("type"),
            F.coalesce(f["full"], f["self"], f["partial"], f["stipend"], F.concat(F.lit("award of "), f["award"])).alias("evidence"),
            f["award"].alias("amount")))

    return let(text_low, classify)


def funding_category(text: Column) -> Column:
    return first_label(F.lower(text), fr.VERIFY_FUNDING)


def normalize_degree(raw: Column) -> Column:
    """One of four levels: a token of the level occurs in the dot-free lower text (levels in order)."""
    low = F.replace(F.trim(F.lower(raw)), F.lit("."), F.lit(""))
    return first_label(low, fr.DEGREE_TOKENS.items())


def matched_terms(terms: Column | str, text: Column, limit: int = 4) -> Column:
    """Profile phrases of three or more letters that occur in the text; first of each lower form."""
    clean = F.filter(F.transform(col(terms), lambda t: F.trim(t)), lambda t: F.length(t) >= 3)
    keys = F.transform(clean, lambda t: F.lower(t))
    stop = str_array(fr.STOPWORDS)
    return let(F.struct(F.lower(text).alias("low"), clean.alias("clean"), keys.alias("keys")), lambda v: F.slice(F.filter(
        v["clean"], lambda t, i: (F.array_position(v["keys"], F.lower(t)) == i + 1)
        & ~F.array_contains(stop, F.lower(t)) & F.contains(v["low"], F.lower(t))), 1, limit))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = str_array(fr.STOPWORDS)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


_TAG = r"(?s)<[^>]*>"


def strip_html(text: Column | str) -> Column:
    """Visible text with single blanks; plain text is only trimmed. Named entities of the basic set are decoded."""
    raw = F.coalesce(col(text), F.lit(""))
    bare = F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), _TAG, " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    clean = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.contains(raw, F.lit("<")), clean).otherwise(F.trim(raw))


def chunk_text(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of (idx, chunk): the whole text when short, else windows every size-overlap characters."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    return F.transform(starts, lambda s, i: F.struct(
        i.alias("idx"), F.when(n <= size, text).otherwise(F.substring(text, s + 1, F.lit(size))).alias("chunk")))


def joined(arr: Column, sep: str = "|") -> Column:
    return F.array_join(arr, sep)
