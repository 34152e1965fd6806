"""Small text builders shared by the oracle SQL."""

from __future__ import annotations

import re

from fairlead.rules import fact_rules as fr

AS_OF_SQL = "TIMESTAMP '2026-06-30 00:00:00'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]" if items else "CAST([] AS VARCHAR[])"


def any_c(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), "
            r"'[^\p{L}\p{N}_\s$€£%.,/+-]', ' ', 'g'), '\s+', ' ', 'g'))")


def pat(term: str) -> str:
    """Consuming boundaries, as the oracle's regex engine has no look-behind."""
    from fairlead.functions.text import normalize_py

    body = r"[\s\-/]*".join(re.escape(w) for w in normalize_py(term).split(" "))
    return f"(^|[^a-z0-9]){body}([^a-z0-9]|$)"


def first_hit(text: str, phrases) -> str:
    return f"list_filter({lst(phrases)}, lambda p: contains({text}, p))[1]"


def ladder(text: str, rules, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_c(text, n)} THEN {q(k)}" for k, n in rules) + f" ELSE {default} END"


def multi(text: str, needles: dict, limit: int) -> str:
    items = ", ".join(f"CASE WHEN {any_c(text, v)} THEN {q(k)} END" for k, v in needles.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)[1:{limit}]"


def parse_date(raw: str) -> str:
    named = (rf"(?i)((?:\d{{1,2}}\s+)?(?:{fr.MONTHS})\.?(?:\s+\d{{1,2}})?(?:\s*,)?\s*\d{{4}}"
             r"|\d{4}-\d{2}-\d{2})")
    flat = rf"regexp_replace({raw}, '(?i)\b(\d{{1,2}})(?:st|nd|rd|th)\b', '\1', 'g')"
    found = f"regexp_extract({flat}, {q(named)}, 1)"
    tidy = rf"trim(regexp_replace(regexp_replace({found}, '[,.]', ' ', 'g'), '\s+', ' ', 'g'))"
    return (f"try_strptime({tidy}, ['%d %B %Y', '%d %b %Y', '%B %d %Y', '%b %d %Y', '%Y-%m-%d', '%B %Y', '%b %Y'])")


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def days_until(deadline: str) -> str:
    s = f"((epoch_us({deadline}) - epoch_us({AS_OF_SQL})) / 86400000000.0)"
    return f"CAST(sign({s}) * ceil(abs({s})) AS BIGINT)"


def floor_days(later: str, earlier: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


HOST = r"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


def host(u: str) -> str:
    return HOST.replace("{u}", u)


def path(u: str) -> str:
    return rf"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
