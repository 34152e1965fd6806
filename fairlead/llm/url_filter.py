"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match wins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.shared import map_text


@dataclass(frozen=True)
class Rule:
    """An entry of an allow or block list. It fits its host and all subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    """labels: next host label, from the right. segments: next whole path segment. tails: rules whose last segment is
    open, so that it only has to start the url's segment; a rule that ends with a slash has the empty tail."""

    labels: dict[str, Node] = field(default_factory=dict)
    path: Path | None = None


@dataclass
class Path:
    segments: dict[str, Path] = field(default_factory=dict)
    tails: list[tuple[str, Rule]] = field(default_factory=list)


class RuleTrie:
    """More host labels beat fewer; among equal hosts the longer path wins; of the same entry in both lists, block."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        for rule in sorted(rules, key=lambda r: (r.verdict != "block", r.host, r.path)):
            self.add(rule)

    def add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.lower().split(".")):
            node = node.labels.setdefault(label, Node())
        at = node.path = node.path or Path()
        *whole, tail = rule.path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, Path())
        if all(text != tail for text, _ in at.tails):
            at.tails.append((tail, rule))
            at.tails.sort(key=lambda t: -len(t[0]))

    def find(self, host: str, path: str) -> Rule | None:
        node, on_way = self.root, []
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.path is not None:
                on_way.append(node.path)
        segments = path.split("/")
        for start in reversed(on_way):
            if best := self._longest(start, segments):
                return best
        return None

    @staticmethod
    def _longest(at: Path, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            best = next((rule for tail, rule in at.tails if segment.startswith(tail)), best)
            at = at.segments.get(segment)
            if at is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host.translate(LOWER), rest[:cut]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), otherwise: str = "allow", most_broadcast: int = 200_000) -> DataFrame:
    """One row per row of `pages`: the kept columns, host, path, rule (null: none fits) and verdict.

    The trie is broadcast while the list has at most `most_broadcast` entries; a longer list is joined on host suffixes
    instead, with the same answers. Null, empty and odd urls have an empty host, or one that no rule fits, and get
    `otherwise`; repeated rows stay; an empty table gives no rows; further columns are not read, so that their names
    can't clash."""
    slim = pages.select(*keep, F.col(url).alias("_url"))
    if len(rules) > most_broadcast:
        return _joined(slim, rules, keep, otherwise)
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def start():
        trie = shared.value

        def each(batch: pa.RecordBatch) -> dict:
            parts = [split_url(u) for u in batch.column("_url").to_pylist()]
            found = [trie.find(h, p) for h, p in parts]
            return {k: batch.column(k) for k in keep} | {
                "host": [h for h, _ in parts], "path": [p for _, p in parts],
                "rule": [r.name if r else None for r in found], "verdict": [r.verdict if r else otherwise for r in found],
            }

        return each

    kinds = dict(slim.dtypes)
    return map_text(slim, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "host string, path string, rule string, verdict string"]), start)


def _joined(slim: DataFrame, rules: list[Rule], keep: tuple[str, ...], otherwise: str) -> DataFrame:
    """The same for lists beyond the broadcast bound: every host suffix meets the rules of that host."""
    listed = slim.sparkSession.createDataFrame([(r.host.lower(), r.path, r.verdict) for r in rules], "suffix string, rule_path string, rule_verdict string").groupBy("suffix", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    parts = slim.withColumn("_row", F.monotonically_increasing_id()).withColumn("host", F.coalesce(F.when(F.col("_url").contains("://"), F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))).withColumn("path", F.coalesce(F.when(F.col("_url").contains("://"), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)), F.lit("")))
    hosts = parts.withColumn("_labels", F.split("host", r"\.")).withColumn("_at", F.explode(F.expr("sequence(1, size(_labels))"))).withColumn("suffix", F.expr("array_join(slice(_labels, _at, size(_labels) - _at + 1), '.')"))
    matched = hosts.join(listed, "suffix", "left").withColumn("_fits", F.expr("rule_path IS NOT NULL AND startswith(path, rule_path)"))
    best = F.max_by(F.when(F.col("_fits"), F.struct(F.concat("suffix", "rule_path").alias("rule"), "rule_verdict")), F.when(F.col("_fits"), F.struct(F.size("_labels") - F.col("_at"), F.length("rule_path"))))
    grouped = matched.groupBy("_row", *keep, "host", "path").agg(best.alias("_best"))
    return grouped.select(*keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(otherwise)).alias("verdict"))
