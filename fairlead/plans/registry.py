"""Collects the registered queries and their oracles from the plan modules."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.bindings import Bindings

QUERIES: dict[str, Callable[[Bindings], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn: Callable[[Bindings], DataFrame]):
        QUERIES[name] = fn
        return fn

    return register


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def load() -> None:
    import importlib

    for group in ("text", "gate", "facts", "ranking", "feed", "metrics", "resolve", "parsing",
                  "trust", "discovery", "profiles", "retrieval", "streams"):
        for pkg in ("plans", "oracle"):
            try:
                importlib.import_module(f"fairlead.{pkg}.{group}")
            except ModuleNotFoundError as exc:
                if exc.name != f"fairlead.{pkg}.{group}":
                    raise


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query by name. FAIRLEAD_TEXT_PARTITIONS is passed on to the bindings; without it, files decide."""
    return lambda spark, sf_dir: QUERIES[name](Bindings(spark, sf_dir, int(os.environ.get("FAIRLEAD_TEXT_PARTITIONS", "0")) or None))
