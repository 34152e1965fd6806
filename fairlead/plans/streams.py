"""Streaming queries: the table files are read as streams and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, VIEWS, Bindings, SparkDialect
from fairlead.plans.gate import TERMS
from fairlead.plans.registry import query
from fairlead.streaming import ingest as I
from fairlead.streaming import jobs as J


def streamed(b: Bindings, view: str, table: str) -> DataFrame:
    """A business view over one table read as a stream; its other inputs stay static."""
    build, needs = VIEWS[view]
    stream = J.open_table(b.spark, f"{b.sf_dir}/{table}.parquet")
    static = {n: b.view(n) for n in needs if n != table}
    return b.spark.sql(build(SparkDialect), **static, **{table: stream})


def status_stream(b: Bindings) -> DataFrame:
    """Status events as a stream; the listing of an event comes from the number of listings."""
    n = b.documents.count()
    e = J.open_table(b.spark, f"{b.sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "new").when(F.col("event_type") == "click", "saved").when(F.col("event_type") == "signup", "in_progress").when(
        F.col("event_type") == "purchase", "applied").otherwise("dismissed")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("happened_at"), "user_id", ((F.col("event_id") * 31) % n).alias("listing_id"), kind.alias("status"),
                    F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "wrong_field").alias("dismiss_reason"))


@query("t01_stream_listings")
def t01(b: Bindings):
    src = b.sources.select(F.col("id").alias("source_id"), F.col("regions").alias("source_regions"))
    s = streamed(b, "listings", "documents").select("listing_id", "source_id", "url", "title", "summary", "url_hash", "created_at").join(src, "source_id", "left")
    return J.drain_to_table(J.stream_listings(s, TERMS).select("listing_id", "verdict", "reason"), "listings").drop("batch")


@query("t01_stream_ingest")
def t01i(b: Bindings):
    """Gate, extraction, resolution and upsert as one flow: the listings after all documents have come in."""
    src = b.sources.select(F.col("id").alias("source_id"), F.col("regions").alias("source_regions"))
    items = streamed(b, "listings", "documents").join(src, "source_id", "left").withColumn("pos", F.col("listing_id"))
    root, version = I.stream_ingest(items, F.lit(AS_OF).cast("timestamp"), TERMS)
    return I.snapshot(b.spark, root, version).select("listing_id", "source_id", "title", "duplicate_of", "content_hash", "n_updates")


@query("t02_stream_affinity")
def t02(b: Bindings):
    out = J.drain_to_table(J.stream_affinity(status_stream(b), b.listings), "affinity", "update")
    return J.last_update(out, ["user_id", "kind", "key"], ["pos", "neg"]).select("user_id", "kind", "key", F.round("pos", 4).alias("pos"), F.round("neg", 4).alias("neg"))


@query("t03_stream_status_history")
def t03(b: Bindings):
    ok, _ = J.split_status_events(status_stream(b).withColumn("listing_id", F.col("listing_id") % 3))
    out = J.drain_to_table(J.stream_status_history(ok), "history", "update")
    return J.last_rows(out, ["user_id", "listing_id"]).select("user_id", "listing_id", "event_id", "from_status", "to_status", "dismiss_reason")


@query("t03_stream_whole_history")
def t03w(b: Bindings):
    """The same with every listing apart."""
    ok, _ = J.split_status_events(status_stream(b))
    out = J.drain_to_table(J.stream_status_history(ok), "whole-history", "update")
    return J.last_rows(out, ["user_id", "listing_id"]).select("user_id", "listing_id", "event_id", "from_status", "to_status", "dismiss_reason")


@query("t03_status_rejects")
def t03r(b: Bindings):
    _, bad = J.split_status_events(b.status_events)
    return bad.select("event_id", "error")


@query("t04_stream_rerank_requests")
def t04(b: Bindings):
    out = J.complete_requests(J.drain_to_table(J.stream_rerank_requests(status_stream(b)), "rerank", "update"))
    return out.select("user_id", F.unix_micros("started").alias("started_us"), "changes")


@query("t05_stream_source_health")
def t05(b: Bindings):
    out = J.drain_to_table(J.stream_source_health(streamed(b, "runs", "orders")), "health", "update")
    return J.last_rows(out, ["source_id"]).select("source_id", "consecutive_failures", "deactivate")


@query("t06_stream_pending_queue")
def t06(b: Bindings):
    s = streamed(b, "listings", "documents").select("source_id", "url", "title", F.col("listing_id").alias("pos"), (F.col("listing_id") % 6 == 0).alias("done"))
    out = J.drain_to_table(J.stream_pending_queue(s, 30), "pending", "update")
    return J.last_rows(out, ["source_id"]).filter(F.col("url").isNotNull()).select("source_id", "url")


def verdict_events(s: DataFrame) -> DataFrame:
    return s.select((F.col("user_id") % 20).alias("source_id"), F.col("status").alias("verdict"), "happened_at")


@query("t07_stream_run_metrics")
def t07(b: Bindings):
    out = J.drain_to_table(J.stream_run_metrics(verdict_events(status_stream(b))), "metrics", "update")
    return J.last_update(out, ["source_id", "verdict", "window_start"], ["n"]).select("source_id", "verdict", J.epoch("window_start").alias("window_start"), "n")


@query("t07_stream_daily_metrics")
def t07d(b: Bindings):
    out = J.drain_to_table(J.stream_run_metrics(verdict_events(status_stream(b)), "24 hours", "1 hour"), "daily", "update")
    final = J.last_update(out, ["source_id", "verdict", "window_start"], ["n"])
    return final.groupBy("source_id", "verdict").agg(F.count("*").alias("windows"), F.max("n").alias("busiest"))


@query("t07_counts_and_late_rows")
def t07l(b: Bindings):
    """Counts of the rows in time, and the late rows in one more row per source and kind."""
    counts, late = J.counted_metrics(verdict_events(status_stream(b)), "counted")
    missed = late.groupBy("source_id", "verdict").agg(F.count("*").alias("n")).select("source_id", "verdict", F.lit(None).cast("bigint").alias("window_start"), "n")
    return counts.select("source_id", "verdict", J.epoch("window_start").alias("window_start"), "n").unionByName(missed)


@query("t08_stream_raw_documents")
def t08(b: Bindings):
    s = streamed(b, "listings", "documents").select(F.concat(F.lit("page"), (F.col("source_id") % 5).cast("string")).alias("url_hash"), "content_hash", F.col("created_at").alias("fetched_at"))
    return J.drain_to_table(J.stream_raw_documents(s), "raw").select("url_hash", "content_hash")
