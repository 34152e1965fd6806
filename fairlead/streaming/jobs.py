"""Incremental jobs on Structured Streaming, with batch twins for the same results.

State that outlives a micro-batch is in Spark's state store: watermarked de-duplication, aggregates, and
processors with list and value state per key (processors.py). What a batch gives goes to a folder of its
own number, so that a replayed batch writes the same again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from fairlead.operators import gate as G
from fairlead.operators.metrics import DEACTIVATE_AT
from fairlead.rules.gate_rules import MAX_PENDING
from fairlead.session import shared_dir
from fairlead.streaming.processors import Bursts, PendingQueue, SourceHealth, StatusHistory

HISTORY = 50
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/fairlead-{name}-{uuid.uuid4().hex}"


def open_stream(spark: SparkSession, folder: str, file_glob: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return paced(reader, files_per_trigger).parquet(folder)


def open_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream, be it one Parquet file or a folder of part files. A stream's own path has to be a folder, but a
    pattern may be met by a file as well as by a folder: the last character is written as a class of its own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return paced(reader, files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def paced(reader: DataStreamReader, files_per_trigger: int | None) -> DataStreamReader:
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


def drain(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop. State is in RocksDB whatever the session has: the processors keep several
    states a key, which Spark's default store can't, and state needs no heap. A query takes its settings as it starts."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write_batch).start()
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()


def drain_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Rows a stream emits, each with the number of its batch; replays overwrite their own batch."""
    spark = stream.sparkSession
    root = new_folder(spark, name)
    drain(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/ckpt", mode)
    return spark.read.parquet(f"{root}/out")


def last_update(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Final value per key of an update-mode stream."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return top.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def last_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of a stream that gives all rows of a key whenever it is touched: those of its last batch."""
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")


# ---------------------------------------------------------------- jobs

def stream_listings(listings: DataFrame, terms: G.ProfileTerms | None = None, delay: str = "60 days") -> DataFrame:
    """Gate every arriving listing once: repeats of an address inside the watermark are dropped."""
    once = listings.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["url_hash"])
    return G.evaluate(once, terms)


def stream_affinity(events: DataFrame, listings: DataFrame) -> DataFrame:
    """Running tag and institution weights per user, straight sums that combine before the shuffle (update mode)."""
    from fairlead.functions import scoring as S
    from fairlead.operators.ranking import affinity_keys

    keys = listings.select("listing_id", affinity_keys().alias("aff_keys"))
    weighted = events.select("user_id", "listing_id", S.positive_weight(F.col("status")).alias("w_pos"),
                             S.negative_weight(F.col("status"), F.col("dismiss_reason")).alias("w_neg")).filter((F.col("w_pos") > 0) | (F.col("w_neg") > 0))
    return (weighted.join(keys, "listing_id").select("user_id", "w_pos", "w_neg", F.inline("aff_keys")).groupBy("user_id", "kind", "key")
            .agg(F.sum("w_pos").alias("pos"), F.sum("w_neg").alias("neg")))


def split_status_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted events and rejects: a dismissal must state its reason."""
    bad = (F.col("status") == "dismissed") & (F.coalesce("dismiss_reason", F.lit("")) == "")
    return events.filter(~bad), events.filter(bad).withColumn("error", F.lit("dismiss_reason is required when status is dismissed"))


def status_history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Last transitions per (user, listing): every change of status, and every reasoned dismissal.

    The previous status is looked up inside one day of a pair; the first row of a day takes the last status
    of the pair's day before, from a table of one row per pair and day. No window holds a whole pair.
    """
    order = F.struct("happened_at", "event_id")
    e = events.withColumn("day", F.to_date("happened_at"))
    ends = e.groupBy("user_id", "listing_id", "day").agg(F.max_by("status", order).alias("day_end"))
    carried = ends.withColumn("carried", F.lag("day_end").over(W.partitionBy("user_id", "listing_id").orderBy("day"))).drop("day_end")
    inside = F.lag("status").over(W.partitionBy("user_id", "listing_id", "day").orderBy("happened_at", "event_id"))
    rows = e.withColumn("inside", inside).join(carried, ["user_id", "listing_id", "day"]).withColumn("from_status", F.coalesce("inside", "carried"))
    kept = rows.filter(F.col("from_status").isNull() | (F.col("from_status") != F.col("status")) | F.col("dismiss_reason").isNotNull())
    recent = F.row_number().over(W.partitionBy("user_id", "listing_id").orderBy(F.desc("happened_at"), F.desc("event_id")))
    return kept.withColumn("age", recent).filter(F.col("age") <= keep).select(
        "user_id", "listing_id", "event_id", "happened_at", "from_status", F.col("status").alias("to_status"), "dismiss_reason")


def keyed(stream: DataFrame, keys: list[str], processor, schema: str, watermark: bool = False) -> DataFrame:
    """A stream through a processor with state per key. Only keys that a batch touches (or whose timer is due) are read,
    changed and written, by Spark's state store; a replayed batch starts from the state before it."""
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="EventTime" if watermark else "None")


def keyed_rows(stream: DataFrame, keys: list[str], processor, schema: str, watermark: bool = False) -> DataFrame:
    """The same with rows, not frames, for streams of many keys with few rows each."""
    return stream.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="EventTime" if watermark else "None")


def stream_status_history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last transitions of every touched (user, listing), for last_rows by these keys."""
    cols = events.select("user_id", "listing_id", "event_id", F.unix_micros("happened_at").alias("at"), "status", "dismiss_reason")
    told = keyed_rows(cols, ["user_id"], StatusHistory(keep), "user_id long, listing_id long, event_id long, at long, from_status string, to_status string, dismiss_reason string")
    return told.select("user_id", "listing_id", "event_id", F.timestamp_micros("at").alias("happened_at"), "from_status", "to_status", "dismiss_reason")


def stream_source_health(runs: DataFrame) -> DataFrame:
    """Failures in a row of every touched source, for last_rows by source_id."""
    cols = runs.select("source_id", "run_id", "finished_at", "status")
    return keyed(cols, ["source_id"], SourceHealth(DEACTIVATE_AT), "source_id long, consecutive_failures long, deactivate boolean")


def stream_pending_queue(items: DataFrame, cap: int = MAX_PENDING) -> DataFrame:
    """The queue of every touched source, for last_rows by source_id: old entries first, unseen deferred ones (done =
    false) after, capped, done ones gone. An empty queue is one row without an address."""
    cols = items.select("source_id", "url", "title", "pos", "done")
    return keyed(cols, ["source_id"], PendingQueue(cap), "source_id long, place int, url string, title string, pos long")


def stream_rerank_requests(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Requests of every touched user, one per burst of status changes: bursts that are over (closed, given once), and those
    still open as they stand, in full whenever one changes. complete_requests takes both together."""
    cols = events.withWatermark("happened_at", delay).select("user_id", "happened_at", F.unix_micros("happened_at").alias("at"))
    told = keyed_rows(cols, ["user_id"], Bursts(int(pd.Timedelta(gap).total_seconds() * 1_000_000)), "user_id long, started long, ended long, changes long, closed boolean", watermark=True)
    return told.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def complete_requests(rows: DataFrame) -> DataFrame:
    """All bursts: the closed ones, and the last word on open ones."""
    open_now = last_rows(rows, ["user_id"]).filter(~F.col("closed") & F.col("started").isNotNull())
    return rows.filter("closed").drop("batch").unionByName(open_now).select("user_id", "started", "ended", "changes")


def rerank_requests_batch(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return events.groupBy("user_id", F.session_window("happened_at", gap).alias("s")).agg(F.count("*").alias("changes")).select(
        "user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "changes")


def stream_run_metrics(decisions: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Event counts per source, kind and window (update mode); rows later than the watermark are dropped. counted_metrics
    keeps and counts these."""
    win = F.window("happened_at", width, slide) if slide else F.window("happened_at", width)
    return decisions.withWatermark("happened_at", delay).groupBy("source_id", "verdict", win.alias("w")).agg(F.count("*").alias("n")).select(
        "source_id", "verdict", F.col("w.start").alias("window_start"), "n")


def counted_metrics(decisions: DataFrame, name: str, width: str = "1 hour", delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Counts per source, kind and window of the rows in time, and the rows that came too late, so that both add up to the
    input. A row is late if its window ended before the watermark, which is the latest time of earlier batches less the
    delay. Each batch writes its own counts, late rows and latest time under its number: a replay writes the same again."""
    spark = decisions.sparkSession
    root = new_folder(spark, name)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decisions.schema)

    def write(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        marks = s.read.schema("latest timestamp, batch int").parquet(f"{root}/marks").filter(F.col("batch") < n) if n else None
        latest = marks.agg(F.max("latest")).first()[0] if n else None
        ended = F.window("happened_at", width)["end"]
        late = F.coalesce(ended <= F.lit(latest) - F.expr(f"INTERVAL {delay}"), F.lit(False)) if latest else F.lit(False)
        batch = batch.persist()
        batch.filter(late).write.mode("overwrite").parquet(f"{root}/late/batch={n}")
        run_metrics_batch(batch.filter(~late), width).write.mode("overwrite").parquet(f"{root}/counts/batch={n}")
        batch.agg(F.max("happened_at").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={n}")
        batch.unpersist()

    drain(decisions, write, f"{root}/ckpt")
    counts = spark.read.parquet(f"{root}/counts").groupBy("source_id", "verdict", "window_start").agg(F.sum("n").alias("n"))
    return counts, spark.read.schema(kinds).parquet(f"{root}/late")


def stream_raw_documents(docs: DataFrame, delay: str = "60 days") -> DataFrame:
    """New versions of landed pages: first of each (url_hash, content_hash) within the watermark."""
    return docs.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url_hash", "content_hash"])


def run_metrics_batch(decisions: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    win = F.window("happened_at", width, slide) if slide else F.window("happened_at", width)
    return decisions.groupBy("source_id", "verdict", win.alias("w")).agg(F.count("*").alias("n")).select("source_id", "verdict", F.col("w.start").alias("window_start"), "n")


def epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c))
