"""Streams over several files give what one batch gives."""

import random
import time

from pyspark.sql import functions as F

from fairlead.operators.metrics import failure_streaks
from fairlead.streaming import jobs as J


def _sliced(df, order, path, n=4):
    total = df.count()
    rows = df.orderBy(order).collect()
    size = total // n + 1
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_status_history(spark, tables, tmp_path):
    ev = tables.status_events.filter("status <> 'dismissed' OR dismiss_reason IS NOT NULL").withColumn("listing_id", F.col("listing_id") % 2)
    _sliced(ev, "event_id", str(tmp_path / "in"))
    out = J.drain_to_table(J.stream_status_history(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1), 20), "t-history", "update")
    got = J.last_rows(out, ["user_id", "listing_id"])
    cols = ["user_id", "listing_id", "event_id", "from_status", "to_status"]
    assert _rows(got.select(*cols)) == _rows(J.status_history(ev, 20).select(*cols))
    assert out.select("batch").distinct().count() == 4


def test_source_health(spark, tables, tmp_path):
    runs = tables.runs.select("source_id", "run_id", "finished_at", "status")
    _sliced(runs, "finished_at", str(tmp_path / "in"))
    out = J.drain_to_table(J.stream_source_health(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), "t-health", "update")
    cols = ["source_id", "consecutive_failures", "deactivate"]
    assert _rows(J.last_rows(out, ["source_id"]).select(*cols)) == _rows(failure_streaks(runs).select(*cols))


def test_only_touched_keys_are_written(spark, tmp_path):
    rows = [(s, k, k, "failed" if k % 3 else "completed") for k in range(12) for s in (range(5) if k < 3 else [k % 2])]
    runs = spark.createDataFrame(rows, "source_id long, run_id long, at long, status string").select("source_id", "run_id", F.timestamp_seconds("at").alias("finished_at"), "status")
    _sliced(runs, "finished_at", str(tmp_path / "in"))
    out = J.drain_to_table(J.stream_source_health(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), "t-touched", "update")
    touched = {r["batch"]: r["n"] for r in out.groupBy("batch").agg(F.countDistinct("source_id").alias("n")).collect()}
    assert touched[0] == 5 and touched[max(touched)] <= 2


def _queue_by_hand(batches, cap):
    queue = {}
    for rows in batches:
        for source in {r["source_id"] for r in rows}:
            mine = [r for r in rows if r["source_id"] == source]
            old = queue.get(source, [])
            new = {}
            for r in sorted((r for r in mine if not r["done"] and r["url"]), key=lambda r: (r["pos"], r["url"])):
                if r["url"] not in old:
                    new.setdefault(r["url"], r)
            gone = {r["url"] for r in mine if r["done"]}
            queue[source] = [u for u in (old + list(new))[:cap] if u not in gone]
    return queue


def test_pending_queue(spark, tmp_path):
    rnd = random.Random(4)
    batches = [[{"source_id": rnd.randrange(4), "url": rnd.choice([None, "", *[f"u{k}" for k in range(30)]]), "title": f"t{k}", "pos": n * 100 + k, "done": rnd.random() < 0.3} for k in range(40)] for n in range(5)]
    schema = "source_id long, url string, title string, pos long, done boolean"
    for n, rows in enumerate(batches):
        spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    out = J.drain_to_table(J.stream_pending_queue(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1), 6), "t-queue", "update")
    got = {}
    for r in sorted(J.last_rows(out, ["source_id"]).collect(), key=lambda r: r["place"]):
        got.setdefault(r["source_id"], []).extend([r["url"]] if r["url"] else [])
    assert got == _queue_by_hand(batches, 6)


def test_bursts_over_several_batches(spark, tables, tmp_path):
    ev = tables.status_events.select("user_id", "happened_at")
    _sliced(ev, "happened_at", str(tmp_path / "in"))
    out = J.drain_to_table(J.stream_rerank_requests(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1), "1 days"), "t-bursts", "update")
    assert _rows(J.complete_requests(out)) == _rows(J.rerank_requests_batch(ev, "1 days"))
    assert out.filter("closed").count() > 0 and J.last_rows(out, ["user_id"]).filter("NOT closed AND started IS NOT NULL").count() > 0


def test_a_replayed_batch_changes_nothing(spark, tables, tmp_path):
    """The commit of the last batch is lost: it runs again, from the state before it, into its own folder."""
    ev = tables.status_events.filter("status <> 'dismissed' OR dismiss_reason IS NOT NULL").withColumn("listing_id", F.col("listing_id") % 2)
    _sliced(ev, "event_id", str(tmp_path / "in"))
    stream = lambda: J.stream_status_history(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1), 20)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    J.drain(stream(), write, str(tmp_path / "ckpt"), "update")
    before = _rows(spark.read.parquet(str(tmp_path / "out")))
    commits = sorted((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (tmp_path / "ckpt" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()
    J.drain(stream(), write, str(tmp_path / "ckpt"), "update")
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == before


def test_late_rows_are_kept_and_counts_add_up(spark, tmp_path):
    hour = 3600
    batches = [[(1, "a", 10 * hour), (1, "b", 10 * hour + 5)], [(1, "a", 8 * hour), (1, "a", 9 * hour + 1), (2, "a", 20 * hour)], [(1, "a", 10 * hour), (2, "b", 19 * hour + 9)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "source_id long, verdict string, at long").select("source_id", "verdict", F.timestamp_seconds("at").alias("happened_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    counts, late = J.counted_metrics(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1), "t-late")
    assert counts.agg(F.sum("n")).first()[0] + late.count() == sum(map(len, batches))
    assert sorted(r["happened_at"].timestamp() // hour for r in late.collect()) == [8, 10]


def test_run_metrics(spark, tables, tmp_path):
    ev = tables.status_events.select((F.col("user_id") % 5).alias("source_id"), F.col("status").alias("verdict"), "happened_at")
    _sliced(ev, "happened_at", str(tmp_path / "in"))
    out = J.drain_to_table(J.stream_run_metrics(J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), "t-metrics", "update")
    keys = ["source_id", "verdict", "window_start"]
    assert _rows(J.last_update(out, keys, ["n"]).select(*keys, "n")) == _rows(J.run_metrics_batch(ev).select(*keys, "n"))


def test_state_store_of_a_plain_session(spark, tables, tmp_path):
    before = spark.conf.get(J.PROVIDER)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(J.PROVIDER, plain)
    try:
        runs = tables.runs.select("source_id", "run_id", "finished_at", "status")
        runs.repartition(3).write.parquet(str(tmp_path / "runs.parquet"))
        out = J.drain_to_table(J.stream_source_health(J.open_table(spark, str(tmp_path / "runs.parquet"))), "t-plain", "update")
        assert spark.conf.get(J.PROVIDER) == plain
    finally:
        spark.conf.set(J.PROVIDER, before)
    cols = ["source_id", "consecutive_failures", "deactivate"]
    assert _rows(J.last_rows(out, ["source_id"]).select(*cols)) == _rows(failure_streaks(runs).select(*cols))


def test_tables_in_one_file_or_in_many(spark, tables, tmp_path):
    docs, many = tables.documents.select("doc_id", "lang"), str(tmp_path / "documents.parquet")
    docs.repartition(3).write.parquet(many)
    for path in (many, f"{tables.sf_dir}/documents.parquet"):
        got = J.drain_to_table(J.open_table(spark, path).select("doc_id", "lang"), "t-table").drop("batch")
        assert _rows(got) == _rows(docs)


class Held:
    """A value state and its handle, counting the messages that a store would get."""

    def __init__(self):
        self.value, self.messages, self.timers = None, 0, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages, self.value = self.messages + 1, value

    def clear(self):
        self.messages, self.value = self.messages + 1, None

    def registerTimer(self, at):
        self.messages += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_user_costs_few_messages_however_many_listings_and_bursts():
    """Hundreds of listings or bursts of a user: two or three messages a batch, and only touched listings are told."""
    from pyspark.sql import Row

    from fairlead.streaming.processors import Bursts, StatusHistory

    state, history = Held(), StatusHistory(3)
    history.init(state)
    rows = [Row(listing_id=k % 200, event_id=k, at=k, status=["saved", "new"][k // 200 % 2], dismiss_reason=None) for k in range(1000)]
    first = list(history.handleInputRows((7,), iter(rows[:999]), None))
    assert state.messages == 2 and len(first) == 600
    again = list(history.handleInputRows((7,), iter([Row(listing_id=5, event_id=2000, at=2000, status="new", dismiss_reason="late"), rows[999]]), None))
    assert state.messages == 4 and [(r.listing_id, r.event_id, r.from_status, r.to_status) for r in again] == [
        (199, 599, "new", "saved"), (199, 799, "saved", "new"), (199, 999, "new", "saved"), (5, 605, "saved", "new"), (5, 805, "new", "saved"), (5, 2000, "saved", "new")]

    state, bursts = Held(), Bursts(100)
    bursts.init(state)
    state.watermark = 0
    told = list(bursts.handleInputRows((7,), iter([Row(at=1000 * k) for k in range(500)]), state))
    assert state.messages == 3 and state.timers == [1] and sum(r.closed for r in told) == 0 and len(told) == 500
    state.watermark = 400
    closed = [r for r in bursts.handleExpiredTimer((7,), state, None) if r.closed]
    assert state.messages == 6 and state.timers == [1, 401] and len(closed) == 400
    assert list(bursts.handleExpiredTimer((7,), state, None)) == [] and state.messages == 7
