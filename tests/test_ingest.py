"""The ingest flow over several batches gives what one batch gives, writes touched buckets only, and survives a replay."""

import json
import time

from pyspark.sql import functions as F

from fairlead.plans.gate import TERMS
from fairlead.streaming import ingest as I
from fairlead.streaming import jobs as J

AS_OF = "2026-06-30"


def items(tables):
    """Every item once, and every third again later under another address, with another deadline and a longer summary."""
    src = tables.sources.select(F.col("id").alias("source_id"), F.col("regions").alias("source_regions"))
    first = tables.listings.join(src, "source_id", "left").withColumn("pos", F.col("listing_id"))
    again = first.filter("listing_id % 3 = 0").withColumns({"listing_id": F.col("listing_id") + 1000, "pos": F.col("pos") + 1000, "url_hash": F.concat("url_hash", F.lit("again")),
                                                           "deadline": F.lit("2027-01-01").cast("timestamp"), "summary": F.concat("summary", F.lit(" and more")), "content_hash": F.lit("newer")})
    same = first.filter("listing_id % 5 = 0").withColumns({"listing_id": F.col("listing_id") + 2000, "pos": F.col("pos") + 2000})
    # One source, so that the order of all items is their position.
    return first.unionByName(again).unionByName(same).withColumn("source_id", F.lit(1).cast("bigint"))


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*I.FIELDS).collect())


def test_batches_equal_one_batch_and_a_replay_changes_nothing(spark, tables, tmp_path):
    all_ = items(tables).cache()
    n = all_.agg(F.max("pos")).first()[0]
    for k in range(4):
        all_.filter((F.col("pos") * 4 >= k * (n + 1)) & (F.col("pos") * 4 < (k + 1) * (n + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = lambda: J.open_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    root, version = I.stream_ingest(stream(), F.lit(AS_OF).cast("timestamp"), TERMS, buckets=64, root=str(tmp_path / "snap"))
    got = rows(I.snapshot(spark, root, version))
    whole = I.ingested(all_, spark.createDataFrame([], I.LISTING), F.lit(AS_OF).cast("timestamp"), TERMS)
    assert version == 4 and got == rows(whole)
    assert whole.filter("n_updates > 0 AND size(field_changes) > 0").count() > 0

    # The last batch is lost after it was written: it runs again from the version before.
    commits = sorted((tmp_path / "snap" / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()
    _, again = I.stream_ingest(stream(), F.lit(AS_OF).cast("timestamp"), TERMS, buckets=64, root=root)
    assert again == 4 and rows(I.snapshot(spark, root, 4)) == got


def test_only_touched_buckets_are_written(spark, tmp_path):
    def listings(ids, title):
        return spark.createDataFrame([(i, title) for i in ids], "listing_id long, title string").select(*[
            F.col(c) if c in ("listing_id", "title") else F.lit(None).alias(c) for c in I.FIELDS]).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], I.LISTING).schema])

    root = str(tmp_path)
    first = I.publish(spark, root, 0, listings(range(40), "old"), 8)
    second = I.publish(spark, root, 1, listings([3, 40], "new"), 8)
    third = I.publish(spark, root, 2, listings([], "none"), 8)
    assert len(first) == 8 and 1 <= len(second) <= 2 and third == []
    held = I.manifest(spark, root, 3)
    assert {b for b, v in held.items() if v == 2} == set(second) and set(held.values()) == {1, 2}
    assert {r["title"]: r["n"] for r in I.snapshot(spark, root, 3).groupBy("title").agg(F.count("*").alias("n")).collect()} == {"old": 39, "new": 2}
    assert I.snapshot(spark, root, 1).count() == 40 and I.snapshot(spark, root, 0).count() == 0
    assert json.dumps(sorted(p.name for p in (tmp_path / "data").iterdir())) == '["v=1", "v=2"]'


def test_ingest_writes_no_checkpoints_of_texts(spark, monkeypatch):
    """What a batch passes on with texts is written as a compressed table: no uncompressed checkpoint holds a summary."""
    frame = type(spark.range(1))
    seen, plain = [], frame.checkpoint

    def checkpoint(self, *args, **kwargs):
        seen.append(self.columns)
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(frame, "checkpoint", checkpoint)
    rows = [(k, 1, f"https://a.org/{k}", f"Fully funded PhD scholarship {k * 7919} in ocean science", "Apply now. Application deadline: 15 Oct 2026. Covers tuition. " * 3, k) for k in range(6)]
    batch = spark.createDataFrame(rows, "listing_id long, source_id long, url string, title string, summary string, pos long").selectExpr(
        "*", "'Ocean Institute' AS institution", "sha2(url, 256) AS url_hash", "sha2(summary, 256) AS content_hash", "CAST(NULL AS timestamp) AS deadline", "CAST(NULL AS string) AS funding_type",
        "CAST(array() AS array<string>) AS degree_levels", "'phd' AS opportunity_type", "CAST(NULL AS bigint) AS duplicate_of", "CAST(array() AS array<string>) AS source_regions", "CAST(array() AS array<string>) AS requirements",
        "CAST(array() AS array<string>) AS countries", "CAST(array() AS array<string>) AS tags", "CAST(NULL AS string) AS verification_status", "timestamp'2026-06-01' AS created_at")
    I.ingested(batch, spark.createDataFrame([], I.LISTING), F.lit("2026-06-30").cast("timestamp")).collect()
    assert seen and not any("summary" in columns for columns in seen)
