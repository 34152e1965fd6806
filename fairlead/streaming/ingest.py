"""Ingest as one flow: gate, extraction, resolution and upsert of every micro-batch into a snapshot in buckets.

A version of the snapshot is a manifest that names, for each bucket of listings, the version whose files hold it. Batch n
reads version n and publishes version n + 1, for which only buckets with new or changed listings are written. A replayed
batch finds version n as it was and writes the same files and manifest again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.operators import gate as G
from fairlead.operators import resolve as X
from fairlead.operators.facts import backfill_facts, derive_facts
from fairlead.session import written
from fairlead.streaming.jobs import drain, new_folder

CHANGE = "struct<field:string,from:string,to:string>"
LISTING = (f"listing_id long, source_id long, title string, summary string, institution string, url string, url_hash string, content_hash string, deadline timestamp, "
           f"funding_type string, degree_levels array<string>, opportunity_type string, last_seen_at timestamp, duplicate_of long, field_changes array<{CHANGE}>, n_updates long")
FIELDS = [f.split(" ")[0] for f in LISTING.replace(f"array<{CHANGE}>", "changes").split(", ")]
#: Entries that the change log of a listing keeps.
LOG = 20


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("listing_id"), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """Bucket to the version whose files hold it; a bucket without listings is not there."""
    if version == 0:
        return {}
    rows = spark.read.schema("bucket int, version int").json(f"{root}/manifests/of={version}").collect()
    return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}


def snapshot(spark: SparkSession, root: str, version: int, only: list[int] | None = None) -> DataFrame:
    """The listings of a version, or those of some of its buckets."""
    held = manifest(spark, root, version)
    paths = [f"{root}/data/v={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
    return spark.read.schema(LISTING).parquet(*paths) if paths else spark.createDataFrame([], LISTING)


def publish(spark: SparkSession, root: str, version: int, changed: DataFrame, buckets: int) -> list[int]:
    """Version + 1: changed listings replace or join those of their buckets. Returns the buckets written."""
    placed = written(changed.select(*FIELDS).withColumn("bucket", bucket(buckets)))
    touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # at most `buckets` numbers
    old = snapshot(spark, root, version, touched).withColumn("bucket", bucket(buckets))
    if touched:
        merged = X.merge_snapshot(old, placed)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={version + 1}")
    held = manifest(spark, root, version) | {b: version + 1 for b in touched}
    spark.createDataFrame(sorted(held.items()) or [(None, None)], "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{root}/manifests/of={version + 1}")
    return touched


def folded(updates: DataFrame, stored: DataFrame) -> DataFrame:
    """All updates of a listing (listing_id, o, deadline, summary, content_hash, funding_type, degree_levels,
    opportunity_type) as one, as if applied one by one in the order o: the last value that is not empty, the longest
    summary, and the changes of the deadline, from the stored one on. Texts meet in combining aggregates only; what is
    ordered is a row of dates per update."""
    last = lambda c, there: F.max_by(F.when(there, F.col(c)), F.when(there, F.col("o"))).alias(f"n_{c}")
    sums = updates.groupBy("listing_id").agg(
        last("content_hash", F.lit(True)), last("opportunity_type", F.lit(True)), last("funding_type", F.coalesce("funding_type", F.lit("")) != ""),
        last("degree_levels", F.size("degree_levels") > 0), last("deadline", F.col("deadline").isNotNull()), F.count("*").alias("n"),
        F.max_by("summary", F.struct(F.length(F.coalesce("summary", F.lit(""))).alias("n"), (-F.col("o")).alias("less"))).alias("n_summary"))
    dates = updates.filter(F.col("deadline").isNotNull()).select("listing_id", "o", "deadline").union(
        stored.join(updates.select("listing_id").distinct(), "listing_id", "left_semi").select("listing_id", F.lit(-1).cast("bigint").alias("o"), "deadline"))
    order = W.partitionBy("listing_id").orderBy("o")
    moves = dates.withColumn("was", F.lag("deadline").over(order)).filter((F.col("o") >= 0) & ~F.col("deadline").eqNullSafe(F.col("was")))
    recent = moves.withColumn("place", F.row_number().over(W.partitionBy("listing_id").orderBy(F.desc("o")))).filter(F.col("place") <= LOG)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    log = recent.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("o", F.lit("deadline").alias("field"), day("was").alias("from"), day("deadline").alias("to")))).alias("moves"))
    return sums.join(log, "listing_id", "left").withColumn("moves", F.coalesce(F.transform("moves", lambda m: F.struct(m["field"].alias("field"), m["from"].alias("from"), m["to"].alias("to"))), F.array().cast(f"array<{CHANGE}>")))


def applied(listings: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Listings with their folded updates."""
    j = listings.join(updates, "listing_id")
    log = F.concat("field_changes", "moves")
    longer = F.length(F.coalesce("n_summary", F.lit(""))) > F.length(F.coalesce("summary", F.lit("")))
    return j.withColumns({
        "field_changes": F.when(F.size(log) > LOG, F.slice(log, -LOG, LOG)).otherwise(log), "deadline": F.coalesce("n_deadline", "deadline"),
        "summary": F.when(longer, F.col("n_summary")).otherwise(F.col("summary")), "content_hash": F.col("n_content_hash"), "opportunity_type": F.col("n_opportunity_type"),
        "funding_type": F.coalesce("n_funding_type", "funding_type"), "degree_levels": F.coalesce("n_degree_levels", "degree_levels"),
        "last_seen_at": as_of, "n_updates": F.col("n_updates") + F.col("n")}).select(*FIELDS)


def ingested(batch: DataFrame, listings: DataFrame, as_of: Column, terms: G.ProfileTerms | None = None, min_ratio: float = 92.0) -> DataFrame:
    """New and changed listings after a batch of items (the columns of a listing, with pos and what the gate reads).

    Admitted items get the facts that their text states, and are resolved by (source_id, pos): new ones and shadows are
    listings, the others update the listing they belong to, one that came in the same batch as well."""
    passed = G.with_verdict(G.evaluate(batch.select("listing_id", "source_id", "url", "title", "summary", "source_regions"), terms), "admit").select("listing_id")
    # Written, not checkpointed: texts are compressed, and admitted ids go to the texts where they are few enough to be sent.
    facts = written(backfill_facts(derive_facts(batch.join(written(passed), "listing_id", "left_semi"))).withColumnRenamed("listing_id", "item_id"))
    actions = written(X.resolve_upsert(facts.select("item_id", "source_id", "pos", "title", "institution", "url_hash"), listings, min_ratio)
                          .select("item_id", "action", "target_id", "duplicate_of", "first_item", "shadow_of_item"))
    told = facts.drop("duplicate_of").join(actions, "item_id")
    new = told.filter(F.col("action").isin("create", "shadow", "shadow_new")).withColumn("duplicate_of", F.coalesce("duplicate_of", "shadow_of_item")).withColumn("listing_id", F.col("item_id"))
    new = new.withColumns({"last_seen_at": as_of, "field_changes": F.array().cast(f"array<{CHANGE}>"), "n_updates": F.lit(0).cast("bigint")}).select(*FIELDS)
    # The place of an item is its rank by (source_id, pos), as one number: items of a batch have fewer than 2**40 places.
    updates = told.filter(F.col("action").isin("update", "update_new")).select(
        F.coalesce("target_id", "first_item").alias("listing_id"), (F.col("source_id") * F.lit(1 << 40) + F.col("pos")).alias("o"), "deadline", "summary", "content_hash", "funding_type", "degree_levels", "opportunity_type")
    both = listings.select(*FIELDS).join(updates.select("listing_id").distinct(), "listing_id", "left_semi").unionByName(new)
    done = applied(both, folded(updates, both), as_of)
    return new.join(done.select("listing_id"), "listing_id", "left_anti").unionByName(done)


def stream_ingest(items: DataFrame, as_of: Column, terms: G.ProfileTerms | None = None, buckets: int = 16, root: str | None = None) -> tuple[str, int]:
    """Drains a stream of items into a snapshot; returns its folder and last version."""
    spark = items.sparkSession
    root, last = root or new_folder(spark, "ingest"), [0]

    def write(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        publish(s, root, n, ingested(batch, snapshot(s, root, n), as_of, terms), buckets)
        last[0] = n + 1

    drain(items, write, f"{root}/ckpt")
    return root, last[0]
