"""Keyset pages joined are the whole list."""

import pytest
from pyspark.sql import functions as F

from fairlead.operators import feed as P


@pytest.mark.parametrize("bucket, sort", [("matches", "fit"), ("matches", "deadline"), ("closing_soon", "fit")])
def test_pages_joined_equal_the_list(spark, bucket, sort):
    """Ties in everything but the id, nulls in every key of the order."""
    i = F.col("listing_id")
    rows = spark.range(40).withColumnRenamed("id", "listing_id").withColumns({
        "rank_position": F.when(i % 3 != 0, i % 4), "fit_score": F.when(i % 5 != 0, (i % 7) / 7.0), "verification_status": F.when(i % 2 == 0, "primary_confirmed").otherwise("aggregator_only"),
        "created_at": F.when(i % 6 != 0, F.timestamp_seconds(i % 3)), "deadline": F.timestamp_seconds(1000 + i % 5) if bucket == "closing_soon" else F.when(i % 4 != 0, F.timestamp_seconds(i % 5))}).cache()
    want = [r["listing_id"] for r in rows.orderBy(*P.feed_order(bucket, sort)).collect()]
    got, after = [], None
    while page := P.page_after(rows, bucket, sort, after, 11).collect():
        got += [r["listing_id"] for r in page]
        after = page[-1]["cursor"]
    assert got == want and len(got) == 40
