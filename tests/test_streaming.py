"""Event streams: windows with watermarks, deduplication, and a change feed, each against the table form."""

import glob
import os

from pyspark.sql import functions as F

from lattica.sources import io
from lattica.streaming import windows


def stream(spark, sf):
    path = io.fresh_path(spark, "feed")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    return events, spark.readStream.schema(events.schema).parquet(path)


def test_tumbling_stream_equals_table(spark, sf):
    events, feed = stream(spark, sf)
    agg = lambda df, late: windows.tumbling(df, "1 day", F.count("*").alias("n"), keys=("event_type",), late=late)
    got = windows.run_to_end(feed, "tumbling", "complete", lambda df: agg(df, "40 days"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, agg(events, None).collect()))


def test_late_rows_are_dropped(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = io.fresh_path(spark, "late")
    # days 20 on come first, days before 10 last: far behind the watermark that a batch takes over from the one before
    for part in ("day(ts) between 20 and 24", "day(ts) >= 25", "day(ts) < 10"):
        events.where(part).coalesce(1).write.mode("append").parquet(path)
        for f in glob.glob(f"{path}/*.parquet"):
            os.utime(f, (os.path.getmtime(f) - 100,) * 2)  # the former file is the older one
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = windows.run_to_end(feed, "late", "append", lambda df: windows.tumbling(df, "1 day", F.count("*").alias("n"), late="1 hour"))
    n = got.agg(F.sum("n")).first()[0]
    assert 0 < n <= events.where("day(ts) >= 20").count() and events.where("day(ts) < 10").count() > 0


def test_deduplicated_stream(spark, sf):
    events, feed = stream(spark, sf)
    got = windows.run_to_end(feed, "dedup", "append", lambda df: windows.deduplicate(df, ["event_id"], late="40 days"))
    assert got.count() == events.select("event_id").distinct().count()


def test_change_feed(spark, sf):
    events, feed = stream(spark, sf)
    target = io.fresh_path(spark, "target")
    q = windows.upsert_feed(feed.select("user_id", "event_id", "event_type"), target, ["user_id"], io.fresh_path(spark, "checkpoint"), order="event_id")
    q.awaitTermination()
    last = events.groupBy("user_id").agg(F.max("event_id"), F.max_by("event_type", "event_id"))
    assert sorted(map(tuple, spark.read.parquet(f"{target}/v0").collect())) == sorted(map(tuple, last.collect()))
