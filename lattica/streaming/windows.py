"""Extensions over event streams: the same function serves a stream and a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.base import Registry
from ..sources import io

R = Registry()


def tumbling(events: DataFrame, size: str, *aggs, time: str = "ts", keys: tuple[str, ...] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by window (sliding, with ``slide``) and keys; ``late``: how long rows may come late."""
    if late is not None:
        events = events.withWatermark(time, late)
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(span.alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *(_name(a) for a in aggs))


def sessions(events: DataFrame, gap: str, *aggs, time: str = "ts", keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    if late is not None:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *(_name(a) for a in aggs))


def _name(column) -> str:
    return column._jc.toString().rpartition(" AS ")[2].strip("`") if hasattr(column, "_jc") else str(column)


def deduplicate(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First row of each key; on a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def upsert_feed(changes: DataFrame, target_path: str, key: list[str], checkpoint: str, order: str):
    """Apply each micro-batch of a change stream to a versioned Parquet table; the row of a key that is greatest by ``order`` wins, null orders last of all."""
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{target_path}/v{number - 1}") if number else spark.createDataFrame([], batch.schema)
        row = F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_order"), F.struct(*batch.columns).alias("_row"))
        last = batch.groupBy(*key).agg(F.max(row).alias("_last")).select("_last._row.*")
        io.upsert(old, last, key).write.mode("overwrite").parquet(f"{target_path}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, name: str, mode: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Drive a finite stream to its end into an in-memory table (for tests)."""
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@R.frame("ST1_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS s, event_type, count(*) AS n FROM events GROUP BY ALL")
def _tumbling(t):
    return tumbling(t.events, "6 hours", F.count("*").alias("n"), keys=("event_type",)).select(F.col("start").cast("timestamp_ntz").alias("s"), "event_type", "n")


@R.frame(
    "ST2_sliding",
    """SELECT s, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '1 hour']) AS s FROM events) GROUP BY s""",
)
def _sliding(t):
    return tumbling(t.events, "2 hours", F.count("*").alias("n"), slide="1 hour").select(F.col("start").cast("timestamp_ntz").alias("s"), "n")


@R.frame(
    "ST3_sessions",
    """SELECT user_id, count(*) AS n, min(ts) AS s FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
       (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""",
)
def _sessions(t):
    return sessions(t.events, "12 hours", F.count("*").alias("n"), keys=("user_id",)).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("s"))


@R.frame("ST5_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def _static(t):
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")


@R.frame("ST6_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _dedup(t):
    return deduplicate(t.events, ["user_id", "event_type"]).select("user_id", "event_type")
