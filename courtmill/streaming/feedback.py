"""Extensions: feedback as a stream. The batch twins give the same rows on the same events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtmill.operators import upsert

WINDOW = "1 hour"
LATE = "10 minutes"


def item(props: Column) -> Column:
    """The item an event is about, from its JSON properties."""
    return F.get_json_object(props, "$.k").try_cast("int")


def last_votes(events: DataFrame) -> DataFrame:
    """(user_id, item, event_type, event_id): each user's last event on each item."""
    rows = events.select("user_id", item(F.col("props")).alias("item"), "event_type", "ts", "event_id").filter("item is not null")
    return rows.groupBy("user_id", "item").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("last")).select("user_id", "item", "last.event_type", "last.event_id")


def latest_only(requests: DataFrame, session: str = "user_id", number: str = "event_id") -> DataFrame:
    """Each session's latest request; answers to earlier ones are stale and dropped."""
    rest = [c for c in requests.columns if c != session]
    last = requests.groupBy(session).agg(F.max_by(F.struct(*rest), number).alias("r"))
    return last.select(*[F.col(session) if c == session else F.col(f"r.{c}").alias(c) for c in requests.columns])


def windows(events: DataFrame, width: str = WINDOW) -> DataFrame:
    """(window_start, event_type, n, total): counts and sums of values by tumbling window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return _windowed(timed, width)


def _windowed(timed: DataFrame, width: str) -> DataFrame:
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_stream(stream: DataFrame, width: str = WINDOW, late: str = LATE) -> DataFrame:
    """``windows`` over a stream; events later than ``late`` are left out."""
    return _windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)


def upserting(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch to ``apply``, such as an upsert; exactly once per batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalog_stream(stream: DataFrame, folder: str, checkpoint: str, now: Column, key: str = "ord"):
    """Each micro-batch of canonical shoes becomes the next snapshot of the catalogue under ``folder``.

    ``stream`` has the catalogue's columns without ids and times, and ``key``, by which the last row of an id
    within a batch stands. Shoes that a batch lacks stay: a stream brings changes, not the whole catalogue.
    The first snapshot, version 0, must exist.
    """

    def apply(batch: DataFrame, number: int) -> None:
        existing = batch.sparkSession.read.parquet(f"{folder}/version={number}")
        columns = [c for c in existing.columns if c not in ("id", "created_at", "updated_at")]
        last = batch.groupBy("canonical_id").agg(F.max_by(F.struct(*[c for c in columns if c != "canonical_id"]), key).alias("r")).select("canonical_id", "r.*")
        kept = existing.filter(F.col("canonical_id").isNotNull()).join(last.select("canonical_id"), "canonical_id", "left_anti")
        upsert.upsert_batch({"catalog": folder}, kept.select(*columns).unionByName(last.select(*columns)), now, number + 1)

    return upserting(stream, apply, checkpoint)
