"""Running counts, recent lists and favourites as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from cardloom.operators.history import VIEWS


def engagement_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Daily views and clicks per card; rows later than the watermark are dropped. Months are rolled up from days in batch."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    days = timed.groupBy(F.window("ts", "1 day").alias("w"), "card_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return days.select(F.col("w.start").cast("date").alias("day"), "card_id", "views", "clicks")


def monthly_from_days(days: DataFrame) -> DataFrame:
    return days.groupBy(F.date_trunc("month", "day").cast("date").alias("month"), "card_id").agg(F.sum("views").alias("views"), F.sum("clicks").alias("clicks"))


class DayTable:
    """Daily counts in a folder, upserted by micro-batches: the sink of :func:`engagement_stream` in update mode.

    A batch's rows stand under its id, ``batch_id=N/day=D``. They are the totals of the days and cards that the batch
    changed, so a day's total is its row of the latest batch. A batch that is delivered again overwrites its own rows:
    the table is the same after any number of replays, whether the run before it ended, failed half-way or was lost.
    """

    SCHEMA = "card_id long, views long, clicks long, batch_id long, day date"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def upsert(self, changed: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        rows = changed.select("card_id", "views", "clicks", "day")
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch_id={batch_id}")

    def days(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(self.path)
        latest = rows.groupBy("day", "card_id").agg(F.max_by(F.struct("views", "clicks"), "batch_id").alias("n"))
        return latest.select("day", "card_id", "n.views", "n.clicks")

    def months(self) -> DataFrame:
        return monthly_from_days(self.days())


def engagement_into(events: DataFrame, table: DayTable, checkpoint: str, watermark: str = "1 day") -> None:
    """Runs the daily stream over all that ``events`` has now, into ``table``; a later run goes on where this one ended."""
    days = engagement_stream(events, watermark).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    days.foreachBatch(table.upsert).trigger(availableNow=True).start().awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_DAYS = 400


class RecentViews(StatefulProcessor):
    """A user's last views as a list state, whose entries end some time after they were last put."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getListState("views", "card_id long, micros long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = dict(self.views.get()) if self.views.exists() else {}
        for part in rows:
            for card, ts in zip(part["card_id"], part["micros"], strict=True):
                last[int(card)] = max(int(ts), last.get(int(card), int(ts)))
        kept = sorted(last.items(), key=lambda x: (-x[1], x[0]))[: self.n]
        self.views.put(kept)  # all of a user's entries live as long as their newest one
        yield pd.DataFrame({"user_id": key[0], "card_id": [c for c, _ in kept], "place": range(1, len(kept) + 1)})

    def close(self) -> None:
        pass


def recent_views_stream(events: DataFrame, n: int = VIEWS, idle_ms: int = IDLE_DAYS * 86_400_000) -> DataFrame:
    """The last ``n`` distinct cards of each user, kept live. Update mode; a batch's rows replace the user's list.

    State is a list of ``n`` entries at most. A user without views for ``idle_ms`` of processing time loses it, so state
    does not grow with every user there ever was. Rows without a user, a card or a time are left out. Needs the RocksDB
    state store: ``spark.sql.streaming.stateStore.providerClass`` is :data:`ROCKSDB`. A query that runs on processing time
    starts empty batches for ever; with the trigger ``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
    """
    timed = events.select("user_id", "card_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")).dropna()
    return timed.groupBy("user_id").transformWithStateInPandas(RecentViews(n, idle_ms), "user_id long, card_id long, place long", "Update", "ProcessingTime")


def favourites_stream(toggles: DataFrame) -> DataFrame:
    """Toggles per user and card, in update mode; an odd count is a favourite."""
    return toggles.groupBy("user_id", "card_id").agg(F.count(F.lit(1)).alias("n")).withColumn("favourite", F.col("n") % 2 == 1)
