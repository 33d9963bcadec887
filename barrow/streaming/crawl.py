"""A crawl as a stream (STM-01..07): listing pages come in as files, states are kept, a report follows each batch.

Windows over events are additions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barrow.sources.files import status_cascade
from barrow.sources.sinks import status_counts


def crawl(spark: SparkSession, folder: str, schema: str, known: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str, *, excluded: list[str], start: str, end: str) -> StreamingQuery:
    """Items of JSON listing files in a folder through the status cascade, batch by batch.

    report gets the counts of each batch; the checkpoint makes an interrupted crawl go on where it stopped.
    """
    items = spark.readStream.schema(schema).json(folder)

    def batch(df: DataFrame, number: int) -> None:
        report(status_counts(status_cascade(df, known, excluded, start, end)), number)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = ("total", "downloaded", "skipped", "queued", "failed")


def cumulative(spark: SparkSession, folder: str, schema: str, known: DataFrame, states: str, checkpoint: str, *, excluded: list[str], start: str, end: str) -> StreamingQuery:
    """STM-01, STM-02, STM-03, STM-07: the crawl with its state over all pages so far, written after each batch.

    states is a folder of Parquet, one part for each batch: a batch that is run again after a failure overwrites its own
    part, so nothing is counted twice; progress() adds the parts up.
    """
    items = spark.readStream.schema(schema).json(folder)

    def batch(df: DataFrame, number: int) -> None:
        status_counts(status_cascade(df, known, excluded, start, end)).write.mode("overwrite").parquet(f"{states}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, states: str) -> DataFrame:
    """STM-03: the counts of a crawl after each batch, cumulative: (batch, total, downloaded, skipped, queued, failed)."""
    told = spark.read.option("basePath", states).parquet(states)
    # One small row for each batch.
    return told.select("batch", *[F.sum(c).over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in COUNTS])


def state(query: StreamingQuery) -> str:
    """STM-06: PENDING, PROGRESS, SUCCESS or FAILURE of a crawl."""
    if query.exception() is not None:
        return "FAILURE"
    if not query.isActive:
        return "SUCCESS"
    return "PROGRESS" if query.lastProgress else "PENDING"


def windowed(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, late ones dropped after the watermark; works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    return events.withWatermark(ts, "10 minutes").groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("session_start"), "n")
