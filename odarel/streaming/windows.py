"""Windowed aggregates over events, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odarel.operators.delta import tombstones


def tumbling(events: DataFrame, time: str, width: str, by: list[str], *, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Counts per window and group. A stream needs ``lateness``: later rows are left out and their state dropped."""
    if lateness is not None:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    counted = events.groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], *, lateness: str | None = None) -> DataFrame:
    """Counts per session: rows of a group that are less than ``gap`` apart."""
    if lateness is not None:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counted = events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def stream(spark: SparkSession, path: str, like: DataFrame, *, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in ``path``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def feed(changes: DataFrame, keys: list[str], publish: Callable[[DataFrame, DataFrame, int], None], snapshot: Callable[[], DataFrame], checkpoint: str, *, by: str | None = None, removed: str | None = None):
    """Publish each micro-batch's latest row per key, and what is gone.

    ``publish(rows, removed, batch)`` is called for each batch. The latest row of a key has the greatest
    value of ``by``; without it a key's rows count as alike. Where the stream carries changes, ``removed`` names a true or false column
    that marks rows which are gone. Without it each batch is a whole state, and what ``snapshot()``, read when the batch runs, has besides is gone.
    """

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.dropDuplicates(keys)
        if by is not None:
            row = F.struct(*[batch[c] for c in batch.columns])
            latest = batch.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.struct(F.col(by), F.xxhash64(row))).alias("row")).select("row.*")
        if removed is None:
            publish(latest, tombstones(snapshot(), batch, keys), number)
            return
        gone = F.coalesce(F.col(removed), F.lit(False))
        publish(latest.filter(~gone), latest.filter(gone).select(*keys).withColumn("@removed", F.lit("deleted")), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
