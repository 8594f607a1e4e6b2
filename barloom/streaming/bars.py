"""Bars, gap sessions and upserts on streams.

Event time must be TIMESTAMP: convert wall-clock columns with
:func:`barloom.functions.columns.wall_clock_to_instant` first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.upsert import keep_last
from barloom.sources.stored import merge_into


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour", by: str = "symbol", price: str = "price", size: str | None = None) -> DataFrame:
    """OHLC bars from a tick stream (or batch): ``(by, ts, open, high, low, close, n)``.

    State is one bar per (instrument, open window); the watermark drops it ``late`` after the window.
    Aggregation combines per task first, so a busy instrument adds no shuffle volume.
    """
    order = F.struct("ts", price)
    bars = (
        ticks.withWatermark("ts", late)
        .groupBy(by, F.window("ts", width).alias("_w"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count("*").alias("n"),
            *([F.sum(size).alias("volume")] if size else []),
        )
    )
    rest = [x for x in bars.columns if x not in (by, "_w")]
    return bars.select(by, F.col("_w.start").alias("ts"), *rest)


def gap_sessions(ticks: DataFrame, gap: str = "6 days", late: str = "6 days", by: str = "symbol") -> DataFrame:
    """Uninterrupted stretches of bars: ``(by, first_ts, last_ts, n)``; two bars ``gap`` or more apart split.

    The hole between two consecutive sessions of an instrument is the gap the batch finder reports.
    """
    s = ticks.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("_s")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )
    return s.select(by, "first_ts", "last_ts", "n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "update"):
    """Write a stream as per-batch changes to ``path``; read it back with :func:`read_upserts`.

    Each micro-batch lands in its own partition and replaces it on a retry, which makes the sink
    idempotent; merging is left to the reader, so no batch rewrites the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
    )
    return query.start()


def read_upserts(spark, path: str, keys: list[str]) -> DataFrame:
    """Current state of an upserted table: per key the row of the latest batch."""
    rows = spark.read.parquet(path)
    return keep_last(rows, list(keys), "batch_id").drop("batch_id")


def compact(spark, path: str, target: str, keys: list[str]) -> None:
    """Merge the batches written so far into one table."""
    read_upserts(spark, path, keys).write.mode("overwrite").parquet(target)


# -- bars that take late rows at any time ---------------------------------------------------------

#: What two parts of a bar need to become one.
_PARTIAL = ("first_ts", "open", "last_ts", "close", "high", "low", "n")


def partial_bars(ticks: DataFrame, width: str = "1 hour", by: str = "symbol", price: str = "price") -> DataFrame:
    """What a set of ticks contributes to its bars: ``(by, ts, first_ts, open, last_ts, close, high, low, n)``."""
    order = F.struct("ts", price)
    return ticks.groupBy(by, F.window("ts", width).alias("_w")).agg(
        F.min("ts").alias("first_ts"),
        F.min_by(price, order).alias("open"),
        F.max("ts").alias("last_ts"),
        F.max_by(price, order).alias("close"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.count("*").alias("n"),
    ).select(by, F.col("_w.start").alias("ts"), *_PARTIAL)


def combined(parts: DataFrame, keys: list[str], *latest: str) -> DataFrame:
    """Parts of the same bar as one, in whatever order they came; of columns named in ``latest`` the greatest value stays."""
    return parts.groupBy(*keys).agg(
        F.min("first_ts").alias("first_ts"),
        F.min_by("open", F.struct("first_ts", "open")).alias("open"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("close", F.struct("last_ts", "close")).alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("n").alias("n"),
        *[F.max(x).alias(x) for x in latest],
    )


def stream_partials(ticks: DataFrame, path: str, checkpoint: str, width: str = "1 hour", by: str = "symbol", price: str = "price", trigger: dict | None = None):
    """Write each micro-batch's share of the bars to ``path``.

    No state is kept between batches, so none has to be dropped and no row is ever too late: it is one more part of its bar.
    A batch lands in its own partition and replaces it on a retry.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            partial_bars(batch, width, by, price)
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    query = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True}))
    return query.start()


def settle(spark, path: str, store: str, since: int = -1, by: str = "symbol", unit: str = "day") -> int:
    """Merge the parts of all batches after ``since`` into the bars stored by day and return the last batch merged.

    Only the days that these batches touch are read and rewritten.  Each stored bar knows the last batch in it (``upto``), so a
    batch that was merged before a failure is not merged again.
    """
    fresh = spark.read.parquet(path).where(F.col("batch_id") > since)
    last = fresh.agg(F.max("batch_id")).first()[0]
    if last is None:
        return since
    fresh = fresh.withColumn("upto", F.col("batch_id").cast("long")).drop("batch_id")

    def add(stored: DataFrame, new: DataFrame) -> DataFrame:
        done = stored.select(by, "ts", F.col("upto").alias("_done"))
        new = new.join(done, [by, "ts"], "left").where("_done IS NULL OR upto > _done").drop("_done")
        return combined(stored.unionByName(new), [by, "ts"], "upto").select(*stored.columns)

    merge_into(store, fresh, [by, "ts"], unit=unit, combine=add)
    return last
