"""Tables stored by calendar period, topped up in place: only the periods that fresh rows fall into are read and rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.upsert import upsert
from barloom.session import discard, materialise

#: Column that names a row's partition, and its form by unit.
PART = "part"
FORMS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def part_of(ts: str, unit: str) -> Column:
    return F.date_format(F.col(ts).cast("timestamp_ntz"), FORMS[unit])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def write_parts(df: DataFrame, path: str, ts: str = "ts", unit: str = "month") -> None:
    """Write whole partitions: those that ``df`` has rows for are replaced in one commit, the others stay as they are.

    Writers follow the volume of a partition (adaptive rebalancing), so one that holds most rows gets several files.
    """
    (
        df.withColumn(PART, part_of(ts, unit))
        .hint("rebalance", F.col(PART))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PART)
        .parquet(path)
    )


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The whole table without its partition column."""
    return spark.read.parquet(path).drop(PART)


def touched_parts(fresh: DataFrame, ts: str, unit: str) -> list[str]:
    """Names of the partitions that ``fresh`` falls into: bounded by the calendar, whatever the number of rows."""
    found = [r[PART] for r in fresh.select(part_of(ts, unit).alias(PART)).distinct().collect()]
    if None in found:
        raise ValueError(f"rows without '{ts}' belong to no partition")
    return sorted(found)


def merge_into(
    path: str,
    fresh: DataFrame,
    keys: list[str],
    ts: str = "ts",
    unit: str = "month",
    prefer: str = "fresh",
    combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> list[str]:
    """Merge ``fresh`` into the table at ``path`` and return the names of the partitions that were rewritten.

    Partitions without fresh rows are neither listed, read nor rewritten.  The merged partitions are written to the shared scratch folder first, then
    swapped in by one dynamic overwrite; running the same merge again leaves the same rows.  ``combine(stored, fresh)`` replaces the
    default, an upsert on ``keys`` in which ``prefer`` decides.  Rows without a time cannot be placed and are refused.
    """
    spark = fresh.sparkSession
    fresh = materialise(fresh)
    parts = touched_parts(fresh, ts, unit)
    if not parts:
        return []
    merge = combine or (lambda stored, new: upsert(stored, new, keys, prefer))
    stored = spark.createDataFrame([], fresh.schema)
    if exists(spark, path):
        stored = stored_parts(spark, path, parts, fresh)
    merged = materialise(merge(stored, fresh))
    write_parts(merged, path, ts, unit)
    discard(merged)
    discard(fresh)
    return parts


def stored_parts(spark: SparkSession, path: str, parts: list[str], like: DataFrame) -> DataFrame:
    """The stored rows of some partitions, found by pruning their folders."""
    schema = type(like.schema)([*like.schema.fields]).add(PART, "string")
    return spark.read.schema(schema).parquet(path).where(F.col(PART).isin(parts)).select(*like.columns)
