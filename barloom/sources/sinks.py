"""Tables out."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bars(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 20_000_000) -> None:
    """Consolidated columnar bar table: zstd Parquet by year, sorted so that row groups prune by symbol.

    Adaptive execution sizes the writers by volume: small years share one, a large year is split over many.
    """
    rows = df.withColumn("year", F.year(F.col("ts").cast("date")))
    (
        rows.hint("rebalance", F.col("year"))
        .sortWithinPartitions("year", "symbol", "ts")
        .write.mode(mode)
        .partitionBy("year")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A result table as CSV (with header) or Parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")


def replace_keys(df: DataFrame, path: str, key: str = "strategy_id", keys: DataFrame | None = None) -> None:
    """Replace the rows of the keys present in ``df`` and of those listed in ``keys``, keep all others.

    A key of ``keys`` without new rows ends up without rows.  The table is partitioned by ``key`` and only the partitions
    concerned are swapped, each as a whole, so a retried or repeated write leaves the same rows.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
    if keys is not None:
        _drop_folders(df.sparkSession, path, key, keys.select(key).distinct().join(df.select(key), key, "left_anti"))


def _drop_folders(spark: SparkSession, path: str, key: str, emptied: DataFrame) -> None:
    """Remove the partitions of ``emptied(key)``: one listing of the table's folders, met by the keys in Spark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(at):
        return
    names = [f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().startswith(f"{key}=")]
    folders = spark.createDataFrame([(n, urllib.parse.unquote(n.split("=", 1)[1])) for n in names], f"_folder string, `{key}` string")
    gone = folders.join(emptied.select(F.col(key).cast("string").alias(key)), key).select("_folder").collect()
    for row in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, row[0]), True)
