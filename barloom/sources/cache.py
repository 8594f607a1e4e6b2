"""A consolidated copy of a folder of files, rebuilt only where the files have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import discard, materialise
from barloom.sources.files import path_label
from barloom.sources.stored import exists

#: Parts of the copy; the instruments of a part are rebuilt together.
BUCKETS = 64


def manifest(spark: SparkSession, path: str | list[str], label: str = "file", buckets: int = BUCKETS) -> DataFrame:
    """``(path, modified, length, bucket)`` of every file below ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bucket = F.pmod(F.xxhash64(path_label(label)), F.lit(buckets)).cast("int")
    return files.select("path", F.col("modificationTime").alias("modified"), "length", bucket.alias("bucket"))


def refresh(
    spark: SparkSession,
    path: str | list[str],
    cache: str,
    read: Callable[[list[str]], DataFrame],
    label: str = "file",
    buckets: int = BUCKETS,
) -> list[int]:
    """Bring the copy at ``cache`` up to date with the files below ``path`` and return the parts that were rebuilt.

    A part is rebuilt when one of its files is new, gone, or of another size or time than the manifest written with the copy says:
    ``read(paths)`` reads that part's files into rows with a ``symbol``, and one dynamic overwrite swaps the parts in.  The
    manifest is written last, so a refresh that fails half way is done again.  Nothing is read or written when nothing changed.
    Paths pass through the driver, as Spark's own listing of files does.
    """
    now = materialise(manifest(spark, path, label, buckets))
    known, version = f"{cache}/manifest", 0
    changed = now.select("bucket").distinct()
    if exists(spark, known):
        old = spark.read.parquet(known)
        version = old.agg(F.max("version")).first()[0]
        old = old.where(F.col("version") == version).select(now.columns)
        moved = now.exceptAll(old).unionByName(old.exceptAll(now))
        changed = moved.select("bucket").distinct()
    parts = sorted(r.bucket for r in changed.collect())
    if parts:
        paths = [r.path for r in now.where(F.col("bucket").isin(parts)).select("path").collect()]
        if paths:
            rows = read(paths)
            bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")
            out = rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{cache}/rows")
        now.withColumn("version", F.lit(version + 1)).coalesce(1).write.mode("append").parquet(known)
    discard(now)
    return parts


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The rows of the copy; parts whose files are all gone are left out."""
    listed = spark.read.parquet(f"{cache}/manifest")
    version = listed.agg(F.max("version")).first()[0]
    live = [r.bucket for r in listed.where(F.col("version") == version).select("bucket").distinct().collect()]
    return spark.read.parquet(f"{cache}/rows").where(F.col("bucket").isin(live)).drop("bucket")
