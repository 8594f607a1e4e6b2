"""Session settings and the shared scratch space used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution picks join strategies from *measured* sizes and splits skewed partitions,
#: which is why no operator in this package carries a broadcast hint.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`RECOMMENDED` to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    A local session without one gets a folder of its own; on a cluster that would lose rows, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="barloom-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options: str | int) -> DataFrame:
    """Evaluate ``df`` once into a columnar table in the shared folder and go on from there.

    Used where one panel feeds several branches of a plan (the data and its calendar, say), so the
    scan below it runs once.  Unlike a cached frame the written table survives the loss of executors,
    and unlike a checkpointed one it is pruned by column and has a known size, so later joins with it
    are planned on facts.  ``options`` go to the Parquet writer.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a frame that :func:`materialise` returned and no plan still to be run reads."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
