"""From raw documents to token ids: quality rules, near duplicates, benchmark passages, secrets, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet and read again as the next
one's ``docs``; all but the last return the columns of ``documents``.  Missing texts count as empty and are
rejected by the quality rules.  Rows that share an id are copies: one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, neardup, quality, secrets
from barloom.llm.queries import tokenizer
from barloom.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines above their host's limits."""
    kept = quality.apply(docs.select(*COLUMNS), blocks=True).where("kept")
    size = F.when(F.col("n_removed_lines") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", size.alias("n_chars"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    found = neardup.find(docs)
    gone = found.where("not kept").select("doc_id").distinct()
    rest = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    again = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return rest
    # the same row on every run, also after a lost executor
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source", "n_chars")
    once = rest.join(again, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return rest.join(again, "doc_id", "left_anti").unionByName(once)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.where("contaminated").select(F.col("doc_id").alias("leak")).distinct()
    return docs.select(*COLUMNS).join(leaks, F.col("doc_id").eqNullSafe(F.col("leak")), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    found = secrets.scan(docs.select(*COLUMNS))
    text = secrets.redact(F.col("text"), F.col("secrets"))
    size = F.when(F.size("secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the bytes they decode to."""
    path, pattern = tokenizer()
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, pattern), path, pattern)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scan", secrets_stage),
    ("byte-level BPE", encode_stage),
]

#: MinHash groups, matching of passages and BPE together are not expressed in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
