"""Byte-level BPE encoding and decoding in overlapping chunks.

A long text is cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``.  Each chunk is split into
pre-tokens on its own.  A scan for pre-tokens looks only ahead, never back, so two scans that both
have a boundary at one place agree from there on.  The first such place in the overlap, where the left chunk
already knows its boundary for certain (its last two characters are not used), joins the chunks: the text
before belongs to the left, the rest to the right.  By induction every join is a boundary of the scan of the
whole text.  A join never follows white space, so that a run of white space is never cut from what stands after it.  Where
an overlap has no common boundary (one word longer than the overlap, say) that document is encoded in one piece; the
result is the same.  Pieces are encoded apart and their ids put together in order.

Scale: texts up to ``CHUNK`` characters, nearly all, are encoded where they lie, without a shuffle.  Of longer ones
the boundaries in the overlaps, a few integers, are shuffled by row, then the texts of just these meet their joins.

Defined results: a null or empty text has no ids; any row may come several times; an empty table gives no rows; other
columns pass through :func:`encode` (working columns have a ``_b_`` prefix; a column ``ids`` is replaced).  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import words

#: Characters in a chunk, and of them shared with the next one.
CHUNK, OVERLAP = 65_536, 1_024
#: Texts encoded at once, in characters.
AT_ONCE = 1_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Byte-pair ranks of a ``.tiktoken`` file; its size is that of the vocabulary."""
    try:
        lines = open(path, "rb").read().splitlines()
    except FileNotFoundError:  # a path that only Spark's readers open
        lines = [r[0].encode() for r in spark.read.text(path).toLocalIterator()]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Coder:
    """Ranks and pattern as sent to tasks, with the encoder each worker makes of them once."""

    _made: dict[tuple, object] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.key = ranks, pattern, (pattern, len(ranks), hash(frozenset(ranks.items())))

    def encoder(self):
        import tiktoken

        if self.key not in self._made:
            self._made[self.key] = tiktoken.Encoding("byte_bpe", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._made[self.key]


def _boundaries(pattern: regex.Pattern, text: str, last: bool) -> list[int]:
    """Ends of pre-tokens that are certain and do not follow white space."""
    sure = len(text) if last else len(text) - 2
    return [e for m in pattern.finditer(text) if (e := m.end()) <= sure and not text[e - 1].isspace()]


def _encode(spark, rows: DataFrame, coder, text_col: str) -> DataFrame:
    """``rows`` with ``ids``, each text on its own."""
    names = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder.value.encoder()
        for batch in batches:
            texts = batch.column(text_col)
            low = 0
            while low < batch.num_rows:
                got, size, high = [], 0, low
                while high < batch.num_rows and (size < AT_ONCE or high == low):
                    text = texts[high].as_py() or ""
                    size += len(text)
                    got.append(enc.encode_ordinary(text))
                    high += 1
                part = batch.slice(low, high - low).select(names)
                ids = pa.array(got, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*names, "ids"])
                low = high

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([rows.schema[n] for n in names]).add("ids", ArrayType(IntegerType()))
    return rows.select(*names, text_col).mapInArrow(run, schema)


def joins(chunks: DataFrame, pattern: str) -> DataFrame:
    """``(_b_row, _b_cuts)`` of documents in chunks: places to cut at, null where some overlap has none.

    ``chunks``: ``_b_row, _b_k, _b_n`` (chunks of the document), ``_b_part`` (its text).
    """

    def run(batches):
        p = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, n, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ends = _boundaries(p, part, k == n - 1)
                heads.append([k * CHUNK + e for e in ends if e <= OVERLAP] if k else [])
                tails.append([k * CHUNK + e for e in ends if e > CHUNK] if k < n - 1 else [])
            of = [*batch.columns[:3], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(of, ["_b_row", "_b_k", "_b_n", "head", "tail"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([chunks.schema[n] for n in ("_b_row", "_b_k", "_b_n")])
    schema = schema.add("head", ArrayType(IntegerType())).add("tail", ArrayType(IntegerType()))
    ends = chunks.select("_b_row", "_b_k", "_b_n", "_b_part").mapInArrow(run, schema)
    right = ends.select("_b_row", (F.col("_b_k") - 1).alias("_b_k"), F.col("head").alias("next"))
    met = ends.join(right, ["_b_row", "_b_k"]).withColumn("cut", F.array_min(F.array_intersect("tail", "next")))
    per_row = met.groupBy("_b_row").agg(
        F.sort_array(F.collect_list("cut")).alias("cuts"), F.count("*").alias("joined")
    )
    return per_row.select("_b_row", F.when(F.size("cuts") == F.col("joined"), F.col("cuts")).alias("_b_cuts"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the text; the text itself is left out."""
    spark, docs = docs.sparkSession, docs.drop("ids")
    words.batches(spark)
    coder = spark.sparkContext.broadcast(Coder(read_ranks(spark, path), pattern))
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    short = _encode(spark, docs.where(size <= CHUNK), coder, text_col)
    rest = [c for c in docs.columns if c != text_col]
    # a row is known by a hash of all its columns; equal rows have equal ids, so it does not matter which is which
    row = F.struct(F.xxhash64(F.to_json(F.struct(*docs.columns))).alias("a"), F.xxhash64(F.lit(1), F.to_json(F.struct(*docs.columns))).alias("b"))
    long = docs.where(size > CHUNK).withColumn("_b_row", row)
    n = F.ceil((F.length(text_col) - OVERLAP) / CHUNK).cast("int")
    one = long.dropDuplicates(["_b_row"]).select("_b_row", F.col(text_col).alias("_b_text"), F.greatest(n, F.lit(1)).alias("_b_n"))
    chunks = one.withColumn("_b_k", F.explode(F.sequence(F.lit(0), F.col("_b_n") - 1))).select(
        "_b_row", "_b_k", "_b_n", F.substring("_b_text", F.col("_b_k") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("_b_part")
    )
    cut = one.join(joins(chunks.where("_b_n > 1"), pattern), "_b_row", "left")
    edges = F.concat(F.array(F.lit(0)), F.coalesce("_b_cuts", F.array().cast("array<int>")), F.array(F.length("_b_text")))
    pieces = cut.select("_b_row", "_b_text", edges.alias("e")).select(
        "_b_row", "_b_text", "e", F.posexplode(F.slice("e", 1, F.size("e") - 1)).alias("k", "start")
    )
    pieces = pieces.select(
        "_b_row", "k", F.substring("_b_text", F.col("start") + 1, F.get("e", F.col("k") + 1) - F.col("start")).alias("_b_part")
    )
    coded = _encode(spark, pieces, coder, "_b_part")
    whole = coded.groupBy("_b_row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = whole.select("_b_row", F.flatten("parts.ids").alias("ids"))
    return short.unionByName(long.select("_b_row", *rest).join(whole, "_b_row").select(*rest, "ids"))


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``coded`` with ``bytes``: the raw bytes of all ``ids`` one after another (null ids: none)."""
    spark = coded.sparkSession
    words.batches(spark)
    coder = spark.sparkContext.broadcast(Coder(read_ranks(spark, path), pattern))

    @F.pandas_udf("binary")
    def joined(ids):
        enc = coder.value.encoder()
        return ids.map(lambda x: enc.decode_bytes(x.tolist()) if x is not None else b"")

    return coded.withColumn("bytes", joined("ids"))
