"""Near duplicates by MinHash, with sequential Bayesian verification.

A document's set is its distinct 5-word shingles.  Documents with equal sets form a class and go on as its least id.

1. *Candidates*: signatures of 128 minima in 32 bands of 4; documents that share a band are candidates.  A pair at
   the limit of 0.75 shares none with probability ``(1 - 0.75**4)**32 = 5e-6``.
2. *Sequential verification*: signatures are compared 16 values at a time.  After n values with m equal, the
   similarity has the posterior Beta(m + 1, n - m + 1) under a flat prior; a pair is dropped as soon as the
   posterior probability of reaching the limit is below ``MISS``.
3. *Exact verification*: survivors are confirmed on their full sets.

A band bucket of at most ``SMALL`` documents yields its pairs, a number per document that does not grow.  In a larger
bucket every document is paired with two: the least one and the hub, which has most company in all its bands (among edited
copies the original).  That leaves out links only between documents that do not end up together.  Buckets whose documents
are then still in several components are looked at again: such buckets that share documents form a cluster, whose documents, each once, are sorted by
size and cut into chunks of bounded size.  Each chunk meets itself and every other chunk of its cluster within reach of its sizes, sequentially and exactly as above, and
gives the links that join components.  Nothing that is connected is lost and no group yields its pairs as rows.

Scale: the only thing broadcast is a filter of ids of at most 8 MB, and no group is collected beyond ``SMALL`` ids.  A key with a third of all rows (copies,
a common band) is reduced by aggregation with map-side combine or is a join side that adaptive execution splits.  Of the
candidate pairs first one per document is verified, then only pairs whose ends are not yet connected, so the number of set
comparisons follows the number of documents, not the square of a group.  A cluster of ``c`` chunks meets in ``c * (c + 1) / 2`` pairs of chunks, in
which documents of one component are not compared.  Intermediate tables are written to the shared folder.

Defined results: null or empty texts and texts without words have no set and no links; fewer words than five are one
shingle; rows that share an id count as one document with several texts; a null id is never linked; an empty table
gives no rows; other columns are ignored.  Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.operators.components import connected_components
from barloom.session import discard, materialise

SHINGLE = 5
#: Similarity limit in percent.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Signature values compared at a time.
STEP = 16
#: A pair is dropped when its similarity reaches the limit with less than this posterior probability.
MISS = 1e-6
#: Buckets up to this size yield all their pairs.
SMALL = 12
#: Documents, and shingles, in a chunk of a cluster of larger buckets.
BLOCK, BLOCK_SHINGLES = 256, 100_000
#: Most bits (8 MB) of the filter that passes the documents of shared bands.
MARK_BITS = 1 << 26

_SIZE = BANDS * ROWS
_DRAW = np.random.default_rng(777)
_TIMES = _DRAW.integers(0, 2**32, _SIZE, dtype=np.uint32) | np.uint32(1)
_FLIP = _DRAW.integers(0, 2**32, _SIZE, dtype=np.uint32)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, owner = words.hashed(texts, words.SPACED)
    all_windows = words.windows(h, SHINGLE) if len(h) >= SHINGLE else None
    for a, b in zip(owner[:-1], owner[1:], strict=True):
        yield np.unique(all_windows[a : b - SHINGLE + 1] if b - a >= SHINGLE else words.windows(h[a:b], SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 hash functions over a set that is not empty."""
    low = np.full(_SIZE, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[i : i + 2048] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=low)
    return low


def _bands(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sig.reshape(BANDS, ROWS).T:
        key = words.mix(key ^ row) * np.uint64(0xD6E8FEB86659FD93)
    return words.mix(key).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in words.runs(batch.column(1)):
            size, fa, fb, sigs, bands = [], [], [], [], []
            for s in _sets(batch.column(1).slice(i, j - i)):
                size.append(len(s))
                fa.append(int(words.mix(s).sum(dtype=np.uint64).view(np.int64)))
                fb.append(int(np.bitwise_xor.reduce(words.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
                # sets of one or two can only be linked to an equal set
                sig = signature(s) if len(s) > 2 else None
                sigs.append(sig.tobytes() if sig is not None else None)
                bands.append(_bands(sig) if sig is not None else None)
            columns = [
                batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()),
                pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "fa", "fb", "sig", "bands"])


class Marks:
    """Which of the ids may be wanted: a bit for the hash of each wanted one, at most ``MARK_BITS`` bits in all."""

    def __init__(self, ids: DataFrame):
        size = 1 << 16
        while size < min(MARK_BITS, 16 * ids.count()):
            size *= 2
        bit = F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 17)).bitwiseAND(F.lit(size - 1))
        parts = ids.select(F.shiftright(bit, 5).cast("int").alias("w"), (bit % 32).cast("int").alias("b"))
        rows = parts.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x"))
        self.bits = np.zeros(size // 32, np.int64)
        found = rows.toArrow()  # at most MARK_BITS / 32 rows, in one job
        self.bits[found.column("w").to_numpy()] = found.column("x").to_numpy()
        self.size = size

    def __call__(self, ids: pa.Array) -> pa.Array:
        i = ids.fill_null(0).to_numpy()
        at = (i ^ (i.view(np.uint64) >> np.uint64(17)).view(np.int64)) & (self.size - 1)
        return pa.array((self.bits[at >> 5] >> (at & 31)) & 1 == 1)


def _marked(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(marks.value(batch.column(0)))

    return run


def _full(marks):
    """Sets of the texts that pass the marks, filtered and made in one step so that a core runs one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(marks.value(batch.column(0)))
            for i, j in words.runs(some.column(1)):
                sets = [s.view(np.int64) for s in _sets(some.column(1).slice(i, j - i))]
                columns = [some.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set"])

    return run


@cache
def least_equal(percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Equal values that a pair needs after each step to stay: P(similarity >= limit | m of n) >= miss."""
    t, out = percent / 100, []
    for n in range(STEP, _SIZE + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _plausible(need: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, _SIZE) for c in (2, 3))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(need):
                part = slice(k * STEP, (k + 1) * STEP)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= least]
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return run


class Chunk:
    """Documents of one cluster, side by side: ids, components, signatures and full sets."""

    def __init__(self, row: dict):
        self.ids, self.components = row["ids"], row["components"]
        self.sigs = np.frombuffer(row["sigs"], np.uint32).reshape(-1, _SIZE)
        self.sizes = np.array(row["sizes"], np.int64)
        self.sets = np.split(np.frombuffer(row["sets"], np.int64), np.cumsum(self.sizes)[:-1])


def _confirmed(x: Chunk, y: Chunk, need: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of two chunks (or of one with itself) as far as their documents are linked.

    Every document meets the other chunk's signatures ``STEP`` values at a time; what is left is confirmed on full sets, the
    likeliest first, unless a link found before has joined the two components.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    found, comps = [], np.array(y.components)
    for i in range(len(x.ids)):
        later = i + 1 if x is y else 0
        fits = 100 * np.minimum(x.sizes[i], y.sizes) >= percent * np.maximum(x.sizes[i], y.sizes)
        fits[:later] = False
        alive = np.flatnonzero(fits & (comps != x.components[i]))
        equal = np.zeros(len(y.ids), np.int64)
        for k, least in enumerate(need):
            part = slice(k * STEP, (k + 1) * STEP)
            equal[alive] += (y.sigs[alive, part] == x.sigs[i, part]).sum(axis=1)
            alive = alive[equal[alive] >= least]
        for j in alive[np.argsort(-equal[alive], kind="stable")].tolist():
            a, b = root(x.components[i]), root(y.components[j])
            if a != b:
                both = int(x.sizes[i] + y.sizes[j]) - len(np.union1d(x.sets[i], y.sets[j]))
                if 100 * both >= percent * (x.sizes[i] + y.sizes[j] - both):
                    parent[max(a, b)] = min(a, b)
                    found.append((min(x.ids[i], y.ids[j]), max(x.ids[i], y.ids[j])))
    return found


_CHUNK_FIELDS = pa.schema(
    [
        ("cluster", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("components", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())), ("sigs", pa.binary()), ("sets", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
    ]
)
_CHUNKS = "cluster long, chunk long, ids array<long>, components array<long>, sizes array<long>, sigs binary, sets binary, links array<struct<a: long, b: long>>"


def _chunk_rows(need: np.ndarray, percent: int):
    """Cut rows ``(cluster, doc_id, component, sig, set)``, sorted by cluster and size, into chunks, each with its own links."""

    def close(rows: list[tuple], chunk: int) -> pa.RecordBatch:
        cluster, ids, components, sigs, sets = zip(*rows, strict=True)
        row = {
            "cluster": cluster[0], "chunk": chunk, "ids": list(ids), "components": list(components), "sizes": [len(s) for s in sets],
            "sigs": b"".join(sigs), "sets": b"".join(s.tobytes() for s in sets),
        }
        one = Chunk(row)
        return pa.RecordBatch.from_pylist([row | {"links": [{"a": a, "b": b} for a, b in _confirmed(one, one, need, percent)]}], _CHUNK_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for cluster, doc_id, component, sig, tokens in zip(*columns, batch.column(4), strict=True):
                s = tokens.values.to_numpy()
                if rows and (len(rows) == BLOCK or held + len(s) > BLOCK_SHINGLES or rows[0][0] != cluster):
                    yield close(rows, chunk)
                    chunk, rows, held = chunk + 1, [], 0
                rows.append((cluster, doc_id, component, sig, s.copy()))
                held += len(s)
        if rows:
            yield close(rows, chunk)

    return run


def _chunk_pair(need: np.ndarray, percent: int):
    def run(table: pa.Table) -> pa.Table:
        x, y = (Chunk(row) for row in table.drop_columns(["cluster", "pair", "chunk"]).to_pylist())
        pairs = np.array(_confirmed(x, y, need, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


class Duplicates:
    """The steps over one table, each written once."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int):
        self.percent = percent
        words.batches(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        sketch = materialise(
            self.docs.mapInArrow(_sketch, "doc_id long, n long, fa long, fb long, sig binary, bands array<long>")
        )
        #: (doc_id, n, fa, fb) of every row.
        self.rows = materialise(sketch.select("doc_id", "n", "fa", "fb"))
        full = sketch.where("n > 0 and doc_id is not null")
        #: One row per class: (rep, n, fa, fb, sig, bands), rep its least id; equal sets have equal signatures.
        self.classes = materialise(
            full.groupBy("fa", "fb").agg(
                F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
            )
        )
        discard(sketch)
        named = self.rows.where("n > 0 and doc_id is not null").select("doc_id", "fa", "fb")
        #: (doc_id, rep) of every row that has a set.
        self.member = materialise(named.join(self.classes.select("fa", "fb", "rep"), ["fa", "fb"]).select("doc_id", "rep"))
        several = self.member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
        self.own = self.member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")

    def buckets(self) -> DataFrame:
        """``(key, doc_id, n, low, hub)``: documents in the bands that they share with others, with the least document of
        the bucket and the one that has most company in all its bands (the original, among edited copies)."""
        rows = self.classes.where("sig is not null").select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
        shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1")
        members = materialise(rows.join(shared, "key"))
        large = members.where(F.col("n") > SMALL)
        company = large.groupBy("doc_id").agg(F.sum("n").alias("company"))
        best = F.max(F.struct("company", (-F.col("doc_id")).alias("least")))
        hubs = large.join(company, "doc_id").groupBy("key").agg((-best["least"]).alias("hub"))
        buckets = materialise(members.join(hubs, "key", "left"))
        # what is known of these documents: texts and classes pass a filter of their ids before anything is shuffled
        ids = buckets.select("doc_id").distinct()
        marks = ids.sparkSession.sparkContext.broadcast(Marks(ids))
        some = self.classes.select(F.col("rep").alias("doc_id"), "n", "sig").where("sig is not null")
        self.reps = materialise(some.mapInArrow(_marked(marks), some.schema).join(ids, "doc_id", "left_semi"))
        found = self.docs.mapInArrow(_full(marks), "doc_id long, set array<long>")
        self.sets = materialise(found.join(ids, "doc_id", "left_semi"))
        return buckets

    def candidates(self, buckets: DataFrame) -> DataFrame:
        """``(a, b)``, a < b: all pairs of small buckets, pairs with the least document of large ones."""
        small = buckets.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
        small = small.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b")
        large = buckets.where(F.col("n") > SMALL).select("doc_id", F.explode(F.array("low", "hub")).alias("to")).where("doc_id <> to")
        large = large.select(F.least("doc_id", "to").alias("a"), F.greatest("doc_id", "to").alias("b"))
        return materialise(small.union(large).distinct())

    def _with(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for end in "ab":
            side = table.select(F.col("doc_id").alias(end), F.col(column).alias(f"{column}_{end}"))
            pairs = pairs.join(side, end)
        return pairs.select("a", "b", f"{column}_a", f"{column}_b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sequential and exact verification confirm."""
        near = self._with(pairs, self.reps, "sig").mapInArrow(_plausible(least_equal(self.percent)), "a long, b long")
        sure = self._with(near.distinct(), self.sets, "set").mapInArrow(_linked(self.percent), "a long, b long")
        return materialise(sure)

    def unconnected(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs whose ends the links do not connect."""
        of = materialise(connected_components(links))
        for end in "ab":
            side = of.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
            pairs = pairs.join(side, end, "left")
        return materialise(pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))

    def unresolved(self, buckets: DataFrame, links: DataFrame) -> DataFrame:
        """``(doc_id, component, cluster)`` of the documents in large buckets that hold several components.

        Buckets that share documents form a cluster, whichever bands they are of, so a document is looked at once and not in every band.
        """
        of = materialise(connected_components(links))
        large = buckets.where(F.col("n") > SMALL).select("key", "doc_id").join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        large = materialise(large.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
        parts = large.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.min("doc_id").alias("low"))
        open_ = materialise(large.join(parts.where("_a <> _b").select("key", "low"), "key").select("doc_id", "component", "low"))
        if open_.isEmpty():
            return open_.select("doc_id", "component", F.col("low").alias("cluster"))
        edges = open_.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
        cluster = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
        return materialise(open_.select("doc_id", "component").distinct().join(cluster, "doc_id"))

    def inside(self, left: DataFrame) -> DataFrame:
        """Links between the components of each cluster, in chunks of bounded size: each with itself, then each pair of them."""
        need = least_equal(self.percent)
        rows = left.join(self.reps.select("doc_id", "n", "sig"), "doc_id").join(self.sets, "doc_id")
        rows = materialise(rows.select("cluster", "doc_id", "component", "sig", "set", "n"))
        order = ["cluster", "n", "doc_id"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("cluster", "doc_id", "component", "sig", "set")
        chunks = materialise(rows.mapInArrow(_chunk_rows(need, self.percent), _CHUNKS))
        links = chunks.select(F.explode("links").alias("l")).select("l.a", "l.b")
        ends = chunks.select("cluster", "chunk", F.array_min("sizes").alias("low"), F.array_max("sizes").alias("high"))
        x, y = ends.alias("x"), ends.alias("y")
        near = (F.col("x.low") * self.percent <= F.col("y.high") * 100) & (F.col("y.low") * self.percent <= F.col("x.high") * 100)
        met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.chunk") < F.col("y.chunk")) & near)
        pairs = materialise(met.select("x.cluster", F.struct("x.chunk", F.col("y.chunk").alias("other")).alias("pair")))
        if pairs.isEmpty():
            return links
        both = pairs.select("cluster", "pair", F.explode(F.array("pair.chunk", "pair.other")).alias("chunk"))
        full = both.join(chunks.drop("links"), ["cluster", "chunk"])
        return links.union(materialise(full.groupBy("cluster", "pair").applyInArrow(_chunk_pair(need, self.percent), "a long, b long")))

    def all_links(self) -> DataFrame:
        """Links that connect every class with the classes it is linked to, directly or through others."""
        buckets = self.buckets()
        pairs = self.candidates(buckets)
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = self.links(first)
        more = self.unconnected(pairs.join(first, ["a", "b"], "left_anti"), links)
        if not more.isEmpty():
            links = links.union(self.links(more))
        left = self.unresolved(buckets, links)
        if not left.isEmpty():
            links = links.union(self.inside(left))
        return links.union(self.own)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (least id reachable), ``kept`` (it is that one)."""
    d = Duplicates(docs, id_col, text_col, percent)
    of = materialise(connected_components(d.all_links()))
    rep = d.member.join(of, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    rep = rep.distinct()
    out = d.rows.select("doc_id", F.col("n").alias("n_shingles")).join(rep, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
