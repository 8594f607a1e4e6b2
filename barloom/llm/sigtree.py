"""N-gram Jaccard join by signature trees.

A document's set is its distinct 4-word shingles; two documents link when their sets' Jaccard similarity reaches the limit.
Documents with equal sets form a class and go on as its least id.

1. *Routing* (exact).  Sizes fall into classes, and within a size class the token space is cut into slices by a hash.  Linked sets
   differ in at most ``D = (1 - t) / (1 + t) * (|x| + |y|)`` tokens, so with more than ``D`` slices some slice is equal in both.
   A document's keys are the hashes of its slices.  Slices of few tokens (which unrelated texts may share) are left out as long as
   the others outnumber ``D``: then an equal one is always among them.  A document with sizes on both sides of a class border
   within reach has keys in both classes.  Documents that share keys, directly or through others, form a candidate cluster.
2. *Signature trees*.  Clustered documents are sorted by (cluster, size) over the whole cluster and cut into chunks of bounded
   size.  Each chunk gets a tree: a node holds the OR of its documents' token bitmaps, their size range and the most tokens that
   any of them hides behind a shared bit.  Two nodes can hold a link only if their size ranges meet and
   ``popcount(a AND b) + hidden`` reaches the least overlap a link needs; dual traversal drops the others, level by level.
3. *Verification*.  Pairs of leaves that stay and are not yet connected are confirmed on their full sets.
4. A cluster of several chunks has its chunks' trees joined in pairs, one pair to a task, after the same test of their roots.

No link is lost at any step.  Nothing yields pairs but confirmed links, at most a spanning forest for a pair of chunks.

Scale: keys are about 0.27 a token, 8 bytes each; a key of very many documents is counted with map-side combine, then met by
a join that adaptive execution splits.  The only broadcast is a filter of at most 8 MB of bits (``neardup.Marks``).  A task holds two chunks.
Work that grows faster than the input: a cluster of ``c`` chunks (256 documents each) meets in ``c * (c + 1) / 2`` pairs of trees.

Defined results: null or empty texts and texts without words have no set (``n_shingles`` 0) and no links; fewer words than
four are one shingle; rows that share an id count as one document with several texts; a null id is never linked and is its
own group (``component_id`` null); an empty table gives no rows; other columns are ignored.  Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.llm.neardup import Marks
from barloom.operators.components import connected_components
from barloom.session import discard, materialise

SHINGLE = 4
#: Similarity limit in percent.
PERCENT = 85
#: Ratio of the sizes that bound a size class, and its tokens to a slice.
RATIO, SLICE = 1.5, 4
#: Slices of fewer tokens are left out where the others suffice.
FULL = 3
#: Documents and shingles of a chunk; one document may be larger.
CHUNK, CHUNK_SHINGLES = 256, 100_000
#: The largest set of a chunk has at most this many times the tokens of its least one, so that one width of bitmap suits all.
MIXED = 8
#: Children of a tree node.
FANOUT = 8
#: Bits of a bitmap for each token of the largest set, and the most bits.
SPREAD, MOST_BITS = 16, 1 << 20


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, owner = words.hashed(texts, words.SPACED)
    wide = words.windows(h, n) if len(h) >= n else None
    for a, b in zip(owner[:-1], owner[1:], strict=True):
        yield np.unique(wide[a : b - n + 1] if b - a >= n else words.windows(h[a:b], n))


def _borders() -> np.ndarray:
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, int(np.ceil(at[-1] * RATIO))))
    return np.array(at)


_BORDERS = _borders()


def most_different(x: int, y: int, percent: int) -> int:
    """The most tokens in which linked sets of ``x`` and ``y`` tokens can differ."""
    return (100 - percent) * (x + y) // (100 + percent)


def slice_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: any set linked to it has at least one of them.

    Scheme ``j`` serves pairs whose smaller set lies in size class ``j``: sets of that class, and larger ones within reach of it.
    """
    n = len(tokens)
    own = int(np.searchsorted(_BORDERS, n, "right")) - 1
    first = int(np.searchsorted(_BORDERS, -(-percent * n // 100), "right")) - 1
    out = []
    for j in range(first, own + 1):
        top = int(_BORDERS[j + 1]) - 1
        reach = 100 * top // percent
        apart = most_different(min(n, reach), min(100 * n // percent, reach) if j == own else top, percent)
        slices = max(most_different(top, reach, percent) + 1, top // SLICE)
        at = ((words.mix(tokens + np.uint64(7919 * (j + 1))) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
        size = np.bincount(at, minlength=slices)
        least = FULL
        while least and (size >= least).sum() <= apart:
            least -= 1
        key = words.mix(np.arange(slices, dtype=np.uint64) + np.uint64((j + 1) << 40))
        np.add.at(key, at, words.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
        out.append(words.mix(key[size >= least]))
    return np.concatenate(out).view(np.int64)


def _sketch(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.runs(batch.column(1)):
                size, fa, fb, keys = [], [], [], []
                for s in _sets(batch.column(1).slice(i, j - i), shingle):
                    size.append(len(s))
                    fa.append(int(words.mix(s).sum(dtype=np.uint64).view(np.int64)))
                    fb.append(int(np.bitwise_xor.reduce(words.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
                    # a set that can differ from another in no token is linked to equal sets only
                    lone = most_different(len(s), 100 * len(s) // percent, percent) < 1
                    keys.append(None if lone else slice_keys(s, percent))
                columns = [
                    batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "fa", "fb", "keys"])

    return run


def _shared_keys(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten()
            owner = batch.column(0).take(lists.value_parent_indices())
            yes = marks.value(keys)
            yield pa.RecordBatch.from_arrays([owner.filter(yes), keys.filter(yes)], ["rep", "key"])

    return run


def _wanted(marks, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(marks.value(batch.column(0)))
            for i, j in words.runs(some.column(1)):
                sets = [s.view(np.int64) for s in _sets(some.column(1).slice(i, j - i), shingle)]
                columns = [some.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens"])

    return run


class Tree:
    """Signature tree over a list of sets: ``levels[0]`` holds the documents, the last level one root.

    Each level has ``bits`` (a bitmap a node), ``low`` and ``high`` (size range) and ``hidden``: the most tokens that one
    document of the node has beyond the bits of its own bitmap.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        size = np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            at = s & np.uint64(bits - 1)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at))
            )


def _possible(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the node pairs ``(i, j)`` of two levels can hold a link."""
    low, high = np.maximum(a[1][i], b[1][j]), np.minimum(a[2][i], b[2][j])
    out = 100 * high >= percent * low
    alive = np.flatnonzero(out)
    step = max(1, (1 << 22) // max(1, a[0].shape[1]))
    for k in range(0, len(alive), step):
        at = alive[k : k + step]
        x, y = i[at], j[at]
        common = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
        out[at] = (100 + percent) * common >= percent * (a[1][x] + b[1][y])
    return out


def joined(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of positions that connect all that is linked, between two lists or (``sets_b`` None) within one."""
    same = sets_b is None
    most = max(len(s) for s in sets_a + (sets_b or []))
    bits = min(MOST_BITS, max(64, 1 << int(SPREAD * most - 1).bit_length()))
    ta = Tree(sets_a, bits)
    tb = ta if same else Tree(sets_b, bits)
    depth = max(len(ta.levels), len(tb.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for level in range(depth, -1, -1):
        a, b = (t.levels[min(level, len(t.levels) - 1)] for t in (ta, tb))
        if level < depth:
            i, j = _children(i, level, ta), _children(j, level, tb)
            i, j = _product(i, j)
        if same:
            i, j = i[i <= j], j[i <= j]
        ok = _possible(a, b, i, j, percent)
        i, j = i[ok], j[ok]
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    maps_a, maps_b = ta.levels[0][0], tb.levels[0][0]
    step = max(1, (1 << 22) // maps_a.shape[1])
    common = np.concatenate([np.bitwise_count(maps_a[i[k : k + step]] & maps_b[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)])
    other = sets_a if same else sets_b
    parent = list(range(len(sets_a) + (0 if same else len(sets_b))))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for k in np.argsort(-common, kind="stable").tolist():
        x, y = int(i[k]), int(j[k])
        rx, ry = root(x), root(y if same else y + len(sets_a))
        if rx == ry:
            continue
        total = len(sets_a[x]) + len(other[y])
        both = len(np.intersect1d(sets_a[x], other[y], assume_unique=True))
        if 100 * both >= percent * (total - both):
            parent[max(rx, ry)] = min(rx, ry)
            found.append((x, y))
    return found


def _children(node: np.ndarray, level: int, tree: Tree) -> list[np.ndarray]:
    """Nodes of ``level`` below each node one level higher; a shorter tree's root stands for itself until its level is reached."""
    if level >= len(tree.levels) - 1:
        return [np.zeros(1, np.int64)] * len(node)
    n = len(tree.levels[level][1])
    return [np.arange(FANOUT * x, min(n, FANOUT * x + FANOUT)) for x in node.tolist()]


def _product(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.concatenate([np.repeat(x, len(y)) for x, y in zip(left, right, strict=True)])
    return i, np.concatenate([np.tile(y, len(x)) for x, y in zip(left, right, strict=True)])


_CHUNK_FIELDS = pa.schema(
    [
        ("cluster", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
        ("tokens", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
    ]
)
_CHUNKS = "cluster long, chunk long, ids array<long>, sizes array<int>, tokens binary, links array<struct<a: long, b: long>>"


def _chunk_rows(percent: int):
    """Cut sorted rows ``(cluster, doc_id, tokens)`` into chunks, join each with itself and hand on its ends.

    One row for the first cluster of a chunk (with the chunk's links) and one for the last: only these can go on in other chunks.
    """

    def close(rows: list[tuple[int, int, np.ndarray]], chunk: int) -> Iterator[dict]:
        links = [{"a": rows[x][1], "b": rows[y][1]} for x, y in joined([r[2] for r in rows], None, percent)]
        for k, cluster in enumerate(dict.fromkeys((rows[0][0], rows[-1][0]))):
            mine = [r for r in rows if r[0] == cluster]
            yield {
                "cluster": cluster, "chunk": chunk, "ids": [r[1] for r in mine], "sizes": [len(r[2]) for r in mine],
                "tokens": b"".join(r[2].tobytes() for r in mine), "links": [] if k else links,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, held = TaskContext.get().partitionId() << 32, [], 0
        low, high = 1 << 62, 0
        for batch in batches:
            for cluster, doc_id, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = tokens.values.to_numpy().view(np.uint64)
                low, high = min(low, len(s)), max(high, len(s))
                if rows and (len(rows) == CHUNK or held + len(s) > CHUNK_SHINGLES or high > MIXED * low):
                    yield pa.RecordBatch.from_pylist(list(close(rows, chunk)), _CHUNK_FIELDS)
                    chunk, rows, held, low, high = chunk + 1, [], 0, len(s), len(s)
                rows.append((cluster, doc_id, s.copy()))
                held += len(s)
        if rows:
            yield pa.RecordBatch.from_pylist(list(close(rows, chunk)), _CHUNK_FIELDS)

    return run


def _chunk_pair(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sides = []
        for row in table.select(["ids", "sizes", "tokens"]).to_pylist():
            sides.append((row["ids"], np.split(np.frombuffer(row["tokens"], np.uint64), np.cumsum(row["sizes"])[:-1])))
        (ids, sets), (ids2, sets2) = sides
        found = joined(sets, sets2, percent)
        return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids2[y] for _, y in found], pa.int64())})

    return run


def _clusters(classes: DataFrame) -> DataFrame:
    """``(doc_id, cluster)`` of the classes that share a key with others; the cluster is its least id."""
    rows = classes.where("keys is not null").select("rep", F.explode("keys").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1").select("key", "low"))
    marks = classes.sparkSession.sparkContext.broadcast(Marks(shared.select(F.col("key").alias("doc_id"))))
    some = classes.where("keys is not null").select("rep", "keys").mapInArrow(_shared_keys(marks), "rep long, key long")
    edges = some.join(shared, "key").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    return materialise(connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))


def _links(docs: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that connect every clustered document with all that it is linked to, directly or through others."""
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(Marks(clusters.select("doc_id")))
    sets = materialise(docs.mapInArrow(_wanted(marks, shingle), "doc_id long, tokens array<long>").join(clusters, "doc_id"))
    ordered = sets.select("cluster", "doc_id", "tokens", F.size("tokens").alias("n")).repartitionByRange("cluster", "n", "doc_id")
    ordered = ordered.sortWithinPartitions("cluster", "n", "doc_id").select("cluster", "doc_id", "tokens")
    chunks = materialise(ordered.mapInArrow(_chunk_rows(percent), _CHUNKS))
    links = chunks.select(F.explode("links").alias("l")).select("l.a", "l.b")
    ends = chunks.select("cluster", "chunk", F.array_min("sizes").alias("low"), F.array_max("sizes").alias("high"))
    x, y = ends.alias("x"), ends.alias("y")
    # the size ranges of the roots; their bitmaps are met in the task, where the trees are
    near = (F.col("x.low") * percent <= F.col("y.high") * 100) & (F.col("y.low") * percent <= F.col("x.high") * 100)
    met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.chunk") < F.col("y.chunk")) & near)
    pairs = materialise(met.select("x.cluster", F.struct("x.chunk", F.col("y.chunk").alias("other")).alias("pair")))
    if pairs.isEmpty():
        return links
    both = pairs.select("cluster", "pair", F.explode(F.array("pair.chunk", "pair.other")).alias("chunk"))
    full = both.join(chunks.select("cluster", "chunk", "ids", "sizes", "tokens"), ["cluster", "chunk"])
    return links.union(full.groupBy("cluster", "pair").applyInArrow(_chunk_pair(percent), "a long, b long"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (least id reachable by links, its own included)."""
    words.batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialise(docs.mapInArrow(_sketch(shingle, percent), "doc_id long, n long, fa long, fb long, keys array<long>"))
    rows = materialise(sketch.select("doc_id", "n", "fa", "fb"))
    full = sketch.where("n > 0 and doc_id is not null")
    # equal sets have equal keys
    classes = materialise(full.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    discard(sketch)
    named = rows.where("n > 0 and doc_id is not null").select("doc_id", "fa", "fb")
    member = materialise(named.join(classes.select("fa", "fb", "rep"), ["fa", "fb"]).select("doc_id", "rep"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    own = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    links = _links(docs, _clusters(classes), shingle, percent)
    of = materialise(connected_components(links.union(own)))
    discard(classes)
    found = member.join(of, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component")).distinct()
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
