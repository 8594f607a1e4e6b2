"""Benchmark decontamination: a distributed positional inverted index of the training text.

:func:`build_index` turns documents into *segments*.  A segment is the complete positional inverted
index of a run of documents of about 1.5 MB: its distinct terms, for each term the positions at which
it occurs, and the documents' place in the numbering of positions.  Between two documents one position
stays free, so that no phrase reaches from one into the next.  Segments are rows of a Parquet table in
the shared folder; they need no shuffle, a task holds one segment at a time, and a lost task repeats only
its own run of documents.

:func:`search` looks phrases up in every segment.  A phrase whose terms do not all occur is out at once.
For the others the lists are intersected after subtracting each term's offset in the phrase, from the
rarest term of the segment on; the intersection is usually empty after two lists.  With ``slop`` the
terms may lie further apart, in the same order (proximity).

The phrases are the stated query set.  They are cut into blocks of at most ``BLOCK`` phrases; a block,
at most 8 * WINDOW * BLOCK bytes, is the only thing ever sent to all tasks, and the index is searched once per block.

Defined results: a null or empty text has no words; a null text among the phrases gives none; repeated
rows give one row each; repeated phrases and item ids count once; an empty table gives no rows; other
columns of the inputs are ignored.  Words are compared by 64-bit hashes (see :mod:`barloom.llm.words`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.session import materialise

#: Words in a phrase taken from an item; an item of fewer words is one phrase.
WINDOW = 10
#: Phrases in a block.
BLOCK = 50_000
#: Spark reads the lists of a whole row group at once, and Parquet's writer looks at its size after 100 rows first, then as often as
#: the rows so far suggest; segments are a megabyte or a few bytes.  So it looks after every row.
ROW_GROUPS = {"parquet.block.size": 2_000_000, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

INDEX = (
    "segment long, doc_ids array<long>, first array<int>, n_words array<int>, "
    "terms array<long>, counts array<int>, gaps array<int>"
)
FOUND = "segment long, ordinal int, doc_id long, n_words int, spans array<struct<start:int,end:int>>, items array<long>, near array<long>"


def _list(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _segment(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    h, owner = words.hashed(texts, words.ALNUM)
    place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), np.diff(owner))
    order = np.argsort(h, kind="stable")
    terms, begin = np.unique(h[order], return_index=True)
    gaps = np.diff(place[order], prepend=0)
    gaps[begin] = place[order][begin]
    columns = {
        "segment": pa.array([number], pa.int64()),
        "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "first": _list(owner[:-1] + np.arange(len(texts)), pa.int32()),
        "n_words": _list(np.diff(owner), pa.int32()),
        "terms": _list(terms.view(np.int64), pa.int64()),
        "counts": _list(np.diff(begin, append=len(h)), pa.int32()),
        "gaps": _list(gaps, pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
        for i, j in words.runs(texts):
            yield _segment(number, ids.slice(i, j - i), texts.slice(i, j - i))
            number += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of every token of ``docs``, written to the shared folder, one segment per row."""
    words.batches(docs.sparkSession)
    return materialise(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_segments, INDEX), **ROW_GROUPS)


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """``(item_id, terms)`` of every run of ``n`` words of the items, each once."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in words.runs(texts):
                h, owner = words.hashed(texts.slice(i, j - i), words.ALNUM)
                item, rows = [], []
                for k, (a, b) in enumerate(zip(owner[:-1], owner[1:], strict=True)):
                    size = min(n, b - a)
                    for s in range(a, b - size + 1) if size else ():
                        item.append(ids[i + k].as_py())
                        rows.append(h[s : s + size].view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {"item_id": pa.array(item, pa.int64()), "terms": pa.array(rows, pa.list_(pa.int64()))}
                )

    return items.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, "item_id long, terms array<long>").distinct()


class Block:
    """At most BLOCK distinct phrases, padded to one length, and the items each stands in."""

    def __init__(self, rows: list[tuple[tuple[int, ...], list[int]]]):
        self.size = np.array([len(t) for t, _ in rows], np.int64)
        width = int(self.size.max(initial=1))
        self.terms = np.zeros((len(rows), width), np.uint64)
        for row, (t, _) in zip(self.terms, rows, strict=True):
            row[: len(t)] = np.array(t, np.int64).view(np.uint64)
        self.used = np.arange(width) < self.size[:, None]
        self.items = [np.array(x, np.int64) for _, x in rows]

    def look_up(self, terms: np.ndarray) -> np.ndarray:
        """Index of every term of every phrase in ``terms``; rows of phrases with an absent term are left out by the mask."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        return at, ((terms[at] == self.terms) | ~self.used).all(axis=1) if len(terms) else np.zeros(len(self.size), bool)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return values[of[at] == values]


def _exact(lists: list[np.ndarray]) -> np.ndarray:
    """Positions at which the phrase begins."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    begin = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(begin):
            break
        begin = _member(begin + k, lists[k]) - k
    return begin


def _near(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the terms in order, at most ``slop`` further apart than in the phrase."""
    k = min(range(len(lists)), key=lambda k: len(lists[k]))
    if len(lists[k]) < len(lists[0]):  # only beginnings that a rarest term can belong to
        low = np.searchsorted(lists[k], lists[0] + k)
        high = np.searchsorted(lists[k], lists[0] + k + slop, "right")
        begin = lists[0][high > low]
    else:
        begin = lists[0]
    end = begin
    for of in lists[1:]:
        at = np.searchsorted(of, end, "right")
        keep = at < len(of)
        begin, end = begin[keep], of[at[keep]]
        near = end - begin < len(lists) + slop
        begin, end = begin[near], end[near]
        if not len(begin):
            break
    return begin, end


def _search_segment(row: dict, block: Block, slop: int) -> pa.RecordBatch:
    n_docs = len(row["doc_ids"])
    first, n_words = row["first"].to_numpy(), row["n_words"].to_numpy()
    terms, counts = row["terms"].to_numpy().view(np.uint64), row["counts"].to_numpy()
    places = np.cumsum(row["gaps"].to_numpy(), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    # gaps of a term add up from its own first position on
    if len(terms):
        places -= np.repeat(np.concatenate([[0], places[begin[1:-1] - 1]]), counts)
    total = int(first[-1] + n_words[-1]) + 1 if n_docs else 1
    cover = np.zeros(total + 1, np.int32)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    close: list[tuple[np.ndarray, np.ndarray]] = []
    at, alive = block.look_up(terms)
    for w in np.flatnonzero(alive):
        lists = [places[begin[t] : begin[t + 1]] for t in at[w, : block.size[w]]]
        starts = _exact(lists)
        if len(starts):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + len(lists), -1)
            docs = np.unique(np.searchsorted(first, starts, "right") - 1)
            pairs.append((np.repeat(docs, len(block.items[w])), np.tile(block.items[w], len(docs))))
        if slop:
            a, b = _near(lists, slop)
            if len(a):
                of = np.searchsorted(first, a, "right") - 1
                docs = np.unique(of[b < first[of] + n_words[of]])
                close.append((np.repeat(docs, len(block.items[w])), np.tile(block.items[w], len(docs))))
    hit = (np.cumsum(cover) > 0).astype(np.int8)
    step = np.diff(hit, prepend=0, append=0)
    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    of = np.searchsorted(first, s, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(s - first[of], pa.int32()), pa.array(e - first[of], pa.int32())], ["start", "end"]
    )
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array(np.full(n_docs, row["segment"]), pa.int64()),
            "ordinal": pa.array(np.arange(n_docs), pa.int32()),
            "doc_id": row["doc_ids"],
            "n_words": pa.array(n_words, pa.int32()),
            "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n_docs + 1)), pa.int32()), spans),
            "items": _per_doc(pairs, n_docs),
            "near": _per_doc(close, n_docs),
        }
    )


def _per_doc(pairs: list[tuple[np.ndarray, np.ndarray]], n_docs: int) -> pa.ListArray:
    found = np.unique(np.array([np.concatenate(x) for x in zip(*pairs, strict=True)]).T, axis=0) if pairs else np.zeros((0, 2), np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(found[:, 0], np.arange(n_docs + 1)), pa.int32()), pa.array(found[:, 1], pa.int64())
    )


def search(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """For every indexed row: ``doc_id, n_words``, the word ``spans`` (end exclusive, merged) that lie in an
    exact occurrence of a phrase, the ``items`` with an exact and those with a ``near`` occurrence.

    ``wanted`` has ``(item_id, terms)`` as made by :func:`phrases`.
    """
    spark = index.sparkSession
    grouped = wanted.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    table = materialise(grouped.withColumn("key", F.xxhash64("terms")))
    blocks = -(-table.count() // BLOCK)
    found = []
    for b in range(max(1, blocks)):
        part = table.where(F.pmod("key", F.lit(max(1, blocks))) == b).select("terms", "items")
        block = spark.sparkContext.broadcast(Block([(tuple(r[0]), r[1]) for r in part.toLocalIterator()]))

        def run(batches, block=block):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].values for n in batch.schema.names if n != "segment"}
                    yield _search_segment(row | {"segment": batch.column("segment")[i].as_py()}, block.value, slop)

        found.append(index.mapInArrow(run, FOUND))
    if len(found) == 1:
        return found[0].drop("segment", "ordinal")
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    merged = together.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )
    return merged.withColumn("spans", F.expr(MERGED)).drop("segment", "ordinal")


#: Overlapping and touching spans, sorted by start, as one each.
MERGED = """
aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (done, s) ->
  case when size(done) > 0 and element_at(done, -1).end >= s.start
    then concat(slice(done, 1, size(done) - 1),
                array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
    else concat(done, array(s)) end)
"""


def decontaminate(docs: DataFrame, benchmark: DataFrame, slop: int = 0, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items, near, n_hit, contaminated``."""
    found = search(build_index(docs, id_col), phrases(benchmark), slop)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
