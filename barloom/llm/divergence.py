"""Source divergence audit by in-mapper stripes.

How far do the sources of a language differ in their use of words, and by which words?  Every (lang, source) group gives each
term that the language keeps the share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; a group's divergence from another is
the sum over all kept terms of ``f = floor((p - q)**2 / q)``.

1. *In-mapper stripes*.  A task folds its whole documents, of all languages and sources, into stripes
   ``(lang, term) -> [(source, documents, occurrences)]``, held in one hash table for the task.  When that holds ``HELD`` entries
   it is spilled: its stripes are emitted and it starts empty.
2. *Merge by key*.  Stripes of a term are sorted together and merged in one pass over each partition.  A partial stripe has at
   most one entry for each source, so the most frequent term has as many rows as there were spills.
   Terms in too few documents of their language go; the rest is written, one stripe a term.
3. *Divergences from stripes*.  A stripe names only groups with the term.  With ``f00`` the value of a pair when neither has a
   term, the sum over all ``V`` terms is

       ``V * f00 + sum over g's terms (f(p, q0) - f00) + sum over o's terms (f(p0, q) - f00) + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f00)``

   The two middle sums need only how many terms have which count in a group; the last one comes from the stripes, pair by pair
   of their entries, added up in the task before anything moves.

All values are integers, exact while a group has fewer than ``2**63 / 1000`` occurrences.

Scale: shuffled are stripes, about one entry for each (task, source, term).  The tables of groups and of term counts are joined as
tables, nothing is broadcast by hand.  Work and rows beyond the stripes grow with the pairs of sources, as the result does.

Defined results: null text, lang and source read as ''; a group without terms counts like any other (each kept term has 0
occurrences there); a language that keeps no term gives pairs of value 0 and no term rows; a language with one source gives no
pairs; rows that share an id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.session import materialise

#: Fixed by the definition of a share.
SCALE = 1_000_000_000
#: Documents of its language that a kept term is in, and ranks of terms that are returned.
LEAST_DOCS, RANKS = 3, 200
#: Entries (source, term) that a task holds before it spills, and new ones after which it adds them up.
HELD, FRESH = 400_000, 400_000
#: Pairs of stripe entries worked on at once, and sums of group pairs held before they are handed on.
PAIRS, SUMS = 1_000_000, 1_000_000

#: Bytes of a term: letters, and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_ENTRY = pa.struct([("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("stripe", pa.list_(_ENTRY))])
_STRIPE_DDL = "lang string, term string, stripe array<struct<source: string, docs: bigint, n: bigint>>"


def term_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, lower-cased (A-Z only), and the position of each one's text."""
    data, at = words.text_bytes(texts)
    data = words.LOWER[data]
    starts, ends, first = words.find(data, at, LETTERS)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = data[LETTERS[data]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))
    return terms, np.repeat(np.arange(len(texts)), np.diff(first))


def _entries(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """``(lang, source, term, docs, n)`` of runs of documents, added up over each run."""
    for i, j in words.runs(batch.column(0)):
        part = batch.slice(i, j - i)
        terms, owner = term_array(part.column(0))
        coded = terms.dictionary_encode()
        size = max(1, len(coded.dictionary))
        keys, n = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
        doc, code = keys // size, keys % size
        at = pa.array(doc)
        yield pa.table(
            {
                "lang": part.column(1).take(at), "source": part.column(2).take(at),
                "term": coded.dictionary.cast(pa.string()).take(pa.array(code)),
                "docs": np.ones(len(doc), np.int64), "n": n.astype(np.int64),
            }
        ).group_by(["lang", "source", "term"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")]).rename_columns(
            {"docs_sum": "docs", "n_sum": "n"}
        )


def _stripes(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Entries that are added up, as stripes."""
    if not table.num_rows:
        return
    # which order the terms come in does not matter, so their codes are sorted and not their letters
    lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
    code = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order)).astype(np.int32)
    table = table.take(pa.array(order)).combine_chunks()
    entry = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("source", "docs", "n")], fields=list(_ENTRY))
    for k in range(0, len(ends), 10_000):
        part = ends[k : k + 10_000]
        offsets = np.concatenate([[ends[k - 1] if k else 0], part]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), entry)
        at = pa.array(part - 1)
        yield pa.RecordBatch.from_arrays([table.column("lang").combine_chunks().take(at), table.column("term").combine_chunks().take(at), lists], schema=_STRIPE)


def _folded(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return whole.rename_columns({"docs_sum": "docs", "n_sum": "n"})


def _in_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, fresh, rows = [], [], 0
    for batch in batches:
        for part in _entries(batch):
            fresh.append(part)
            rows += part.num_rows
            if rows >= FRESH:
                held, fresh, rows = [_folded(held + fresh)], [], 0
                if held[0].num_rows >= HELD:
                    yield from _stripes(held[0])
                    held = []
    if held or fresh:
        yield from _stripes(_folded(held + fresh))


def _merge(least: int):
    """Merge sorted partial stripes; a term's rows may go on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
            lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
            same = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy(zero_copy_only=False)
            last = len(same) - int(same[::-1].argmin() if not same.all() else len(same))
            done, kept = rows.slice(0, last), rows.slice(last)
            if kept.num_rows > 1:  # what is left over is one row
                kept = pa.Table.from_batches(list(_merged(kept, 0)), _STRIPE)
            yield from _merged(done, least)
        if kept is not None:
            yield from _merged(kept, least)

    return run


def _merged(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    lists = rows.column("stripe").combine_chunks()
    entry, owner = lists.flatten(), lists.value_parent_indices()
    flat = pa.table(
        {"lang": rows.column("lang").take(owner), "term": rows.column("term").take(owner)} | {c: pc.struct_field(entry, c) for c in ("source", "docs", "n")}
    )
    for batch in _stripes(_folded([flat.select(["lang", "source", "term", "docs", "n"])])):
        lists = batch.column(2)
        docs = np.add.reduceat(pc.struct_field(lists.flatten(), "docs").to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())
        yield batch.filter(pa.array(docs >= least))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """``1 + floor(SCALE * n / total)`` for ``n <= total``, by long division in three steps of 1,000."""
    whole, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        step = _div(rest * 1_000, total)
        whole, rest = whole * 1_000 + step, rest * 1_000 - step * total
    return whole + 1


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _both(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over common terms of each pair of groups, from entries ``(tid, gid, p, p0)`` sorted by ``tid``."""
    names, kept, sums = ("tid", "gid", "p", "p0"), [np.zeros(0, np.int64)] * 4, {}

    def add(tid: np.ndarray, gid: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]])) if len(tid) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([starts, [len(tid)]]))
        first, wide = np.repeat(starts, size), np.repeat(size, size)
        upto, a = np.cumsum(wide), 0
        while a < len(tid):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(a, b), wide[a:b])
            y = np.arange(len(x)) - np.repeat(upto[a:b] - wide[a:b] - (upto[a - 1] if a else 0), wide[a:b]) + np.repeat(first[a:b], wide[a:b])
            x, y = x[x != y], y[x != y]
            value = _both(p[x], p[y]) - _both(p[x], p0[y]) - _both(p0[x], p[y]) + _both(p0[x], p0[y])
            ids, code = np.unique(gid, return_inverse=True)
            pair, at = np.unique(code[x] * len(ids) + code[y], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, value)
            for g, o, v in zip(ids[pair // len(ids)].tolist(), ids[pair % len(ids)].tolist(), total.tolist(), strict=True):
                sums[g, o] = sums.get((g, o), 0) + v
            a = b

    def out() -> pa.RecordBatch:
        g, o = zip(*sums, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(o, pa.int64()), pa.array(list(sums.values()), pa.int64())], ["g", "o", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, names, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        add(*[r[:last] for r in rows])
        kept = [r[last:] for r in rows]
        if len(sums) > SUMS:
            yield out()
            sums.clear()
    add(*kept)
    if sums:
        yield out()


def stripes(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term, stripe)`` of the terms in at least ``least`` documents of their language, from ``(text, lang, source)``."""
    words.batches(docs.sparkSession)
    partial = docs.select("text", "lang", "source").mapInArrow(_in_mapper, _STRIPE_DDL)
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least), _STRIPE_DDL)


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, ranks: int = RANKS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of the language by divergence, part
    ``term`` the terms that a source uses more than its language does."""
    known = {"text": text_col, "lang": lang_col, "source": source_col}
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in known.items()])
    kept = materialise(stripes(docs, least).withColumn("tid", F.monotonically_increasing_id()))
    entries = kept.select("tid", "lang", F.explode("stripe").alias("e")).select("tid", "lang", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    groups = groups.withColumn("all", F.coalesce("total", F.lit(0).cast("long")) + F.col("v"))
    one = F.lit(1).cast("long")
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(one, F.when(F.col("v") > 0, F.col("all")))))
    groups = materialise(groups.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "total", "v", "all", "p0"))
    shares = entries.join(groups, ["lang", "source"]).select("tid", "lang", "source", "gid", "p0", share(F.col("n") + 1, F.col("all")).alias("p"))
    return _pairs(groups, shares).unionByName(_terms(kept, groups, ranks))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    common = shares.select("tid", "gid", "p", "p0").repartition("tid").sortWithinPartitions("tid").mapInArrow(_common, "g long, o long, v long")
    often = shares.groupBy("lang", "gid", "p0", "p").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    met = often.join(other, "lang").where("gid <> other")
    p, p0, q0, m = (F.col(c) for c in ("p", "p0", "q0", "m"))
    here = F.struct(F.col("gid").alias("g"), F.col("other").alias("o"), (m * (distance(p, q0) - distance(p0, q0))).alias("v"))
    there = F.struct(F.col("other").alias("g"), F.col("gid").alias("o"), (m * (distance(q0, p) - distance(q0, p0))).alias("v"))
    single = met.select(F.explode(F.array(here, there)).alias("x")).select("x.*")
    sums = common.unionByName(single).groupBy("g", "o").agg(F.sum("v").alias("s"))
    o = groups.select("lang", F.col("gid").alias("o"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select(F.col("gid").alias("g"), "lang", "source", "v", "p0").join(o, "lang").where("g <> o").join(sums, ["g", "o"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * distance(F.col("p0"), F.col("q0")) + F.coalesce("s", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    whole = groups.groupBy("lang").agg((F.coalesce(F.sum("total"), F.lit(0).cast("long")) + F.max("v")).alias("whole"))
    count = F.aggregate("stripe", F.lit(0).cast("long"), lambda n, e: n + e["n"])
    rows = kept.join(whole, "lang").select("lang", "term", share(count + 1, F.col("whole")).alias("q"), F.explode("stripe").alias("e"))
    rows = rows.select("lang", F.col("e.source").alias("source"), "term", "q", F.col("e.n").alias("n"))
    rows = rows.join(groups.select("lang", "source", "all"), ["lang", "source"]).withColumn("p", share(F.col("n") + 1, F.col("all"))).where("p > q")
    found = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(found).where(F.col("rank") <= ranks)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))
