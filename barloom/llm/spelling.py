"""Spelling variants by k-d trees over letter-count vectors.

Two words are near if they differ by exactly one inserted, deleted or replaced letter.  One edit changes the vector of letter
counts by at most one letter more and one letter less: an L1 distance of at most two.

1. *Words*: maximal runs of letters of the whole texts; a rule that hangs on document and run leaves one letter out of a few of them.
   A task adds up its words in one table and spills it when it holds ``HELD`` words.
2. *Routing*: the upper part of a k-d tree for each length, fitted on a bounded sample of words, cuts the vectors into cells.
   Every word lives in one cell and visits the cells of its own length and of the next one whose box lies within one edit.
   The fit decides how evenly cells are filled, never which pairs are found.
3. *Range search*: each cell's words form a k-d tree; visiting words descend it together and a box is left as soon as it is more
   than one letter up and one letter down away.  What stays is compared by vectors, then by the order of letters.
4. *Forms*: each word keeps the number of its near words and the most frequent one; roots are found by pointer doubling (a form
   occurs at least twice as often, so a chain is short).

Scale: no pair of words is shuffled but as part of a word's best one.  A cell of more words than ``2 * CELL``, or with more than
``VISITS`` visitors, is dealt to several tasks (homes by parts, visitors by parts), so a task's memory has a bound.

Defined results: null and empty texts have no words; a row with a null id has its runs unchanged; rows that share an id count
each; words shorter than ``LEAST_LENGTH`` or rarer than ``LEAST_COUNT`` are left out; a word without near words has ``n_near`` 0, no form and
itself as root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.session import discard, materialise

#: Fixed by the definition of a word.
LEAST_LENGTH, LEAST_COUNT, DROP = 5, 3, 97
#: Words that a task holds before it spills, and new ones after which it adds them up.
HELD, FRESH = 300_000, 300_000
#: Words that the routing trees are fitted on, at most.
SAMPLE = 50_000
#: Words of a cell as planned, visitors of one task, words of a leaf.
CELL, VISITS, LEAF = 16_384, 400_000, 128
#: Dimensions of a vector: a to z, and six that the other letters share (which can only bring words closer).
DIMS = 32

_FIRST_BYTE = 0xC3  # of the UTF-8 form of U+00C0 to U+00FF
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), _FIRST_BYTE]] = True
_DIM = 26 + np.arange(256) % (DIMS - 26)
_DIM[0x61:0x7B] = np.arange(26)


def _crc_table() -> np.ndarray:
    """What a byte adds to the register of the reflected CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` appended to what gave ``seed``, all words at once, byte by byte."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, upto, register = starts[order], -size[order], seed[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(size.max()) if len(size) else 0):
        n = int(np.searchsorted(upto, -k, "left"))
        part = register[:n]
        register[:n] = _CRC[(part ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def word_array(ids: list, texts: pa.Array) -> pa.Array:
    """Words of at least ``LEAST_LENGTH`` letters, one entry for each occurrence."""
    data, at = words.text_bytes(texts)
    data = words.LOWER[data]
    marked = data.copy()
    marked[1:][data[:-1] == _FIRST_BYTE] = 0x61
    starts, ends, first = words.find(marked, at, _LETTERS)
    lead = np.concatenate([[0], np.cumsum(data == _FIRST_BYTE)])
    length = ends - starts - (lead[ends] - lead[starts])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    seed = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = _crc32(data, starts, ends, seed[owner])
    named = np.array([i is not None for i in ids], bool)
    changed = (crc % np.uint32(DROP) == 0) & named[owner]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = data[_LETTERS[marked]]
    whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))
    plain = whole.filter(pa.array(~changed & (length >= LEAST_LENGTH)))
    some = changed & (length > LEAST_LENGTH)
    cut = []
    for word, k in zip(whole.filter(pa.array(some)).to_pylist(), (crc[some] % length[some]).tolist(), strict=True):
        cut.append(word[:k] + word[k + 1 :])
    return pa.concat_arrays([plain, pa.array(cut, pa.large_string())])


def _folded(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, fresh, rows = [], [], 0

    def spill(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches(max_chunksize=20_000)

    for batch in batches:
        for i, j in words.runs(batch.column(1)):
            part = batch.slice(i, j - i)
            counted = pc.value_counts(word_array(part.column(0).to_pylist(), part.column(1)))
            fresh.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
            rows += len(counted)
            if rows >= FRESH:
                held, fresh, rows = [_folded(held + fresh)], [], 0
                if held[0].num_rows >= HELD:
                    yield from spill(held[0])
                    held = []
    if held or fresh:
        yield from spill(_folded(held + fresh))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all words of at least ``LEAST_COUNT`` occurrences."""
    words.batches(docs.sparkSession)
    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(some: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(some).encode("latin-1"), np.uint8).reshape(len(some), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    out = np.zeros((len(codes), DIMS), np.float32)
    rows = np.arange(len(codes))
    for column in _DIM[codes].T:
        out[rows, column] += 1
    return out


def split(v: np.ndarray) -> tuple[int, int] | None:
    """The dimension and count that part the vectors most evenly; None if they are all equal."""
    shares = np.stack([(v > t).mean(axis=0) for t in range(3)])
    t, d = np.unravel_index(np.abs(shares - 0.5).argmin(), shares.shape)
    if 0 < shares[t, d] < 1:
        return int(d), int(t)
    d = int((v.max(axis=0) - v.min(axis=0)).argmax())
    low, high = v[:, d].min(), v[:, d].max()
    return None if low == high else (d, int((low + high) // 2))


def visit(tree, v: np.ndarray, up: int, down: int, found) -> None:
    """Call ``found(leaf, rows)`` with the rows of ``v`` that are within the given letters up and down of each leaf's box.

    A node is ``(dimension, count, left, right)``: left holds the vectors with at most that count.  A row that crosses a border
    is taken to have spent its letter there.
    """
    stack = [(tree, np.arange(len(v)), np.full(len(v), -1 if up else -2, np.int8), np.full(len(v), -1 if down else -2, np.int8))]
    while stack:
        node, rows, more, less = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, tuple):
            found(node, rows)
            continue
        d, t, left, right = node
        now = v[rows, d] + (more == d) - (less == d)
        for child, inside, crossing, spent in ((left, now <= t, now == t + 1, less), (right, now > t, now == t, more)):
            crossing &= spent == -1
            ok = inside | crossing
            moved = np.where(crossing & ~inside, np.int8(d), spent)
            stack.append((child, rows[ok], *((more[ok], moved[ok]) if spent is less else (moved[ok], less[ok]))))


def routing(sample: list[str], total: int) -> dict[int, object]:
    """For each length of the sample's words the upper part of a k-d tree; its leaves are numbered cells."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    cells = iter(range(1 << 40))

    def part(v: np.ndarray, wanted: float):
        at = split(v) if wanted > 1 and len(v) > 1 else None
        if at is None:
            return next(cells)
        right = v[:, at[0]] > at[1]
        share = right.mean()
        return (*at, part(v[~right], wanted * (1 - share)), part(v[right], wanted * share))

    return {n: part(vectors(letters(some)), len(some) * total / len(sample) / CELL) for n, some in sorted(by_length.items())}


def _route(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.utf8_length(batch.column(0)).to_numpy()
            for n in np.unique(length).tolist():
                part = batch.filter(pa.array(length == n))
                v = vectors(letters(part.column(0).to_pylist()))
                at: list[tuple[int, int, np.ndarray]] = []
                # a length that the sample lacks is one cell
                for role, size, up, down in ((0, n, 0, 0), (1, n, 1, 1), (2, n + 1, 1, 0)):
                    visit(trees.value.get(size, -size), v, up, down, lambda cell, rows, r=role: at.append((r, cell, rows)))
                rows = np.concatenate([r for _, _, r in at])
                role = np.repeat([r for r, _, _ in at], [len(r) for _, _, r in at]).astype(np.int32)
                cell = np.repeat([c for _, c, _ in at], [len(r) for _, _, r in at]).astype(np.int64)
                own = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role), own.column(0), own.column(1)], ["cell", "role", "word", "n"])

    return run


def _tree(v: np.ndarray, rows: np.ndarray):
    at = split(v[rows]) if len(rows) > LEAF else None
    if at is None:
        return [rows]
    right = v[rows, at[0]] > at[1]
    return (*at, _tree(v, rows[~right]), _tree(v, rows[right]))


def one_letter_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ in exactly one letter (equal lengths), or lack exactly one letter of the other (``b`` longer by one)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def near_pairs(home: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words, ``(visitor, home)``; visitors have the length of the home words or one letter less."""
    hv, qv = vectors(home), vectors(visitors)
    limit = 2.5 if home.shape[1] == visitors.shape[1] else 1.5
    hs, qs = (hv * hv).sum(axis=1), (qv * qv).sum(axis=1)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def leaf(node: list[np.ndarray], rows: np.ndarray) -> None:
        (mine,) = node
        for i in range(0, len(mine), 4 * LEAF):
            some = mine[i : i + 4 * LEAF]
            for k in range(0, len(rows), 8_192):
                q = rows[k : k + 8_192]
                x, y = np.nonzero(qs[q, None] + hs[some] - 2 * (qv[q] @ hv[some].T) < limit)
                x, y = q[x], some[y]
                for j in range(0, len(x), 1 << 18):
                    a, b = x[j : j + (1 << 18)], y[j : j + (1 << 18)]
                    ok = one_letter_apart(visitors[a], home[b])
                    out.append((a[ok], b[ok]))

    visit(_tree(hv, np.arange(len(home))), qv, 1, int(limit > 2), leaf)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


_BEST = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _search(table: pa.Table) -> pa.Table:
    """Best near word and number of near words that one part of a cell finds, a row for each word that has some."""
    role = table.column("role").to_numpy()
    sides = []
    for r in range(3):
        some = table.filter(pa.array(role == r)).combine_chunks()
        sides.append((some.column("word").combine_chunks(), some.column("n").combine_chunks()))
    (home, home_n), found = sides[0], []
    if not len(home):
        return _BEST.empty_table()
    codes = letters(home.to_pylist())
    for r in (1, 2):
        word, n = sides[r]
        if not len(word):
            continue
        x, y = near_pairs(codes, letters(word.to_pylist()))
        x, y = pa.array(x), pa.array(y)
        found.append((word.take(x), home.take(y), home_n.take(y)))
        if r == 2:
            found.append((home.take(y), word.take(x), n.take(x)))
    pairs = pa.concat_tables([pa.table({"word": w, "near": o, "near_n": n}) for w, o, n in found]) if found else None
    if pairs is None or not pairs.num_rows:
        return _BEST.empty_table()
    order = pc.sort_indices(pairs, [("word", "ascending"), ("near_n", "descending"), ("near", "ascending")])
    pairs = pairs.take(order).combine_chunks()
    ends = pc.run_end_encode(pairs.column("word").combine_chunks()).run_ends.to_numpy()
    starts = np.concatenate([[0], ends[:-1]])
    best = pairs.take(pa.array(starts))
    return pa.table([best.column("word"), pa.array((ends - starts).astype(np.int64)), best.column("near_n"), best.column("near")], schema=_BEST)


def nearest(vocab: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` of the words of ``(word, n)`` that have near words."""
    spark = vocab.sparkSession
    sample = [r.word for r in vocab.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").collect()]
    trees = spark.sparkContext.broadcast(routing(sample, vocab.count()))  # at most SAMPLE nodes
    words.batches(spark, 10_000)
    routed = materialise(vocab.select("word", "n").mapInArrow(_route(trees), "cell long, role int, word string, n long"))
    several = lambda rows, limit: F.greatest(F.ceil(F.sum(F.when(rows, 1)) / limit), F.lit(1)).cast("int")
    home = F.col("role") == 0
    parts = routed.groupBy("cell").agg(several(home, 2 * CELL).alias("homes"), several(~home, VISITS).alias("guests"))
    dealt = routed.join(parts.where(F.col("homes").isNotNull()), "cell")
    mine = lambda n: F.array(F.pmod(F.xxhash64("word"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    dealt = dealt.withColumn("x", F.explode(F.when(home, mine(F.col("homes"))).otherwise(every(F.col("homes")))))
    dealt = dealt.withColumn("y", F.explode(F.when(home, every(F.col("guests"))).otherwise(mine(F.col("guests")))))
    found = dealt.select("cell", "x", "y", "role", "word", "n").groupBy("cell", "x", "y").applyInArrow(_search, "word string, n_near long, near_n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    best = materialise(best.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near")))
    discard(routed)
    words.batches(spark)
    return best


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each row of ``(word, form)``: the end of its chain of forms, found by pointer doubling."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the documents."""
    vocab = materialise(vocabulary(docs, id_col, text_col))
    known = vocab.join(nearest(vocab), "word", "left")
    is_form = F.col("near_n") >= 2 * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    known = materialise(known)
    ends = roots(known.where("form is not null").select("word", "form"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
