"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves of ``LEAF`` pre-tokens hold their number of
characters and of tokens, inner nodes the sums.  A scan for pre-tokens looks at most two characters past the end of a match and
never back.  So for an edit of the characters s to e the pre-tokens that end by s - 2 stand; the leaf that holds
character s - 2 is found by descending the tree and encoded anew from its beginning, through the edit, up to the first leaf end behind e
that is also a boundary of the new scan.  From there on nothing has changed.  The first of those leaves takes the new
sums, the others become empty, and the sums above them are updated; counts of all other leaves are never looked at.

Scale: a document is worked on in its own row, nothing is shuffled; the tree has about two numbers per 32 pre-tokens.

Defined results: a null text is empty; edits are given in characters of the text before any edit and are applied from
the right; they are cut off at the text's end and at the beginning of the edit to their right; null edits are none; repeated rows
are worked on each; an empty table gives no rows; other columns pass through, columns named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from barloom.llm import words
from barloom.llm.bpe import Coder, read_ranks

LEAF = 64
#: Different pre-tokens whose number of tokens a worker remembers.
REMEMBERED = 500_000

TREE = StructType().add("chars", ArrayType(IntegerType())).add("tokens", ArrayType(IntegerType()))


class Counter(dict):
    """Tokens of a pre-token, looked up or encoded; forgotten all at once when too many."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = len(self.encoder.encode_ordinary(piece))
        return n


class Tree:
    """Sums over leaves in the order of a heap: node k has the children 2k and 2k + 1, the leaves are the last half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.leaves = len(chars) // 2

    @classmethod
    def of(cls, sizes: np.ndarray, counts: np.ndarray) -> Tree:
        """A tree over pre-tokens with ``sizes`` characters and ``counts`` tokens."""
        first = np.arange(0, max(1, len(sizes)), LEAF)
        leaves = 1 << (len(first) - 1).bit_length()
        nodes = []
        for values in (sizes, counts):
            tree = np.zeros(2 * leaves, np.int32)
            if len(values):
                tree[leaves : leaves + len(first)] = np.add.reduceat(values, first)
            level = leaves
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
            nodes.append(tree)
        return cls(*nodes)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place``, and its first character."""
        node, left = 1, max(0, min(place, int(self.chars[1]) - 1))
        begin = 0
        while node < self.leaves:
            node *= 2
            if left >= self.chars[node] and self.chars[node + 1]:
                left -= self.chars[node]
                begin += int(self.chars[node])
                node += 1
        return node - self.leaves, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        more, extra = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += extra
            node //= 2


def edit(text: str, tree: Tree, start: int, end: int, new: str, pattern: regex.Pattern, count: Counter) -> tuple[str, int]:
    """``text`` after one edit, with the tree brought up to date; and the characters that were encoded."""
    leaf, begin = tree.find(start - 2)
    last, limit = leaf, begin + int(tree.chars[leaf + tree.leaves])
    while limit < end or (limit == start and limit < len(text)):
        last += 1
        limit += int(tree.chars[last + tree.leaves])
    after = text[:start] + new + text[end:]
    shift = len(after) - len(text)
    tokens, place = 0, begin
    for m in pattern.finditer(after, begin):
        if place >= limit + shift:
            if place == limit + shift:
                break
            while limit + shift < place:  # no boundary at that leaf's end any more
                last += 1
                limit += int(tree.chars[last + tree.leaves])
            if place == limit + shift:
                break
        tokens += count[m.group()]
        place = m.end()
    if place >= len(after):
        last = tree.leaves - 1
    tree.put(leaf, place - begin, tokens)
    for k in range(leaf + 1, last + 1):
        if tree.chars[k + tree.leaves]:
            tree.put(k, 0, 0)
    return after, place - begin


def _coder(docs: DataFrame, path: str, pattern: str):
    spark = docs.sparkSession
    words.batches(spark)
    return spark.sparkContext.broadcast(Coder(read_ranks(spark, path), pattern))


def _lists(trees: list[Tree]) -> pa.StructArray:
    kind = pa.list_(pa.int32())
    return pa.StructArray.from_arrays([pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind)], ["chars", "tokens"])


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for i, j in words.runs(batch.column(text), 4_000_000):
        yield batch.slice(i, j - i)


def with_trees(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tree``, the segment tree of its text."""
    coder, docs = _coder(docs, path, pattern), docs.drop("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, count = regex.compile(pattern), Counter(coder.value.encoder())
        for batch in batches:
            for part in _slices(batch, text_col):
                trees = []
                for text in part.column(text_col):
                    pieces = p.findall(text.as_py() or "")
                    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
                    trees.append(Tree.of(sizes, np.fromiter(map(count.__getitem__, pieces), np.int32, len(pieces))))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(trees)], [*part.schema.names, "tree"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("tree", TREE))


def apply_edits(docs: DataFrame, path: str, pattern: str, edits_col: str = "edits", text_col: str = "text") -> DataFrame:
    """``docs``, which have a ``tree`` and ``edits`` (array of ``start, end, text``), with text and tree after the
    edits, ``n_encoded`` (characters encoded anew) and ``n_tokens`` (the root's sum)."""
    coder, docs = _coder(docs, path, pattern), docs.drop("n_encoded", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, count = regex.compile(pattern), Counter(coder.value.encoder())
        for batch in batches:
            for part in _slices(batch, text_col):
                texts, trees, encoded, totals = [], [], [], []
                for text, tree, edits in zip(part.column(text_col), part.column("tree"), part.column(edits_col), strict=True):
                    text, done = text.as_py() or "", 0
                    tree = Tree(*(np.array(tree[k].values, np.int32) for k in ("chars", "tokens")))
                    right = len(text)
                    for e in sorted(edits.as_py() or (), key=lambda e: (e["start"], e["end"]), reverse=True):
                        start = max(0, min(e["start"], right))
                        end = max(start, min(e["end"], right))
                        text, n = edit(text, tree, start, end, e["text"] or "", p, count)
                        done, right = done + n, start
                    texts.append(text)
                    trees.append(tree)
                    encoded.append(done)
                    totals.append(int(tree.tokens[1]) if len(tree.tokens) > 1 else 0)
                of = {n: part.column(n) for n in part.schema.names} | {text_col: pa.array(texts, pa.string()), "tree": _lists(trees)}
                more = {"n_encoded": pa.array(encoded, pa.int64()), "n_tokens": pa.array(totals, pa.int64())}
                yield pa.RecordBatch.from_pydict(of | more)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("n_encoded", LongType()).add("n_tokens", LongType()))


def own_edits(text) -> list:
    """Edits of a text derived from itself: a cut at a quarter, a repetition at the middle, an exchange at three quarters."""
    n = F.length(text)
    at = lambda q: F.floor(n * q / 4).cast("int")
    one = lambda s, size, new: F.struct(s.alias("start"), (s + size).alias("end"), new.alias("text"))
    return F.array(
        one(at(1), 7, F.lit("")),
        one(at(2), 0, F.substring(text, F.lit(1), F.lit(12))),
        one(at(3), 15, F.concat(F.substring(text, at(1) + 1, F.lit(20)), F.lit("\n\n"))),
    )
