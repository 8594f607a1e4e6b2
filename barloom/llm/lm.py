"""Language-model scoring with a log-frequency Bloom filter.

Tokens are lower-cased words and one end per document; the model has unigrams and bigrams of the training
documents.  A count c is quantised to the level ``1 + floor(log(c) / log(BASE))``, and an n-gram is put into the
filter once for every level up to its own.  A count is read back by probing level 1, 2, ... until one is absent; the
expected count of the last level present stands for it.  Probabilities are smoothed from such counts alone::

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h) = (min(c(h w), c(h)) + MU p(w)) / (c(h) + MU)

so every token costs a handful of probes.  The exact unigram score is computed beside it, as a yardstick.

How it runs.  Documents are packed into segments of about 8 MB of text: distinct tokens, and each token's
index among them, written to the shared folder.  Segments send their distinct n-grams, with counts, to shards (a hash of
the n-gram); a shard adds them up, builds its part of the filter and answers every segment with the exact counts of
its tokens.  Segments then score their documents.  Nothing is grouped by token, so a frequent token is one entry per
segment.  Shards follow ``spark.sql.shuffle.partitions``, which has to follow the volume, so that a shard keeps its size.

A count of c puts at most 1.5 c levels into the filter, so its size is bounded by the number of training tokens before
anything is counted.  The filter is broadcast while that bound is at most ``BROADCAST`` bytes (it takes about a third of
it).  A larger one stays where it is: segments send the bigrams they need to the shards and get levels back, the way token
counts go.  Either way segments ask the shards once.

Defined results: a null or empty text is just its end; a row without an id counts as training; repeated rows count
as often as they come; an empty table gives no rows; other columns are ignored.  Tokens are told apart by
48 bits of hash in each shard, bigrams by 40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.session import materialise

#: Text bytes in a segment.
SEGMENT = 8_000_000
#: Quotient of neighbouring count levels, bits for each level put in, probes for each level.
BASE, BITS, PROBES = 2**0.5, 8, 4
#: Weight of the unigram probability, in counts.
MU = 60.0
#: Largest bound, in bytes, of a filter that is broadcast.
BROADCAST = 400_000_000

_END = np.uint64(0x51ED270B7A1C4E37)
#: Hash bits that tell tokens and bigrams of a shard apart; the bits above are the shard.
_TOKEN, _PAIR = 48, 40
_MOST_SHARDS = 1 << 16
_LEVELS = 120


def _key(h: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """A hash as its shard, from the top 16 bits, and its last ``bits`` bits; in order of shards."""
    shard = ((h >> np.uint64(48)) * np.uint64(shards)) >> np.uint64(16)
    return (shard << np.uint64(bits)) | (h & np.uint64((1 << bits) - 1))


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(data, int(size) * kind.itemsize, codec="zstd"), kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, first bytes together, then second bytes, ..., compressed."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy())


def _unpack_sorted(data: bytes, size: int) -> np.ndarray:
    planes = _unpack(data, 8 * int(size), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def level(count: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


#: Expected count of each level; none for level 0.
EXPECTED = np.array([0.0] + [(BASE ** (j - 1) + BASE**j - 1) / 2 if j > 1 else 1.0 for j in range(1, _LEVELS)])


def _places(key: np.ndarray, lev: np.ndarray | int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    a = words.mix(key ^ (np.uint64(0x9E3779B97F4A7C15) * np.asarray(lev, np.uint64)))
    b = words.mix(a) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % np.asarray(size, np.uint64)


def build_filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of the filter that holds ``keys`` with quantised ``counts``."""
    lev = level(counts)
    size = max(64, int(lev.sum()) * BITS)
    bits = np.zeros(-(-size // 8) * 8, bool)
    for j in range(1, int(lev.max(initial=0)) + 1):
        for at in _places(keys[lev >= j], j, len(bits)):
            bits[at] = True
    return np.packbits(bits).tobytes()


class Filter:
    """The filters of all shards after one another."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([8 * len(p) for p in parts], np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.uint64)
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def levels(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The last level present of each key, by probing one level after the other."""
        out = np.zeros(len(key), np.uint8)
        alive = np.arange(len(key))
        for j in range(1, _LEVELS):
            of = shard[alive]
            there = np.ones(len(alive), bool)
            for at in _places(key[alive], j, self.size[of]):
                at = at + self.start[of]
                there &= (self.bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            if not len(alive):
                break
            out[alive] = j
        return out


SEGMENTS = (
    "seg long, doc_ids array<long>, held array<boolean>, n_tokens array<int>, n_keys int, keys binary, trained binary, ids binary"
)


def _segments(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in words.runs(batch.column(2), SEGMENT):
                ids, held, texts = (c.slice(i, j - i) for c in batch.columns)
                h, owner = _tokens(texts)
                keys, at = np.unique(_key(h, shards, _TOKEN), return_inverse=True)
                train = np.repeat(~held.to_numpy(zero_copy_only=False), np.diff(owner))
                row = {
                    "seg": [number], "doc_ids": [ids], "held": [held], "n_tokens": [np.diff(owner)], "n_keys": [len(keys)],
                    "keys": [_pack_sorted(keys)],
                    "trained": [_pack(np.bincount(at[train], minlength=len(keys)).astype(np.int32))],
                    "ids": [_pack(at.astype(np.int32).view(np.uint8).reshape(-1, 4).T.copy())],
                }
                yield pa.RecordBatch.from_pydict(row, schema=_arrow(SEGMENTS))
                number += 1

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "double": pa.float64(), "boolean": pa.bool_(),
    }
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end of each text, and each text's first token."""
    h, owner = words.hashed(texts, words.SPACED)
    return np.insert(h, owner[1:], _END), owner + np.arange(len(owner))


def _read(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment: its distinct tokens, each token's index among them, and each token's bigram with the one before
    (the end of a text before its first)."""
    keys = _unpack_sorted(row["keys"], row["n_keys"])
    planes = _unpack(row["ids"], 4 * sum(row["n_tokens"]), np.uint8).reshape(4, -1)
    ids = np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)
    now = keys[ids]
    before = np.concatenate([_key(_END.reshape(1), shards, _TOKEN), now[:-1]])
    return keys, ids, _key(words.mix(before * np.uint64(0xD6E8FEB86659FD93) + now), shards, _PAIR)


PIECES = "shard int, seg long, kind int, n int, keys binary, counts binary"


def _cut(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard begins in ascending keys."""
    return np.searchsorted(keys >> np.uint64(bits), np.arange(shards + 1, dtype=np.uint64))


def _pieces(shards: int, ask: bool):
    """Tokens (kind 0), training bigrams with counts (1) and, if ``ask``, bigrams to look up (2) of each segment and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = row["seg"]
                keys, _, big = _read(row, shards)
                trained = _unpack(row["trained"], len(keys), np.int32)
                train = np.repeat(~np.array(row["held"], bool), row["n_tokens"])
                sent = [(0, keys, trained, _TOKEN)]
                for kind, of in ((1, big[train]), *([(2, big)] if ask else [])):
                    of, n = np.unique(of, return_counts=True)
                    sent.append((kind, of, n.astype(np.int32), _PAIR))
                for kind, of, n, bits in sent:
                    cut = _cut(of, shards, bits)
                    for s in np.flatnonzero(np.diff(cut)):
                        a, b = cut[s], cut[s + 1]
                        one = {
                            "shard": [s], "seg": [seg], "kind": [kind], "n": [b - a], "keys": [_pack_sorted(of[a:b])],
                            "counts": [None if kind == 2 else _pack(n[a:b])],
                        }
                        yield pa.RecordBatch.from_pydict(one, schema=_arrow(PIECES))

    return run


ANSWERS = "kind int, shard int, seg long, data binary, total long, distinct long"


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all lists and their summed counts."""
    flat = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], np.concatenate([np.zeros(0, np.int64), *counts])[order].astype(np.int64)
    first = np.flatnonzero(np.diff(flat, prepend=~flat[:1]) != 0) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.add.reduceat(n, first) if len(flat) else n


def _answer(table: pa.Table) -> pa.Table:
    """Of a shard: its filter (kind 3, with the tokens' total and number), exact counts (0) and levels (2) for each segment."""
    rows = table.to_pylist()
    shard = rows[0]["shard"]
    read = lambda kind: [
        (r["seg"], _unpack_sorted(r["keys"], r["n"]), None if kind == 2 else _unpack(r["counts"], r["n"], np.int32))
        for r in rows if r["kind"] == kind
    ]
    total = lambda parts: _added([k for _, k, _ in parts], [n for _, _, n in parts])
    tokens = read(0)
    keys, counts = total(tokens)
    out = [(0, shard, seg, _pack(counts[np.searchsorted(keys, k)]), 0, 0) for seg, k, _ in tokens]
    both, n = total(read(1))
    known = counts > 0
    data = build_filter(np.concatenate([~keys[known], both]), np.concatenate([counts[known], n]))
    out.append((3, shard, None, data, int(counts.sum()), int(known.sum())))
    asked = read(2)
    if asked:
        one = Filter([data])
        for kind, parts in ((2, asked), (4, [(seg, ~k, None) for seg, k, _ in tokens])):
            out += [(kind, shard, seg, one.levels(np.zeros(len(k), np.int64), k).tobytes(), 0, 0) for seg, k, _ in parts]
    names = [x.split(" ")[0] for x in ANSWERS.split(", ")]
    return pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_arrow(ANSWERS))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shards: int, total: int, distinct: int, whole, mu: float):
    """Score the documents of segments that have got their answers; ``whole``: the filter, if it was broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = total + 0.5 * (distinct + 1)
        for batch in batches:
            for row in batch.to_pylist():
                keys, ids, big = _read(row, shards)
                part = lambda kind: [a["data"] for a in row["parts"] if a["kind"] == kind]  # noqa: E731, B023
                sizes = np.diff(_cut(keys, shards, _TOKEN))
                exact = np.concatenate([_unpack(d, n, np.int64) for d, n in zip(part(0), sizes[sizes > 0], strict=True)])
                if whole is not None:
                    place = lambda k, bits: (k >> np.uint64(bits)).astype(np.int64)
                    one = EXPECTED[whole.value.levels(place(keys, _TOKEN), ~keys)]
                    two = EXPECTED[whole.value.levels(place(big, _PAIR), big)]
                else:
                    one = EXPECTED[np.frombuffer(b"".join(part(4)), np.uint8)]
                    _, at = np.unique(big, return_inverse=True)
                    two = EXPECTED[np.frombuffer(b"".join(part(2)), np.uint8)[at]]
                end = one[np.searchsorted(keys, _key(_END.reshape(1), shards, _TOKEN))][0]
                p = (one[ids] + 0.5) / spread
                context = np.concatenate([[end], one[ids[:-1]]])
                logs = np.log10((np.minimum(two, context) + mu * p) / (context + mu))
                flat = np.log10((exact[ids] + 0.5) / spread)
                first = np.concatenate([[0], np.cumsum(row["n_tokens"])[:-1]])
                result = {
                    "doc_id": row["doc_ids"], "held_out": row["held"], "n_tokens": row["n_tokens"],
                    "n_known": np.add.reduceat((exact[ids] > 0).astype(np.int64), first),
                    "base_score": np.add.reduceat(flat, first), "score": np.add.reduceat(logs, first),
                }
                yield pa.RecordBatch.from_pydict(result, schema=_arrow(SCORES))

    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, broadcast: int = BROADCAST) -> DataFrame:
    """Train on the rows for which the column ``held_out`` is not true and score all rows:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10)."""
    spark = docs.sparkSession
    words.batches(spark, 4_000)  # a segment is made of one batch
    shards = min(_MOST_SHARDS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out, F.lit(False)), F.coalesce(F.col(text_col), F.lit("")))
    segments = materialise(chosen.mapInArrow(_segments(shards), SEGMENTS))

    def ask(levels: bool) -> DataFrame:
        pieces = segments.mapInArrow(_pieces(shards, levels), PIECES)
        return materialise(pieces.groupBy("shard").applyInArrow(_answer, ANSWERS))

    trained = F.expr("aggregate(arrays_zip(held, n_tokens), 0L, (n, x) -> n + if(x.held, 0, x.n_tokens))")
    tokens = segments.agg(F.sum(trained)).first()[0] or 0
    # unigrams and bigrams, 1.5 levels for each occurrence
    whole_fits = 3 * tokens * BITS / 8 <= broadcast
    answers = ask(not whole_fits)
    about = answers.where("kind = 3").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = (x or 0 for x in about)
    whole = None
    if whole_fits:
        parts = {r["shard"]: bytes(r["data"]) for r in answers.where("kind = 3").select("shard", "data").coalesce(8).toLocalIterator()}
        empty = build_filter(np.zeros(0, np.uint64), np.zeros(0))
        whole = spark.sparkContext.broadcast(Filter([parts.pop(s, empty) for s in range(shards)]))
    parts = answers.where("kind <> 3").groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("shard", "kind", "data"))).alias("parts"))
    scored = segments.join(parts, "seg").mapInArrow(_score(shards, total, distinct, whole, mu), SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
