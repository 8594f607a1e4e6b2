"""Words of whole Arrow batches as 64-bit hashes, found and hashed on the raw UTF-8 bytes.

Both word definitions in use separate words at ASCII bytes only, so they can be told apart byte by
byte: a byte of 0x80 or more always belongs to a word.  Words are compared by a 64-bit hash of their
bytes (random byte values in a polynomial modulo 2**64, then mixed); two different words of a
vocabulary of ten million meet with a probability of about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Text bytes that are worked on at once; a document is never split.
CHUNK_BYTES = 1_500_000
#: Bytes whose hash terms (some 40 bytes each) are held at once.
HASH_BYTES = 256_000

_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20261).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []

#: White space separates: ``[^\\x20\\x09-\\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Only letters, digits and what lies beyond ASCII: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Each byte lower-cased (A-Z only).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: Most bytes of an Arrow batch; a single row may be larger.
BATCH_BYTES = 8_000_000


def batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Set the session's Arrow batches to ``rows`` rows and ``BATCH_BYTES`` bytes, whichever is reached first.

    Documents are some kilobytes each, pairs of their sets far more, and a stage may chain two Python workers, so Spark's 10,000 rows to a
    batch would hold much of an executor's memory several times over.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        _POWERS[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64))])
            for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after one another, and where each text begins (one more entry than texts); null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word, and each text's first word (one more entry than texts)."""
    inside = kind[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        part = data[low : ends[j - 1]]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * power[: len(part)], out=total[1:])
        s = starts[i:j] - low
        out[i:j] = (total[ends[i:j] - low] - total[s]) * inverse[s]
        i = j
    return mix(out)


def hashed(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased (A-Z only) texts, and each text's first word."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    starts, ends, owner = find(data, at, kind)
    return hashes(data, starts, ends), owner


def runs(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` text bytes; one longer text is a range of its own."""
    _, at = text_bytes(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (all of them when there are fewer)."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    return mix(out)
