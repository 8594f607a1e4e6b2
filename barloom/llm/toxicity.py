"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed word features is trained with numpy from confirmed toxic texts (P) and unlabelled
ones (U); labels that say "not toxic" are not used as examples.  With class prior pi and logistic loss the risk is

    pi R_P(+) + max(0, R_U(-) - pi R_P(-))

where the second term estimates the risk on the clean part of U.  Where a batch makes it negative, which
only overfitting can, the step climbs that term instead (the non-negative correction).  The prior is the share of toxic rows
among the labelled rows that may be learned from.

Features of a text are its distinct lower-cased words and their first 4 to 8 bytes, as 64-bit hashes.  The model
has those that are in at least ``LEAST`` of the sampled toxic texts and whose share there differs from that in the
unlabelled ones by more than ``SURE`` standard errors: some thousand, whatever the vocabulary.

Scale: training uses a bounded sample, at most ``MOST_TOXIC`` and ``MOST_UNLABELLED`` texts with the least
hash of their id; only its ids (bounded by these numbers) and the weights are broadcast.  Scoring is one pass over whole texts.

Defined results: a null or empty text scores as a text without features; rows sharing an id are sampled together; a label that is
null or of no document is not used; without any toxic label every score is the prior, 0 without labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import words

PREFIXES = (4, 5, 6, 7, 8)
#: Bounds of the training sample.
MOST_TOXIC, MOST_UNLABELLED = 4_000, 8_000
#: Sampled toxic texts a feature has to be in, and standard errors its share has to differ by.
LEAST, SURE = 3, 2.0
EPOCHS, RATE, DECAY, BATCH = 60, 0.1, 1e-3, 256
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of all features, with repetitions."""
    data, at = words.text_bytes(texts)
    data = words.LOWER[data]
    starts, ends, owner = words.find(data, at, words.ALNUM)
    of = np.repeat(np.arange(len(texts)), np.diff(owner))
    found, text = [words.hashes(data, starts, ends)], [of]
    for k in PREFIXES:
        long = ends - starts >= k
        found.append(words.hashes(data, starts[long], starts[long] + k) + np.uint64(k))
        text.append(of[long])
    return np.concatenate(text), np.concatenate(found)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in words.runs(batch.column(1)):
            text, feature = _features(batch.column(1).slice(i, j - i))
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(j - i + 1))
            rows = [np.unique(feature[order[a:b]]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())], ["toxic", "features"])


class Model:
    """Features with a weight, sorted, their weights, and the bias."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, bias: float):
        self.keys, self.weight, self.bias = keys, weight, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def known(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which features the model has, and their index."""
        where = np.flatnonzero(self.maybe[feature >> np.uint64(44)])
        if not len(self.keys):
            return where[:0], where[:0]
        at = np.minimum(np.searchsorted(self.keys, feature[where]), len(self.keys) - 1)
        same = self.keys[at] == feature[where]
        return where[same], at[same]

    def score(self, texts: pa.Array) -> np.ndarray:
        text, feature = _features(texts)
        where, at = self.known(feature)
        both = np.unique(text[where] * max(1, len(self.keys)) + at)
        text, at = np.divmod(both, max(1, len(self.keys)))
        return _sigmoid(self.bias + np.bincount(text, self.weight[at], len(texts)))


class Texts:
    """Feature indexes of texts as one array."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate([np.zeros(0, np.int64), *rows])

    def __len__(self):
        return len(self.size)

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[chosen]
        first = np.repeat(self.at[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.repeat(np.arange(len(chosen)), n), self.flat[first + np.arange(n.sum())]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def select(toxic: list[np.ndarray], unlabelled: Iterator[np.ndarray], least: int = LEAST, sure: float = SURE) -> tuple[np.ndarray, list, list]:
    """The features of the model, and both kinds of texts as indexes of them."""
    keys, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *toxic]), return_counts=True)
    keys, often = keys[often >= least], often[often >= least]
    some = Model(keys, np.zeros(len(keys)), 0.0)
    p, u = [some.known(r)[1] for r in toxic], [some.known(r)[1] for r in unlabelled]
    base = np.bincount(np.concatenate([np.zeros(0, np.int64), *u]), minlength=len(keys)) / max(1, len(u))
    error = np.sqrt((base + 1 / max(1, len(u))) * (1 - np.minimum(base, 0.999)) / max(1, len(toxic)))
    keep = np.abs(often / max(1, len(toxic)) - base) > sure * error
    new = np.cumsum(keep) - 1
    return keys[keep], [new[r[keep[r]]] for r in p], [new[r[keep[r]]] for r in u]


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the bias, from the indexes of the features of each text."""
    weight, bias = np.zeros(size), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (20.0 if prior else -20.0)
    if not toxic or not unlabelled or not 0 < prior < 1:
        return weight, bias
    p, u = Texts(toxic), Texts(unlabelled)
    squares, draw = np.full(size + 1, 1e-8), np.random.default_rng(seed)
    steps = max(8, -(-len(u) // BATCH))
    for epoch in range(epochs):
        rate = RATE / (1 + 0.05 * epoch)
        p_order, u_order = np.resize(draw.permutation(len(p)), max(len(p), steps)), np.resize(draw.permutation(len(u)), max(len(u), steps))
        for mine, other in zip(np.array_split(p_order, steps), np.array_split(u_order, steps), strict=True):
            (pt, pf), (ut, uf) = p.rows(mine), u.rows(other)
            zp = bias + np.bincount(pt, weight[pf], len(mine))
            zu = bias + np.bincount(ut, weight[uf], len(other))
            sp, su = _sigmoid(zp), _sigmoid(zu)
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if clean >= 0:
                gp, gu = -prior * np.ones(len(mine)) / len(mine), su / len(other)
            else:
                gp, gu = prior * sp / len(mine), -su / len(other)
            grad = np.bincount(pf, gp[pt], size) + np.bincount(uf, gu[ut], size)
            seen = np.flatnonzero(grad)
            step = grad[seen] + DECAY * weight[seen]
            squares[seen] += step**2
            weight[seen] -= rate * step / np.sqrt(squares[seen])
            whole = gp.sum() + gu.sum()
            squares[-1] += whole**2
            bias -= rate * whole / np.sqrt(squares[-1])
    return weight, bias


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Learn from the rows for which ``usable``, a column on the id, holds; of other rows neither label nor text is used."""
    words.batches(docs.sparkSession)
    mine = labels.where(usable & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    about = mine.agg(F.avg("toxic")).first()[0] or 0.0
    order = [F.xxhash64(id_col), F.col(id_col)]
    p = mine.where("toxic = 1").select(id_col, F.lit(1).alias("toxic")).orderBy(*order).limit(most_toxic)
    u = docs.where(usable).select(id_col, F.lit(0).alias("toxic")).distinct().orderBy(*order).limit(most_unlabelled)
    chosen = F.broadcast(p.union(u))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(chosen, id_col).select("toxic", "text").mapInArrow(_collect, "toxic int, features binary")
    toxic = [np.frombuffer(r["features"], np.uint64) for r in rows.where("toxic = 1").toLocalIterator()]
    others = (np.frombuffer(r["features"], np.uint64) for r in rows.where("toxic = 0").toLocalIterator())
    keys, p, u = select(toxic, others)
    return Model(keys, *train(p, u, len(keys), float(about)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    words.batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.runs(batch.column(1)):
                scores = pa.array(sent.value.score(batch.column(1).slice(i, j - i)), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), scores], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, score double")
