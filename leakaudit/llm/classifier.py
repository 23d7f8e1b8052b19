"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates.

A text is cut into words (runs of letters and digits, or of other characters). Features are hashed n-grams
of the words themselves, of their shapes (kind, case, length, same as the word
before), and of how often three-word sequences recur; each family has length 1. A score is a sparse dot
product.

Fitting: at most ``FIT_ROWS`` labelled rows, those of the smallest hash, are dealt to shards of
about ``SHARD_ROWS``; each is one task that learns online, and the weights are averaged. The bound is
a parameter and the only one: scoring is one pass over whole texts, with 2**BITS weights sent to each task.

Defined results: null and empty texts have no features and get the score of the intercept; of several labels of a
document the smallest counts, null labels none; without any label, or with one class only, the
score is that class's smoothed share; repeated rows repeat their result; an empty table gives an
empty result; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.llm import common
from leakaudit.llm.common import mix64, slices, span_hashes, text_bytes

BITS = 18
FIT_ROWS = 20_000
SHARD_ROWS = 2500
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.1
FAMILIES = 3

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter or digit, 2 other
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_low:_high] = 1
_KIND[list(common.SPACE_BYTES)] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature number, value) of all non-zero features, ordered by text."""
    raw, ends = text_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = _KIND[raw]
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[ends] = True
    at = np.flatnonzero(change)
    first, stop = at[:-1], at[1:]
    word = kind[first] > 0
    first, stop = first[word], stop[word]
    size = stop - first
    own = span_hashes(raw, first, stop)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    high = capitals[stop] - capitals[first]
    case = np.where(high == 0, 0, np.where(high == size, 1, np.where((high == 1) & (_UPPER[raw[first]] == 1), 2, 3)))
    text = np.searchsorted(ends, first, "right") - 1
    k = len(own)
    same = np.zeros(k, np.int64)
    same[1:] = (own[1:] == own[:-1]) & (text[1:] == text[:-1])
    shape = mix64((((kind[first].astype(np.int64) * 4 + case) * 32 + np.minimum(size, 24)) * 2 + same).astype(np.uint64) + np.uint64(77))
    follows = np.zeros(k, bool)
    follows[1:] = text[1:] == text[:-1]

    def pair(values: np.ndarray) -> np.ndarray:
        joined = values.copy()
        joined[1:] = mix64(values[1:] * np.uint64(3) + values[:-1])
        return joined

    found = [(0, text, own), (0, text[follows], pair(own)[follows]), (1, text, shape), (1, text[follows], pair(shape)[follows])]
    third = follows.copy()
    third[1:] &= follows[:-1]
    if third.any():
        triple = pair(pair(own))[third]
        owner = text[third]
        mixed = mix64(triple ^ mix64(owner.astype(np.uint64) + np.uint64(5)))
        _, back, many = np.unique(mixed, return_inverse=True, return_counts=True)
        found.append((2, owner, np.minimum(many[back], 6).astype(np.uint64) + np.uint64(9000)))
    keys = np.concatenate([(t.astype(np.int64) * FAMILIES + f) << BITS | (mix64(v + np.uint64(f)) >> np.uint64(64 - BITS)).astype(np.int64) for f, t, v in found])
    keys, counts = np.unique(keys, return_counts=True)
    block = keys >> BITS
    value = counts.astype(float)
    norm = np.sqrt(np.bincount(block, value * value))
    return block // FAMILIES, keys & ((1 << BITS) - 1), value / norm[block]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Leader:
    """Follow-the-regularised-leader with a rate of its own for every weight."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit_shard(texts: pa.Array, labels: np.ndarray, seed: int) -> np.ndarray:
    """Weights, the last one the intercept."""
    leader = Leader((1 << BITS) + 1)
    pieces = []
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text"):
        t, at, x = features(batch.column("text"))
        edges = np.searchsorted(t, np.arange(batch.num_rows + 1))
        pieces += [(np.append(at[a:b], 1 << BITS), np.append(x[a:b], 1.0)) for a, b in zip(edges[:-1], edges[1:])]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(pieces)):
            leader.learn(*pieces[i], labels[i])
    return leader.weights()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """2**BITS weights and the intercept, from a bounded number of labelled documents."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(label).cast("int").alias("y"))
    chosen = common.materialise(known.orderBy(F.xxhash64("id"), "id").limit(rows), "chosen")
    shards = max(1, math.ceil(chosen.count() / SHARD_ROWS))
    one = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    both = one.join(F.broadcast(chosen), "id")  # at most ``rows`` pairs of numbers
    dealt = both.select("id", "text", "y", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))

    def work(keys, table):
        table = table.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        texts = table.column("text").combine_chunks()
        y = table.column("y").to_numpy()
        w = _fit_shard(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, y, keys[0].as_py())
        return pa.table({"w": [w.astype(np.float64).tobytes()], "n": [len(y)], "p": [int(y.sum())]})

    fitted = dealt.groupBy("shard").applyInArrow(work, "w binary, n long, p long").collect()  # one row per shard
    n, p = sum(r.n for r in fitted), sum(r.p for r in fitted)
    weights = np.zeros((1 << BITS) + 1)
    if n and 0 < p < n:
        weights = sum(np.frombuffer(r.w) * r.n for r in fitted) / n
    else:
        weights[-1] = np.log((p + 1) / (n - p + 1))
    return weights


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in slices(batches, "text"):
            t, at, x = features(batch.column("text"))
            total = np.bincount(t, w[at] * x, minlength=batch.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigmoid(total))], names=["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, rows.select("id").schema.add("score", "double"))
