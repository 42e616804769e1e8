"""Quality classifier with supervised subword embeddings.

A document's features are its words, the byte 3- to 5-grams of each word with
its edges marked, and one word bigram: a word that repeats the one before it.
Each is hashed to a learned vector; their average goes through a softmax layer.
numpy stochastic gradient descent trains vectors and layer together on a
bounded sample of labelled rows (``TRAIN_ROWS``, of at most ``TRAIN_CHARS``
characters each); every whole text is scored.  As no step between average and
softmax bends, a feature's share of the score is one number, looked up per
distinct word of a slice.

Defined results: a null or empty text has no features and gets the score of the
bias; rows with a null id are left out; repeated rows are scored alike; without
any usable label the score is 0.5.  Labels, language, source and id are no
inputs of a score.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import release_memory
from .exchange import stream
from .wordbatch import NOT_SPACE, U, Words, mix, ragged, slices, windows

TRAIN_ROWS, TRAIN_CHARS = 4000, 100_000
#: A small sample is gone through more often, for STEPS steps at least.
BITS, DIM, STEPS, RATE = 18, 16, 24_000, 0.4
THRESHOLD = 0.3
_SAME = 0


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of distinct words, one after another, and the words' pointers into them."""
    size = end - start
    # each word between two edge marks; bytes 0 and 1 can't be in the marks' place
    text = np.zeros(int((size + 2).sum()), dtype=U)
    at = np.cumsum(size + 2) - (size + 2)
    text[ragged(at + 1, size)] = data[ragged(start, size)].astype(U) + U(2)
    text[at], text[at + size + 1] = U(1), U(258)
    numbers, owner = [h], [np.arange(len(h))]
    for n in (3, 4, 5):
        count = np.maximum(size + 3 - n, 0)
        numbers.append(mix(windows(mix(text + U(n << 16)), n)[ragged(at, count)]) if count.sum() else h[:0])
        owner.append(np.repeat(np.arange(len(h)), count))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(numbers)[order] % U((1 << BITS) - 1)).astype(np.int64) + 1
    return ids, np.searchsorted(owner[order], np.arange(len(h) + 1))


def _slice_features(data, offsets):
    words = Words(data, offsets, NOT_SPACE)
    h = words.hashes()
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    ids, ptr = word_features(words.data, words.start[first], words.end[first], unique)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[words.ptr[:-1][words.ptr[:-1] < len(h)]] = False
    return words, inverse, ids, ptr, same


def _examples(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, their shares) of each text: views of long arrays, one a slice, whose memory goes back when they do."""
    out = []
    for lo, hi, data, offsets in slices(pa.array(texts, type=pa.string())):
        found = []
        words, inverse, ids, ptr, same = _slice_features(data, offsets)
        for r in range(hi - lo):
            a, b = words.ptr[r], words.ptr[r + 1]
            w, k = np.unique(inverse[a:b], return_counts=True)
            n = np.diff(ptr)[w]
            numbers = np.append(ids[ragged(ptr[w], n)], _SAME)
            weight = np.append(np.repeat(k, n), same[a:b].sum()).astype(np.float64)
            f, at = np.unique(numbers, return_inverse=True)
            share = np.bincount(at, weights=weight)
            found.append((f.astype(np.int32), (share / max(share.sum(), 1)).astype(np.float32)))
        ends = np.cumsum([len(f) for f, _ in found])[:-1]
        out += zip(*(np.split(np.concatenate(x), ends) for x in zip(*found, strict=True)), strict=True)
    return out


def train(texts: list[str], labels: list[int], seed: int = 11) -> tuple[np.ndarray, float]:
    """(each feature's share of the log odds of label 1, bias)."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    examples, y = _examples(texts), np.asarray(labels)
    epochs = -(-STEPS // max(1, len(examples)))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            done += 1
            f, share = examples[i]
            hidden = share @ vectors[f]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            # a feature's step is scaled up as its share is small: the average is over hundreds of them
            vectors[f] -= rate * np.outer(np.sqrt(share), back)
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """A model from labelled rows whose crc32(id as text) mod 5 isn't 0: the first ``TRAIN_ROWS`` by a hash of the id."""
    usable = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "y", "text").limit(2 * TRAIN_ROWS).toArrow()
    if not rows.num_rows:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    texts, ys = rows["text"].to_pylist(), rows["y"].to_pylist()
    del rows
    model = train(texts, ys)
    del texts
    release_memory()
    return model


def _scores(column: pa.Array, odds: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text of a column."""
    out = [np.zeros(0)]
    for _, _, data, offsets in slices(column):
        words, inverse, ids, ptr, same = _slice_features(data, offsets)
        sums = np.concatenate([[0.0], np.cumsum(odds[ids], dtype=np.float64)])
        per_word, per_n = (sums[ptr[1:]] - sums[ptr[:-1]])[inverse] + same * float(odds[_SAME]), np.diff(ptr)[inverse] + same
        total, n = (np.concatenate([[0], np.cumsum(x)]) for x in (per_word, per_n))
        z = (total[words.ptr[1:]] - total[words.ptr[:-1]]) / np.maximum(n[words.ptr[1:]] - n[words.ptr[:-1]], 1) + bias
        out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
    return np.concatenate(out)


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` (probability of label 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), *shared.value))], names=["doc_id", "score"])

    source = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(stream(run), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, *, text: str = "text") -> DataFrame:
    """The documents (all their columns) that the classifier doesn't reject; nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text=text)), docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(_scores(batch.column(at), *shared.value) >= threshold))

    return docs.mapInArrow(stream(run), docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
