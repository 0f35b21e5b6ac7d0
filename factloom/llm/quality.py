"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: its words, pairs of neighbouring words (and
that a word follows itself), and the character n-grams of its words with their ends marked, all hashed to ``BUCKETS`` rows; a softmax layer gives
the two classes. Trained by stochastic gradient descent in numpy on the driver, on at most about
``2 * MOST_ROWS`` labelled rows (see textops.labelled_sample), each step on up to ``FEATURES_A_STEP``
features of a document drawn at random. As the model is linear above its vectors, scoring adds up one number
for each feature, over whole texts, in one pass without a shuffle.

Defined results: null and empty texts have no features and score by the bias alone; without labels of both
kinds the model scores 0.5 everywhere; repeated rows get equal scores; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import textops as ops

BUCKETS, DIM, NGRAMS = 1 << 18, 16, (3, 5)
MOST_ROWS, FEATURES_A_STEP, EPOCHS, RATE, BATCH = 2500, 400, 6, 0.5, 32
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features of a slice of texts: (buckets, for each text the range of its own)."""
    w = ops.Words(data, offsets, ops.WORD_WS)
    h = w.hashes()
    out = [((h >> _SHIFT).astype(np.int32), w.ptr)]
    at = ops.starts_of_runs(w.ptr, 2)
    out.append(((ops.sequence_hashes(h, 2)[at] >> _SHIFT).astype(np.int32), np.searchsorted(at, w.ptr)))
    # A word that follows itself is one feature more, whatever the word.
    twice = at[h[at] == h[at + 1]]
    out.append((np.zeros(len(twice), np.int32), np.searchsorted(twice, w.ptr)))
    # Texts with a space before, between and after: an n-gram may begin or end with a space, but hold none inside.
    n_docs = len(offsets) - 1
    padded = np.full(len(data) + n_docs + 1, 0x20, np.uint8)
    start = offsets[:-1] + np.arange(n_docs) + 1
    padded[np.arange(len(data)) + np.repeat(np.arange(n_docs) + 1, np.diff(offsets))] = data
    space = ops.WORD_WS[padded] == 0
    padded[space] = 0x20
    spaces = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    wide = padded.astype(np.uint64)
    for n in NGRAMS:
        if len(padded) < n:
            continue
        key = wide[: len(wide) - n + 1].copy()
        for i in range(1, n):
            key |= wide[i : len(wide) - n + 1 + i] << np.uint64(8 * i)
        ok = spaces[n - 1 : len(spaces) - 1] == spaces[1 : len(spaces) - n + 1]
        at = np.flatnonzero(ok)
        bucket = ((key[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT
        edges = np.searchsorted(at, np.concatenate([start - 1, [len(padded)]]))
        out.append((bucket.astype(np.int32), edges))
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number for each bucket and a bias: what a feature adds to the log-odds of label 1."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    own: list[np.ndarray] = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        own.append(np.concatenate([b for b, _ in _features(data, np.array([0, len(data)]))]))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # Both labels weigh the same in all.
    weight = (len(labels) / (2 * np.bincount(labels, minlength=2)))[labels].astype(np.float32)
    steps, step = EPOCHS * -(-len(own) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(own))
        for i in range(0, len(order), BATCH):
            rows = [r for r in order[i : i + BATCH].tolist() if len(own[r])]
            if not rows:
                continue
            drawn = [own[r] if len(own[r]) <= FEATURES_A_STEP else rng.choice(own[r], FEATURES_A_STEP) for r in rows]
            n = np.array([len(d) for d in drawn])
            ids = np.concatenate(drawn)
            mean = np.add.reduceat(vectors[ids], np.cumsum(n) - n, axis=0) / n[:, None]
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            y = labels[rows]
            p[np.arange(len(rows)), y] -= 1
            p *= weight[rows][:, None]
            rate = RATE * (1 - step / steps)
            back = (p @ out.T).astype(np.float32)
            out -= rate * (mean.T @ p) / len(rows) * 4
            bias -= rate * p.mean(axis=0)
            np.add.at(vectors, ids, np.repeat(-rate * back / n[:, None] * 4, n, axis=0).astype(np.float32))
            step += 1
    line = out[:, 1] - out[:, 0]
    return (vectors @ line).astype(np.float32), float(bias[1] - bias[0])


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None, name: str = "score", most_rows: int = MOST_ROWS) -> DataFrame:
    """The columns of ``keep`` (default: all) and ``name``, the probability of label 1."""
    spark = docs.sparkSession
    ops.bounded(spark)
    fit = ops.labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, most={0: most_rows, 1: most_rows})
    # One float for each bucket: a megabyte.
    sent = spark.sparkContext.broadcast(train(fit["text"].tolist(), fit["label"].to_numpy(np.int64)))

    def make():
        adds, bias = sent.value

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            data, offsets = ops.text_buffers(batch.column(text_col))
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for bucket, edges in _features(data, offsets):
                sums = np.concatenate([[0.0], np.cumsum(adds[bucket], dtype=np.float64)])
                total += sums[edges[1:]] - sums[edges[:-1]]
                count += np.diff(edges)
            return {name: 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))}

        return work

    return ops.map_text(docs, text_col, make, [(name, "double")], docs.columns if keep is None else keep)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents and labels."""
    scored = score_quality(ops.read(spark, sf_dir, "documents"), ops.read(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", (ops.id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (scored.score >= 0.5).cast("int").alias("predicted"))
