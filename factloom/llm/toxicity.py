"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words (runs of letters and digits, lower-cased) form overlapping windows of ``WINDOW`` words, one
every ``STRIDE`` (so that every passage of up to ``WINDOW - STRIDE + 1`` words lies whole in one); all are scored, and the document's score is that of its worst window. A word's input is a
learned vector for the word plus the mean of learned vectors for its character n-grams with marked ends,
both hashed, so unseen spellings share parts with seen ones. Within a slice of texts each distinct word's
input is projected once; the recurrence then runs over all windows of the slice together.

Trained on the driver on at most about ``MOST_ROWS`` labelled rows of each label (textops.labelled_sample):
first some windows of each document, drawn at random, take its label, later its worst window does (of documents
with label 0 the two worst, as all their windows must be clean).

Defined results: null texts, empty texts and texts without words score as an empty window; without labels of
both kinds the score is 0 everywhere; repeated rows get equal scores; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import textops as ops

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN, ATTENTION = 1 << 14, 1 << 14, 16, 8, 8
NGRAMS = (3, 4)
#: Rows of label 1 and of label 0; windows of a document in the first epochs; epochs; windows in a step.
MOST_ROWS, FIRST_WINDOWS, EPOCHS_FIRST, EPOCHS_WORST, BATCH, RATE = {1: 1000, 0: 3000}, 6, 2, 8, 512, 0.01
#: All windows of the fitting rows are scored in every so many epochs, else so many of each document.
ALL_EVERY, LEADING = 4, 8
_GROUP = 2048
Model = dict[str, np.ndarray]


# -- inputs ------------------------------------------------------------------------------------------------------


class Inputs:
    """The distinct words of a slice with their hashed parts, and its windows as rows of distinct words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = ops.LOWER[data]
        w = ops.Words(lower, offsets, ops.WORD_ALNUM)
        h, first, self.word_of = np.unique(w.hashes(), return_index=True, return_inverse=True) if len(w.start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.word_of = self.word_of.astype(np.int32)
        self.bucket = (h % np.uint64(WORD_BUCKETS)).astype(np.int32)
        start, end = w.start[first], w.end[first]
        size = end - start
        # The distinct words' bytes with a space on both sides of each.
        n = size + 2
        begin = np.cumsum(n) - n
        text = np.full(n.sum(), 0x20, np.uint8)
        inner = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text[inner] = lower[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        grams, owner = [], []
        for g in NGRAMS:
            count = np.maximum(n - g + 1, 1 if g == NGRAMS[0] else 0)
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            key = np.full(len(at), g, np.uint64)
            for i in range(g):
                key = key * np.uint64(0x100000001B3) + text[np.minimum(at + i, len(text) - 1)]
            grams.append((ops.mixed(key) % np.uint64(CHAR_BUCKETS)).astype(np.int32))
            owner.append(np.repeat(np.arange(len(n), dtype=np.int32), count))
        order = np.argsort(np.concatenate(owner), kind="stable") if owner else np.zeros(0, np.int64)
        self.grams = np.concatenate(grams)[order]
        self.gram_owner = np.concatenate(owner)[order]
        self.gram_count = np.bincount(self.gram_owner, minlength=len(n))
        # Windows: one every STRIDE words until the text's end is covered; a text without words has one, empty.
        words = np.diff(w.ptr)
        self.per_doc = 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE))
        nth = np.arange(self.per_doc.sum()) - np.repeat(np.cumsum(self.per_doc) - self.per_doc, self.per_doc)
        begin = np.minimum(nth * STRIDE, np.repeat(np.maximum(words - WINDOW, 0), self.per_doc))
        self.length = np.minimum(np.repeat(words, self.per_doc) - begin, WINDOW)
        self.first = begin + np.repeat(w.ptr[:-1], self.per_doc)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Distinct words of the given windows, -1 after their end."""
        at = self.first[which][:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < self.length[which][:, None]
        return np.where(inside, self.word_of[np.minimum(at, max(0, len(self.word_of) - 1))] if len(self.word_of) else -1, -1)


def embed(m: Model, x: Inputs) -> np.ndarray:
    """The input vector of each distinct word, and a last row of zeros for no word."""
    if not len(x.bucket):
        return np.zeros((1, DIM), np.float32)
    out = np.zeros((len(x.bucket) + 1, DIM), np.float32)
    end = np.cumsum(x.gram_count)
    for i in range(0, len(x.bucket), _GROUP):
        n = x.gram_count[i : i + _GROUP]
        first = end[i] - n[0]
        own = m["chars"][x.grams[first : end[i + len(n) - 1]]]
        out[i : i + len(n)] = m["words"][x.bucket[i : i + _GROUP]] + np.add.reduceat(own, np.cumsum(n) - n, axis=0) / n[:, None]
    return out


# -- the network -------------------------------------------------------------------------------------------------


def new_model(seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    m = {"words": rng.uniform(-0.3, 0.3, (WORD_BUCKETS, DIM)).astype(np.float32), "chars": rng.uniform(-0.3, 0.3, (CHAR_BUCKETS, DIM)).astype(np.float32)}
    for d in "fb":
        m |= {f"W{d}": normal(DIM, 3 * HIDDEN), f"U{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"A": normal(2 * HIDDEN, ATTENTION), "a": normal(ATTENTION), "o": normal(2 * HIDDEN), "c": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(m: Model, vectors: np.ndarray, rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Log-odds of each window; ``rows`` index vectors, -1 (the zero vector) where there is no word."""
    n, t = rows.shape
    there = (rows >= 0).T
    full = bool(there.all())
    states = np.empty((t, n, 2 * HIDDEN), np.float32)
    kept = {}
    for d, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
        given = vectors @ m[f"W{d}"] + m[f"b{d}"]
        h = np.zeros((n, HIDDEN), np.float32)
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        log = []
        for i in order:
            x = given[rows[:, i]]
            u = h @ m[f"U{d}"]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            un = u[:, 2 * HIDDEN :]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * un)
            after = new + z * (h - new)
            if not full:
                after = np.where(there[i][:, None], after, h)
            if keep:
                log.append((i, h, z, r, un, new))
            h = after
            states[i, :, side] = h
        kept[d] = log
    hidden = np.tanh(states @ m["A"])
    weight = hidden @ m["a"]
    if not full:
        weight[~there] = -1e9
    weight = np.exp(weight - weight.max(axis=0))
    if not full:
        weight[~there] = 0
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ m["o"] + m["c"][0], (rows, there, states, hidden, weight, pooled, kept)


def _by_row(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows ``at``, and for each the sum of its values."""
    if not len(at):
        return at, values
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(values[order], first, axis=0)


def backward(m: Model, vectors: np.ndarray, memory: tuple, d_logit: np.ndarray) -> tuple[Model, np.ndarray]:
    """Gradients of the network's weights and of the input vectors."""
    rows, there, states, hidden, weight, pooled, kept = memory
    g: Model = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * m["o"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_hidden = d_score[:, :, None] * m["a"] * (1 - hidden**2)
    g["a"] = np.einsum("tn,tna->a", d_score, hidden)
    g["A"] = np.einsum("tnh,tna->ha", states, d_hidden)
    d_states += d_hidden @ m["A"].T
    d_vectors = np.zeros_like(vectors)
    for d in "fb":
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        gU, gx = np.zeros_like(m[f"U{d}"]), np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        steps = np.empty((rows.shape[1], rows.shape[0], 3 * HIDDEN), np.float32)
        dh = np.zeros((rows.shape[0], HIDDEN), np.float32)
        for i, h, z, r, un, new in reversed(kept[d]):
            dh = dh + d_states[i, :, side]
            on = there[i][:, None]
            d_new = dh * (1 - z) * (1 - new**2) * on
            d_z = dh * (h - new) * z * (1 - z) * on
            d_r = d_new * un * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            gU += h.T @ d_u
            steps[i] = d_x
            dh = np.where(on, dh * z, dh) + d_u @ m[f"U{d}"].T
        at, total = _by_row(rows.T.reshape(-1), steps.reshape(-1, 3 * HIDDEN))
        gx[at] = total
        gx[-1] = 0  # the place of no word
        g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = gU, vectors.T @ gx, gx.sum(axis=0)
        d_vectors += gx @ m[f"W{d}"].T
    return g, d_vectors


def _logits(m: Model, vectors: np.ndarray, x: Inputs, only: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of all windows of a slice (or of those of ``only``), some thousand at a time; full ones apart, which need no masks."""
    only = np.arange(len(x.first)) if only is None else only
    out = np.empty(len(only))
    for mine in (np.flatnonzero(x.length[only] == WINDOW), np.flatnonzero(x.length[only] < WINDOW)):
        for i in range(0, len(mine), _GROUP):
            part = only[mine[i : i + _GROUP]]
            rows = x.rows(part)
            rows = rows[:, : max(1, int(x.length[part].max()))]
            out[mine[i : i + _GROUP]] = forward(m, vectors, rows)[0]
    return out


def _worst(logits: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(logits, np.cumsum(per_doc) - per_doc) if len(per_doc) else np.zeros(0)


def scores(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text of a slice."""
    x = Inputs(data, offsets)
    return 1 / (1 + np.exp(-_worst(_logits(m, embed(m, x), x), x.per_doc)))


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model | None:
    """The model for these texts; None if they don't have both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    m = new_model(seed)
    raw = [t.encode() for t in texts]
    x = Inputs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    doc = np.repeat(np.arange(len(raw)), x.per_doc)
    end = np.cumsum(x.per_doc)
    first = np.cumsum(x.gram_count) - x.gram_count
    moments: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.items()}
    steps = {"n": 0}

    def learn(which: np.ndarray, target: np.ndarray) -> None:
        size = max(16, min(BATCH, len(which) // 24))  # few rows still make some steps an epoch
        for i in range(0, len(which), size):
            part = which[i : i + size]
            rows = x.rows(part)
            used, at = np.unique(rows[rows >= 0], return_inverse=True)
            rows[rows >= 0] = at
            n = x.gram_count[used]
            grams = x.grams[np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(used) else np.zeros(0, np.int64)
            sums = np.add.reduceat(m["chars"][grams], np.cumsum(n) - n, axis=0) / n[:, None] if len(used) else np.zeros((0, DIM))
            vectors = np.concatenate([m["words"][x.bucket[used]] + sums, np.zeros((1, DIM))]).astype(np.float32)
            logit, memory = forward(m, vectors, rows, keep=True)
            d = (1 / (1 + np.exp(-logit)) - target[i : i + size]) / len(part)
            g, dv = backward(m, vectors, memory, d.astype(np.float32))
            steps["n"] += 1
            # Of the two tables only the rows that were used have gradients, and only they are updated.
            tables = {"words": _by_row(x.bucket[used], dv[:-1]), "chars": _by_row(grams, np.repeat(dv[:-1] / np.maximum(n, 1)[:, None], n, axis=0))}
            for k, (at, own) in (tables | {k: (slice(None), v) for k, v in g.items()}).items():  # Adam
                a, b = moments[k]
                a[at] += 0.1 * (own - a[at])
                b[at] += 0.001 * (own**2 - b[at])
                m[k][at] -= (RATE * (a[at] / (1 - 0.9 ** steps["n"])) / (np.sqrt(b[at] / (1 - 0.999 ** steps["n"])) + 1e-8)).astype(np.float32)

    for _ in range(EPOCHS_FIRST):
        drawn = [rng.choice(np.arange(b - n, b), min(n, FIRST_WINDOWS), replace=False) for b, n in zip(end, x.per_doc, strict=True)]
        some = rng.permutation(np.concatenate(drawn))
        learn(some, labels[doc[some]].astype(np.float32))
    order, start = np.arange(len(doc)), end - x.per_doc
    for epoch in range(EPOCHS_WORST):
        vectors = embed(m, x)
        if epoch % ALL_EVERY == 0:
            logits = _logits(m, vectors, x)
        else:  # between, the windows that ranked highest when all were scored last
            leading = order[np.arange(len(doc)) - np.repeat(start, x.per_doc) < LEADING]
            logits[leading] = _logits(m, vectors, x, leading)
        order = np.lexsort((-logits, doc))
        rank = np.arange(len(doc)) - np.repeat(start, x.per_doc)
        worst = rng.permutation(order[(rank == 0) | (rank == 1) & (labels[doc[order]] == 0)])
        learn(worst, labels[doc[worst]].astype(np.float32))
    return m


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None, name: str = "score", most_rows: dict[int, int] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all) and ``name``, 0 to 1, for label 1."""
    spark = docs.sparkSession
    ops.bounded(spark)
    fit = ops.labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, most=most_rows or MOST_ROWS)
    # About two megabytes of weights, whatever the input.
    sent = spark.sparkContext.broadcast(train(fit["text"].tolist(), fit["label"].to_numpy(np.int64)))

    def make():
        m = sent.value

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            if m is None:
                return {name: np.zeros(batch.num_rows)}
            return {name: scores(m, *ops.text_buffers(batch.column(text_col)))}

        return work

    return ops.map_text(docs, text_col, make, [(name, "double")], docs.columns if keep is None else keep)


THRESHOLD = 0.7


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents and labels."""
    scored = score_toxicity(ops.read(spark, sf_dir, "documents"), ops.read(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", (ops.id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (scored.score >= THRESHOLD).cast("int").alias("predicted"))
