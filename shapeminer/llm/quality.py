"""Quality classifier: naive Bayes support vector machine (Wang and Manning, 2012).

Features are hashed indicators of word n-grams (1 and 2) and word-shape n-grams (1 to 3). Each is scaled by its
class log-count ratio; a linear hinge-loss model is then fitted by dual coordinate descent (Hsieh et al., 2008)
and interpolated with the ratios' mean. The fit uses at most PER_CLASS labelled documents of each class, of at most
EXAMPLE_CHARS characters; every whole text is scored, in the task that reads it.

Null and empty texts have no features and score by the bias. Without labels of both classes every score is 0.5.
Labels, lang, source and doc_id are no inputs of a score. Repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, filter_rows, gram_hashes, mix, sigmoid, span_hashes, text_bytes, tidied, words
from .labelled import held_out, sample

#: Labelled documents of each class that are fitted at most.
PER_CLASS = 1200
#: Characters of such a document at most; longer ones are scored like all, but are no examples.
EXAMPLE_CHARS = 30_000
BITS = 18
#: Byte classes of a word's shape: lower, upper, digit, non-ASCII; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 1


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of the indicators, distinct and sorted."""
    data, offs = text_bytes(texts)
    s, e, doc = words(data, offs, NOT_SPACE)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z
    shape = _SHAPE[data]
    # a shape keeps one byte of every run of equal classes within a word
    run = np.ones(len(data), bool)
    run[1:] = shape[1:] != shape[:-1]
    run[s] = True
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    run &= np.cumsum(inside[:-1]).astype(bool)
    at = np.r_[0, np.cumsum(run)]
    form = span_hashes(shape[run], at[s], at[e])
    word = span_hashes(data, s, e)
    keys = []
    for kind, (h, orders) in enumerate(((word, (1, 2)), (form, (1, 2, 3)))):
        for n in orders:
            g = gram_hashes(h, n)
            whole = doc[: len(g)] == doc[n - 1 :]
            f = (mix(g[whole] + np.uint64(8 * kind + n)) >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append(doc[: len(whole)][whole] << BITS | f)
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def log_count_ratios(doc, feat, y, alpha: float = 1.0) -> np.ndarray:
    pos = np.bincount(feat[y[doc] > 0], minlength=1 << BITS) + alpha
    neg = np.bincount(feat[y[doc] < 0], minlength=1 << BITS) + alpha
    return np.log(pos / (y > 0).sum()) - np.log(neg / (y < 0).sum())


def dual_coordinate_descent(rows, y, size: int, *, cost: float = 1.0, weights=None, epochs: int = 30, tol: float = 1e-3, seed: int = 0):
    """Linear L1-loss support vector machine; rows are (indices, values). The last coordinate is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1 for _, v in rows])
    upper = cost * (np.ones(len(rows)) if weights is None else weights)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            grad = y[k] * (w[i] @ v + w[-1]) - 1
            step = np.clip(alpha[k] - grad / norm[k], 0, upper[k]) - alpha[k]
            if step:
                most = max(most, abs(step))
                alpha[k] += step
                w[i] += step * y[k] * v
                w[-1] += step * y[k]
        if most < tol:
            break
    return w


def fit(examples: list[tuple[str, int]], *, beta: float = 0.9) -> tuple[np.ndarray, float, float] | None:
    """(weight of each feature, bias, slope of the score); None without examples of both classes."""
    y = np.array([1.0 if q else -1.0 for _, q in examples])
    if not len(y) or abs(y.sum()) == len(y):
        return None
    parts = [features(pa.array([t for t, _ in examples[lo : lo + 200]], pa.string())) for lo in range(0, len(examples), 200)]
    doc, feat = (np.concatenate(x) for x in zip(*((d + 200 * k, f) for k, (d, f) in enumerate(parts))))
    ratio = log_count_ratios(doc, feat, y)
    bounds = np.searchsorted(doc, np.arange(len(y) + 1))
    rows = []
    for k in range(len(y)):
        i = feat[bounds[k] : bounds[k + 1]]
        rows.append((i, ratio[i] / np.sqrt(max(1, len(i)))))
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    w = dual_coordinate_descent(rows, y, 1 << BITS, weights=len(y) / (2 * share))
    mean = np.abs(w[:-1]).mean()
    final = ((1 - beta) * mean + beta * w[:-1]) * ratio
    return final.astype(np.float32), float(w[-1]) * beta, 4.0


def _scores(model, texts) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    w, bias, slope = model
    doc, feat = features(texts)
    n = np.bincount(doc, minlength=len(texts))
    return sigmoid(slope * (np.bincount(doc, w[feat], minlength=len(texts)) / np.sqrt(np.maximum(n, 1)) + bias))


def _fitted(docs, labels, label, per_class, example_chars, id_col="doc_id", text_col="text"):
    model = fit(sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col, example_chars=example_chars))
    return docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats at most


def accepted(docs: DataFrame, labels: DataFrame, *, label="quality", threshold: float = 0.5, per_class: int = PER_CLASS, example_chars: int = EXAMPLE_CHARS) -> DataFrame:
    """The rows of docs, whole, that score at least `threshold`."""
    shared = _fitted(docs, labels, label, per_class, example_chars)
    return filter_rows(docs, lambda b: _scores(shared.value, b.column("text")) >= threshold)


def score(docs: DataFrame, labels: DataFrame, *, label="quality", id_col="doc_id", text_col="text", threshold: float = 0.5, per_class: int = PER_CLASS, example_chars: int = EXAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; predicted is 1 from `threshold` on."""
    shared = _fitted(docs, labels, label, per_class, example_chars, id_col, text_col)

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(shared.value, b.column("text")))], names=["doc_id", "score"])

    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
