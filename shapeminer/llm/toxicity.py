"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step is a word; its input is the word's own vector (words of the training sample that occur in some documents)
beside the mean of its hashed character trigrams' vectors. Every text is covered by overlapping windows of WINDOW
words; each is pooled by attention into a logit. A text's score is a logistic model, fitted on the sample, of its largest
logit and of how many and which share of its windows look toxic.
Training is multiple-instance: of a document only its strongest window, and some random ones of clean documents,
are learned from. The fit uses at most PER_CLASS documents of each class, of at most EXAMPLE_CHARS characters.

Null and empty texts have one empty window. Without labels of both classes every score is 0.5. Labels, lang,
source and doc_id are no inputs of a score. Repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, sigmoid, span_hashes, text_bytes, tidied, words
from .labelled import held_out, sample
from .recurrent import F32, Adam, gru, gru_back, gru_params, gru_step, init

PER_CLASS = 700
#: Characters of such a document at most; longer ones are scored like all, but are no examples.
EXAMPLE_CHARS = 30_000
WINDOW, STRIDE = 32, 16
DIM, HIDDEN, CHAR_BITS = 8, 8, 12


def _words(texts):
    data, offs = text_bytes(texts)
    data = LOWER[data]
    s, e, doc = words(data, offs, ALNUM)
    # trigrams of bytes around each byte of a word; 0 stands beyond its ends
    c = data.astype(np.uint32)
    before, after = np.r_[np.uint32(0), c[:-1]][: len(c)], np.r_[c[1:], np.uint32(0)][: len(c)]
    before[s], after[e - 1] = 0, 0
    tri = (((before * np.uint32(0x9E3779B1) ^ c) * np.uint32(0x85EBCA6B) ^ after) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CHAR_BITS)
    return span_hashes(data, s, e), tri, s, e, doc


def _words_in_parts(texts, size: int = 200):
    """_words of many texts, a part at a time."""
    out, chars = [], 0
    for lo in range(0, len(texts), size):
        h, tri, s, e, doc = _words(texts.slice(lo, size))
        out.append((h, tri, s + chars, e + chars, doc + lo))
        chars += len(tri)
    return tuple(np.concatenate(x) for x in zip(*out))


def _windows(doc: np.ndarray, n: int):
    """(first word, words, document) of all windows; the last of a long document is moved back to end with it."""
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    per = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, 1)
    d = np.repeat(np.arange(n), per)
    k = np.arange(len(d)) - np.repeat(np.cumsum(per) - per, per)
    at = np.minimum(k * STRIDE, np.maximum(count[d] - WINDOW, 0))
    return first[d] + at, np.minimum(count[d], WINDOW), d


class Net:
    def __init__(self, vocabulary: np.ndarray, prior: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        table = init(rng, len(vocabulary) + 1, DIM, scale=0.05)  # the last row: other words
        table[:-1, 0] = prior
        self.p = {"word": table, "char": init(rng, 1 << CHAR_BITS, DIM, scale=0.1)}
        for k in "fb":
            self.p |= gru_params(rng, k, 2 * DIM, HIDDEN)
        self.p |= {"A": init(rng, 2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, F32), "v": init(rng, HIDDEN), "u": init(rng, 2 * HIDDEN), "c": np.zeros(1, F32)}
        self.line = (np.array([1.0, 0.0, 0.0]), 0.0)

    def word_rows(self, h):
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary))

    def inputs(self, h, tri, s, e):
        if not len(h):
            return np.zeros((0, 2 * DIM), F32)
        out = np.empty((len(h), 2 * DIM), F32)
        for lo in range(0, len(h), 100_000):  # bounds what the characters' vectors take
            a, z, own = s[lo : lo + 100_000], e[lo : lo + 100_000], slice(lo, lo + 100_000)
            chars = np.concatenate([self.p["char"][tri[a[0] : z[-1]]], np.zeros((1, DIM), F32)])
            edges = np.empty(2 * len(a), np.int64)
            edges[0::2], edges[1::2] = a - a[0], z - a[0]
            out[own, :DIM] = self.p["word"][self.word_rows(h[own])]
            out[own, DIM:] = np.add.reduceat(chars, edges)[0::2] / (z - a)[:, None].astype(F32)
        return out

    def logits(self, X, first, count):
        """Of windows, with the input projections shared by all that hold a word."""
        p, N = self.p, len(first)
        if N:  # only the words that these windows hold
            lo = int(first.min())
            X, first = X[lo : int((first + count).max())], first - lo
        X = np.concatenate([X, np.zeros((1, 2 * DIM), F32)])
        states, full = [], int(count.min()) if N else 0
        for k, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            G, h, own = X @ p[k + "W"] + p[k + "b"], np.zeros((N, HIDDEN), F32), [None] * WINDOW
            for t in steps:
                at = first + t
                if t < full:
                    h = gru_step(G[at], h, p[k + "U"])[0]
                else:
                    real = t < count
                    h = np.where(real[:, None], gru_step(G[np.where(real, at, len(X) - 1)], h, p[k + "U"])[0], h)
                own[t] = h
            states.append(own)
        e = np.stack([np.tanh(np.concatenate([f, b], 1) @ p["A"] + p["a"]) @ p["v"] for f, b in zip(*states)])
        e[np.arange(WINDOW)[:, None] >= count[None, :]] = -1e9
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        w[:, count == 0] = 0
        u = p["u"]
        return sum(w[t] * (states[0][t] @ u[:HIDDEN] + states[1][t] @ u[HIDDEN:]) for t in range(WINDOW)) + p["c"][0]

    def learn(self, batch, opt):
        """One step on windows given as (word rows, trigrams, trigram starts, counts, first, count, y, weight)."""
        p = self.p
        rows, tri, start, per, first, count, y, weight = batch
        N, T = len(first), WINDOW
        mask = (np.arange(T)[:, None] < count[None, :]).astype(F32)
        at = np.minimum(first[None, :] + np.arange(T)[:, None], max(0, len(rows) - 1))
        Xw = np.concatenate([p["word"][rows], np.add.reduceat(p["char"][tri], start) / per[:, None].astype(F32)], 1)
        X = Xw[at] * mask[:, :, None]
        hf, kf = gru(X, mask, p["fW"], p["fb"], p["fU"])
        hb, kb = gru(X, mask, p["bW"], p["bb"], p["bU"], reverse=True)
        H = np.concatenate([hf, hb], 2)
        q = np.tanh(H @ p["A"] + p["a"])
        e = np.where(mask > 0, q @ p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w = w / w.sum(0) * (count > 0)
        pooled = (w[:, :, None] * H).sum(0)
        d = ((sigmoid(pooled @ p["u"] + p["c"][0]) - y) * weight).astype(F32) / N
        g = {"u": pooled.T @ d, "c": d.sum(keepdims=True)}
        dpool = d[:, None] * p["u"]
        dw = (H * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = (q * de[:, :, None]).sum((0, 1))
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"], g["a"] = H.reshape(T * N, -1).T @ dq.reshape(T * N, -1), dq.sum((0, 1))
        dH = w[:, :, None] * dpool + dq @ p["A"].T
        dXf, g["fW"], g["fb"], g["fU"] = gru_back(dH[:, :, :HIDDEN], X, mask, p["fW"], p["fb"], p["fU"], kf)
        dXb, g["bW"], g["bb"], g["bU"] = gru_back(dH[:, :, HIDDEN:], X, mask, p["bW"], p["bb"], p["bU"], kb, reverse=True)
        dX = (dXf + dXb) * mask[:, :, None]
        dXw = np.zeros_like(Xw)
        np.add.at(dXw, at.ravel(), dX.reshape(T * N, -1))
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], rows, dXw[:, :DIM])
        np.add.at(g["char"], tri, np.repeat(dXw[:, DIM:] / per[:, None].astype(F32), per, 0))
        opt.step(g)
        for k, v in p.items():
            if v.ndim == 2:
                v[:, k == "word" :] *= F32(1 - 2e-3)  # the words' prior is no weight

    def evidence(self, texts):
        """Per text: the largest window logit, the expected number of toxic windows (log) and their share."""
        h, tri, s, e, doc = _words(texts)
        first, count, d = _windows(doc, len(texts))
        X = self.inputs(h, tri, s, e)
        logit = np.concatenate([self.logits(X, first[lo : lo + 8192], count[lo : lo + 8192]) for lo in range(0, len(first), 8192)] or [np.zeros(0)])
        return _evidence(logit, d, len(texts))

    def score(self, texts):
        return sigmoid(self.evidence(texts) @ self.line[0] + self.line[1])


def _evidence(logit, d, n):
    top = np.full(n, -np.inf)
    np.maximum.at(top, d, logit)
    toxic = np.bincount(d, sigmoid(logit), minlength=n)
    return np.stack([np.clip(top, -12, 12), np.log1p(toxic), toxic / np.bincount(d, minlength=n)], 1)


def fit(examples: list[tuple[str, int]], *, rounds: int = 7, seed: int = 7) -> Net | None:
    """None without examples of both classes."""
    y = np.array([q for _, q in examples])
    if not len(y) or y.min() == y.max():
        return None
    h, tri, s, e, doc = _words_in_parts(pa.array([t for t, _ in examples], pa.string()))
    kinds, inverse = np.unique(h, return_inverse=True)
    pairs = np.unique(inverse * len(y) + doc)  # a word counts once in a document
    of, label = pairs // len(y), y[pairs % len(y)]
    pos, neg = (np.bincount(of, label == k, minlength=len(kinds)) for k in (1, 0))
    prior = np.log((pos + 0.5) / (y == 1).sum()) - np.log((neg + 0.5) / (y == 0).sum())
    prior *= (pos + neg) / (pos + neg + 10)  # few documents, perhaps copies of one, are weak evidence
    seen = pos + neg >= 5
    net = Net(kinds[seen], np.clip(prior[seen], -2, 4).astype(F32) / 2, seed)
    opt, rng = Adam(net.p, 1e-2), np.random.default_rng(seed)
    first, count, d = _windows(doc, len(y))
    rows = net.word_rows(h)
    bounds = np.searchsorted(d, np.arange(len(y) + 1))
    strength = np.r_[net.p["word"][:, 0]][rows] if len(rows) else np.zeros(0)
    total = np.r_[0, np.cumsum(np.maximum(strength, 0) ** 2)]
    logit = total[first + count] - total[first] if len(rows) else np.zeros(len(first))
    for r in range(rounds):
        best = np.array([lo + int(np.argmax(logit[lo:hi])) for lo, hi in zip(bounds[:-1], bounds[1:])])
        clean = np.flatnonzero(y[d] == 0)
        if r >= 2:  # a positive in which nothing stands out by now is taken for a labelling error
            best = best[(y == 0) | (logit[best] > 0)]
        some = np.r_[best, rng.choice(clean, min(len(clean), len(y)), replace=False)]
        for _ in range(3):
            order = rng.permutation(some)
            for lo in range(0, len(order), 256):
                net.learn(_batch_of(order[lo : lo + 256], rows, tri, s, e, first, count, y[d], rng, len(net.vocabulary)), opt)
        X = net.inputs(h, tri, s, e)
        logit = np.concatenate([net.logits(X, first[lo : lo + 8192], count[lo : lo + 8192]) for lo in range(0, len(first), 8192)])
    net.line = _calibrated(_evidence(logit, d, len(y)), y)
    return net


def _batch_of(picked, rows, tri, s, e, first, count, y, rng, other):
    at = np.concatenate([np.arange(first[k], first[k] + count[k]) for k in picked]) if len(picked) else np.zeros(0, np.int64)
    if not len(at):  # texts without words only
        at = np.zeros(1, np.int64)
        return np.zeros(1, np.int64), np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(len(picked), np.int64), np.zeros(len(picked), np.int64), y[picked], np.ones(len(picked))
    per = (e - s)[at]
    start = np.cumsum(per) - per
    chars = np.arange(per.sum()) - np.repeat(start, per) + np.repeat(s[at], per)
    n = count[picked]
    own = y[picked]
    weight = np.where(own == 1, 0.5 * len(own) / max(1, (own == 1).sum()), 0.5 * len(own) / max(1, (own == 0).sum()))
    held = rows[at].copy()
    held[rng.random(len(held)) < 0.2] = other  # so that the characters must carry words by themselves, too
    return held, tri[chars], start, per, np.cumsum(n) - n, n, own, weight


def _calibrated(x, y, steps: int = 60, ridge: float = 1.0):
    """Weights and shift of a logistic model over the columns of x, by Newton steps."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        q = sigmoid(z @ w)
        v = q * (1 - q) + 1e-6
        w = w - np.linalg.solve((z * v[:, None]).T @ z + keep, z.T @ (q - y) + keep @ w).clip(-2, 2)
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def score(docs: DataFrame, labels: DataFrame, *, label="toxic", id_col="doc_id", text_col="text", threshold: float = 0.7, per_class: int = PER_CLASS, example_chars: int = EXAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; predicted is 1 from `threshold` on."""
    model = fit(sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col, example_chars=example_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the sample's bound only

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                s = np.full(b.num_rows, 0.5) if shared.value is None else shared.value.score(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.asarray(s, np.float64))], names=["doc_id", "score"])

    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
