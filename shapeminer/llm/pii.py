"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF, trained in numpy.

Every character of every text is read. Texts are cut into overlapping windows; each character takes its emissions from
the window in which it lies most centrally, so windows are reconciled before anything is decided. The CRF then decodes
the text as a whole: a bound on what any run of tags could gain shows most characters to be outside of spans for sure,
and the stretches between those are decoded exactly. Base spans are always kept; model spans that touch none of them
are added.

Labelled spans for the fit: base spans in at most SAMPLE texts of at most `example_chars` characters (longer texts are
no examples, but are scored like all), and written variants of them (national phone forms, spelt-out at signs, dotted
cards) beside look-alikes without meaning (dates, versions, prices), which the generator sets into those texts.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows give equal results, an
empty table none; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, tidied
from .recurrent import F32, Adam, init, lstm, lstm_back, lstm_params

KINDS = ("email", "ip", "card", "phone")
SAMPLE, WINDOW, CONTEXT, DIM, HIDDEN = 400, 448, 24, 12, 8
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
EXAMPLE = 96  # characters of a window for the fit
_OTHER, _EDGE = 128, 129  # codes of characters beyond ASCII, and of none

_TRIGGER = re.compile("[0-9@]")
_AT = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails from a number's first digit fails from its others, too
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the leftmost non-overlapping matches of each kind that pass its test."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for k, pattern, least, most in ((2, _CARD, 12, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (k != 2 or luhn(digits)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.minimum(c, _OTHER).astype(np.uint8)


def allowed() -> np.ndarray:
    """What is added to the transitions: an I tag follows its own kind's tags only."""
    out = np.zeros((TAGS, TAGS), F32)
    for k in range(len(KINDS)):
        out[[t for t in range(TAGS) if t not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4
    return out


def windows(counts: np.ndarray):
    """(first, end, own first, own end) of the windows over texts that stand one after the other, with these numbers
    of characters. A window owns what lies at least CONTEXT from its ends, or where the text ends."""
    step = WINDOW - 2 * CONTEXT
    per = np.where(counts > WINDOW, -(-(counts - 2 * CONTEXT) // step), np.minimum(counts, 1))
    of = np.repeat(np.arange(len(counts)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    base, n, last = (np.cumsum(counts) - counts)[of], counts[of], k == per[of] - 1
    first, end = k * step, np.where(last, n, k * step + WINDOW)
    return base + first, base + end, base + np.where(k > 0, first + CONTEXT, 0), base + np.where(last, n, end - CONTEXT)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(E, tags, mask, A):
    """(loss, dE, dA) of tag sequences (T, N) under emissions E and transitions A; padding at the ends only."""
    T, N, K = E.shape
    a, b = np.empty_like(E), np.zeros_like(E)
    a[0] = E[0]
    for t in range(1, T):
        a[t] = np.where(mask[t][:, None] > 0, _lse(a[t - 1][:, :, None] + A, 1) + E[t], a[t - 1])
    for t in range(T - 2, -1, -1):
        b[t] = np.where(mask[t + 1][:, None] > 0, _lse(A + (E[t + 1] + b[t + 1])[:, None, :], 2), b[t + 1])
    z = _lse(a[-1], 1)
    p = np.exp(a + b - z[:, None]) * mask[:, :, None]
    pair = np.exp(a[:-1, :, :, None] + A + (E + b)[1:, :, None, :] - z[:, None, None]) * mask[1:, :, None, None]
    t, n = np.nonzero(mask)
    gold = E[t, n, tags[t, n]].sum()
    dE, dA = p, pair.sum((0, 1))
    dE[t, n, tags[t, n]] -= 1
    t, n = np.nonzero(mask[1:])
    gold += A[tags[t, n], tags[t + 1, n]].sum()
    np.add.at(dA, (tags[t, n], tags[t + 1, n]), -1)
    return (z.sum() - gold) / N, (dE / N).astype(F32), (dA / N).astype(F32)


def viterbi(E, count, A, start=None, end=None):
    """The best tag sequences (T, N); start and end (N, K) are added at the ends of the sequences."""
    T, N, K = E.shape
    best, back = E[0] + (0 if start is None else start), np.zeros((T, N, K), np.int8)
    for t in range(1, T):
        step = best[:, :, None] + A
        arg = step.argmax(1)
        new = np.take_along_axis(step, arg[:, None, :], 1)[:, 0] + E[t]
        real = (t < count)[:, None]
        back[t] = np.where(real, arg, np.arange(K))
        best = np.where(real, new, best)
    out = np.zeros((T, N), np.int8)
    out[-1] = (best if end is None else best + end).argmax(1)
    for t in range(T - 1, 0, -1):
        out[t - 1] = back[t][np.arange(N), out[t]]
    return out


def surely_outside(E: np.ndarray, A: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of texts that stand one after the other: where the best tag sequence has O for sure.

    A span of a kind begins with its B tag and goes on with its I tags. Against O in its place it gains a sum over its
    characters, and at most `enter` and `leave` where it begins and ends. Where no span of any kind that holds a
    character could gain, the best sequence has none there.
    """
    out, E = np.ones(len(E), bool), np.ascontiguousarray(E.T)
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    for k in range(len(KINDS)):
        B, I = 1 + 2 * k, 2 + 2 * k
        enter = max(float((A[:, B] - A[:, 0]).max()), 0.0)
        following = [t for t in range(TAGS) if t != I]
        leave = max(float((A[[B, I]][:, following] - A[0, following]).max()), 0.0)
        more = E[I].astype(np.float64) - E[0] + max(A[B, I], A[I, I]) - A[0, 0]
        more[firsts] = -1e6  # no span goes on from one text to the next
        total = np.cumsum(more)
        here = np.maximum.accumulate(E[B] - E[0] - total) + total  # the best that begins at or before each
        rest = np.maximum.accumulate(total[::-1])[::-1] - total  # and goes on after it
        out &= enter + leave + here + rest < -1e-3
    return out


class Tagger:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"emb": init(rng, _EDGE + 1, DIM, scale=0.5)}
        for k in "fb":
            self.p |= lstm_params(rng, k, DIM, HIDDEN)
        self.p |= {"O": init(rng, 2 * HIDDEN, TAGS), "o": np.zeros(TAGS, F32), "A": np.zeros((TAGS, TAGS), F32)}

    def _run(self, codes, mask, keep):
        p, X = self.p, self.p["emb"][codes]
        f, kf = lstm(X, mask, p["fW"], p["fb"], p["fU"], keep=keep)
        b, kb = lstm(X, mask, p["bW"], p["bb"], p["bU"], reverse=True, keep=keep)
        H = np.concatenate([f, b], 2)
        return X, H, H @ p["O"] + p["o"], kf, kb

    def learn(self, codes, tags, mask, opt):
        p = self.p
        X, H, E, kf, kb = self._run(codes, mask, True)
        loss, dE, dA = crf_loss(E, tags, mask, self.transitions())
        flat = dE.reshape(-1, TAGS)
        g = {"A": dA, "O": H.reshape(-1, 2 * HIDDEN).T @ flat, "o": flat.sum(0)}
        dH = dE @ p["O"].T
        dXf, g["fW"], g["fb"], g["fU"] = lstm_back(dH[:, :, :HIDDEN], X, mask, p["fW"], p["fb"], p["fU"], kf)
        dXb, g["bW"], g["bb"], g["bU"] = lstm_back(dH[:, :, HIDDEN:], X, mask, p["bW"], p["bb"], p["bU"], kb, reverse=True)
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], codes.ravel(), ((dXf + dXb) * mask[:, :, None]).reshape(-1, DIM))
        opt.step(g)
        return loss

    def transitions(self) -> np.ndarray:
        return self.p["A"] + allowed()

    def _states(self, codes: np.ndarray, k: str):
        """Yields the states of one direction (HIDDEN, N), step by step, of codes (T, N) in its order."""
        # sigmoid(x) is tanh(x / 2) / 2 + 1/2, so one tanh serves all gates
        half = np.r_[np.full(3 * HIDDEN, 0.5, F32), np.ones(HIDDEN, F32)]
        table, U = (self.p["emb"] @ self.p[k + "W"] + self.p[k + "b"]) * half, np.ascontiguousarray((self.p[k + "U"] * half).T)
        N = codes.shape[1]
        h, c, tc = (np.zeros((HIDDEN, N), F32) for _ in range(3))
        x, g = np.empty((N, 4 * HIDDEN), F32), np.empty((4 * HIDDEN, N), F32)
        ifo, i, f, o, u = g[: 3 * HIDDEN], g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN : 3 * HIDDEN], g[3 * HIDDEN :]
        for row in codes:
            np.take(table, row, 0, x, "clip")
            np.dot(U, h, g)
            g += x.T
            np.tanh(g, g)
            ifo *= 0.5
            ifo += 0.5
            u *= i
            c *= f
            c += u
            np.tanh(c, tc)
            np.multiply(o, tc, h)
            yield h

    def emissions(self, codes: np.ndarray, counts: np.ndarray, most: int = 512) -> np.ndarray:
        """(characters, TAGS) of texts that stand one after the other."""
        E = np.zeros((len(codes), TAGS), F32)
        places = windows(counts)
        order = np.argsort(places[1] - places[0], kind="stable")
        codes = np.r_[codes, np.uint8(_EDGE)]
        for lo in range(0, len(order), most):
            a, z, p, q = (x[order[lo : lo + most]] for x in places)
            T = int((z - a).max())
            t = np.arange(T)[:, None]
            Z, step = np.empty((len(a), T, TAGS), F32), np.empty((len(a), TAGS), F32)
            for k, at in (("f", a + t), ("b", z - 1 - t)):
                O = np.ascontiguousarray(self.p["O"][:HIDDEN] if k == "f" else self.p["O"][HIDDEN:])
                for j, h in enumerate(self._states(codes[np.where((at >= a) & (at < z), at, len(codes) - 1)], k)):
                    np.dot(h.T, O, step)
                    Z[:, j] = step
                for one, a1, z1, p1, q1 in zip(Z, a.tolist(), z.tolist(), p.tolist(), q.tolist()):
                    E[p1:q1] += one[p1 - a1 : q1 - a1] if k == "f" else one[z1 - q1 : z1 - p1][::-1]
        return E + self.p["o"]

    def tags(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best tag sequence of each of the texts that stand one after the other, decoded as a whole."""
        E, A = self.emissions(codes, counts), self.transitions()
        open_ = ~surely_outside(E, A, counts)
        out = np.zeros(len(codes), np.int8)
        edge = np.zeros(len(codes) + 1, bool)
        edge[np.cumsum(counts)] = edge[0] = True
        begins = np.flatnonzero(open_ & (edge[:-1] | ~np.r_[False, open_[:-1]]))
        ends = np.flatnonzero(open_ & (edge[1:] | ~np.r_[open_[1:], False])) + 1
        order = np.argsort(ends - begins, kind="stable")
        lo = 0
        while lo < len(order):  # stretches of like length together
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and (hi - lo + 1) * (ends - begins)[order[hi]] <= 40_000:
                hi += 1
            b, e = begins[order[lo:hi]], ends[order[lo:hi]]
            at = b + np.arange(int((e - b).max()))[:, None]
            first, last = A[0] * ~edge[b][:, None], A[:, 0] * ~edge[e][:, None]
            first[:, 2::2] = -1e4  # at a text's beginning, too, an I tag follows nothing
            best = viterbi(E[np.minimum(at, len(E) - 1)], e - b, A, first, last)
            real = at < e
            out[at[real]] = best[real]
            lo = hi
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text its spans, read off its tags as (start, kind, end)."""
        counts = np.array([len(t) for t in texts], np.int64)
        tags = self.tags(_codes("".join(texts)), counts)
        begins = np.cumsum(counts) - counts
        out: list[list] = [[] for _ in texts]
        heads = np.flatnonzero(tags % 2 == 1)
        of = np.searchsorted(begins, heads, "right") - 1
        stops = np.flatnonzero((tags == 0) | (tags % 2 == 1))
        nexts = np.r_[stops, len(tags)][np.searchsorted(stops, heads, "right")] if len(heads) else heads
        for s, k, e in zip(heads.tolist(), of.tolist(), nexts.tolist()):
            out[k].append((s - int(begins[k]), (int(tags[s]) - 1) // 2, min(e, int(begins[k] + counts[k])) - int(begins[k])))
        return out


def _padded(pieces):
    count = np.array([len(x) for x in pieces])
    codes = np.full((max(1, count.max()), len(pieces)), _EDGE, np.int64)
    for j, x in enumerate(pieces):
        codes[: len(x), j] = x
    return codes, (np.arange(len(codes))[:, None] < count).astype(F32), count


def _digits(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng, sep):
    d = "4" + _digits(rng, 14)
    d += next(str(c) for c in range(10) if luhn(d + str(c)))
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def _word(rng):
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))


def planted(rng) -> tuple[str, int | None]:
    """A written form and its kind; None for a look-alike."""
    d, w = lambda n: _digits(rng, n), lambda: _word(rng)
    forms = (
        lambda: (f"{w()}.{d(2)}@{w()}.{w()}.com", 0), lambda: (f"{w()}@{w()}.org", 0), lambda: (f"{w()}[at]{w()}.com", 0), lambda: (f"{w()}.{w()} (at) {w()}.net", 0),
        lambda: (f"{w()} [ at ] {w()}.com", 0), lambda: (f"{w()}{{at}}{w()}.org", 0), lambda: (f"{w()}<at>{w()}.com", 0), lambda: (f"{w()} at {w()} dot com", 0), lambda: (f"{w()}.{w()} at {w()} dot org", 0), lambda: (f"{w()} (at) {w()} (dot) net", 0), lambda: (f"{w()} at {w()}", None),
        lambda: (".".join(str(x) for x in rng.integers(1, 256, 4)), 1),
        lambda: (_card(rng, ""), 2), lambda: (_card(rng, " "), 2), lambda: (_card(rng, "-"), 2), lambda: (_card(rng, "."), 2),
        lambda: (f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", 3), lambda: (f"+{d(2)} {d(3)} {d(3)} {d(4)}", 3), lambda: (f"({d(3)}) {d(3)}-{d(4)}", 3), lambda: (f"{d(3)}-{d(3)}-{d(4)}", 3), lambda: (f"{d(3)}.{d(3)}.{d(4)}", 3),
        lambda: (f"20{d(2)}-0{d(1)}-1{d(1)}", None), lambda: (f"v{d(1)}.{d(2)}.{d(1)}", None), lambda: (f"${d(3)}.{d(2)}", None), lambda: (d(int(rng.integers(1, 7))), None), lambda: (f"{d(2)}:{d(2)}", None), lambda: (f"20{d(2)}", None), lambda: ("".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 24)), None), lambda: (f"@{w()}", None), lambda: (f"token = {w()}{d(6)}{w()}", None),
    )
    return forms[rng.integers(len(forms))]()


def fit(texts: list[str], *, seed: int = 5, examples: int = 5000, epochs: int = 10) -> Tagger:
    rng, net = np.random.default_rng(seed), Tagger()
    fill = [t for t in texts if len(t) > 40] or [" ".join(_word(rng) for _ in range(60))]
    # windows at any place of the texts: one half of those with digits or at signs, one half of all
    every = [(k, lo) for k, t in enumerate(texts) for lo in range(0, len(t), EXAMPLE // 2)]
    some = [w for w in every if _TRIGGER.search(texts[w[0]], w[1], w[1] + EXAMPLE)]
    spans, made = {}, []
    for of in (some, every):
        for j in rng.permutation(len(of))[: examples // 4]:
            k, lo = of[j]
            own = spans[k] if k in spans else spans.setdefault(k, base_spans(texts[k]))
            piece = texts[k][lo : lo + EXAMPLE]
            made.append((piece, [(max(s, lo) - lo, kind, min(e - lo, len(piece))) for s, kind, e in own if s < lo + EXAMPLE and e > lo]))
    while len(made) < examples:
        t = fill[rng.integers(len(fill))]
        at = int(rng.integers(0, max(1, len(t) - EXAMPLE)))
        left, right, (form, kind) = t[at : at + 40], t[at + 40 : at + 80], planted(rng)
        left += "" if left.endswith((" ", "\n")) else " "
        left += str(rng.choice(["", "", "", "<", "|", "\t"]))
        end = "".join(rng.choice(["", ".", ",", "###", "&&&", ")", "\r\n", "\t", "|", ">"], 1))
        piece = (left + form + end + " " + right)[:EXAMPLE]
        here = [(len(left), kind, min(EXAMPLE, len(left) + len(form)))] if kind is not None else []
        made.append((piece, sorted(here + [x for x in base_spans(piece) if not here or x[2] <= here[0][0] or x[0] >= here[0][2]])))
    opt, size = Adam(net.p, 1e-2), 64
    for epoch in range(epochs):
        opt.rate = 1e-2 * 0.75**epoch
        order = rng.permutation(len(made))
        for lo in range(0, len(order), size):
            own = [made[k] for k in order[lo : lo + size]]
            codes, mask, _ = _padded([_codes(t) for t, _ in own])
            tags = np.zeros(codes.shape, np.int64)
            for j, (_, spans) in enumerate(own):
                for s, k, e in spans:
                    tags[s:e, j] = 2 + 2 * k
                    tags[s, j] = 1 + 2 * k
            net.learn(codes.astype(np.int64), tags, mask, opt)
    return net


def merged(base, found, text: str):
    """Base spans, and those found that touch none of them, end where words do and hold enough digits; a card's
    must pass its test, an address must have an at of some form."""
    out = list(base)
    for s, k, e in found:
        least = (6, 7, 12, 7)[k]
        digits = _NOT_DIGIT.sub("", text[s:e])
        whole = not (text[max(s, 1) - 1 : s].isalnum() or text[e : e + 1].isalnum())
        told = bool(_AT.search(text, s, e)) if k == 0 else len(digits) >= (0, 4, 12, 7)[k]
        if whole and told and e - s >= least and (k != 2 or luhn(digits)) and not any(s < be and bs < e for bs, _, be in base):
            out.append((s, k, e))
    return sorted(out)


def sample(docs: DataFrame, text_col: str, most: int = SAMPLE, example_chars: int = 20_000) -> list[str]:
    """At most `most` whole texts that hold digits or at signs and at most `example_chars` characters, those with the
    smallest text hashes."""
    some = docs.select(docs[text_col].alias("t")).where(f"t rlike '[0-9@]' and length(t) <= {example_chars}").select("t", F.xxhash64("t").alias("h"))
    last = some.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = some.where(F.col("h") <= last).groupBy("h").agg(F.first("t").alias("t")).collect()  # no text but these is sent
    return [r.t for r in sorted(rows, key=lambda r: r.h)]


def detect(docs: DataFrame, *, id_col="doc_id", text_col="text", model: Tagger | None = None, example_chars: int = 20_000) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans as text, and how many the model added."""
    model = model or fit(sample(docs, text_col, example_chars=example_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text", 1 << 19):
                texts = [t or "" for t in b.column("text").to_pylist()]
                base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
                every = [merged(x, y, t) for x, y, t in zip(base, shared.value.spans(texts), texts)]
                count = [[sum(x[1] == k for x in spans) for spans in base] for k in range(len(KINDS))]
                sha = [hashlib.sha256(text_of(x).encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(sha), pa.array([text_of(x) for x in every]), pa.array([len(x) - len(y) for x, y in zip(every, base)], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), schema)
