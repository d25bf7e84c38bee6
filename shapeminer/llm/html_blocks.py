"""Main text of HTML pages by a recurrent block labeller.

A page is cut into its leaf blocks: the text runs between block-level tags, with the path of open elements. Each
block's vector is the sum of its hashed path parts' vectors, the mean of its hashed words' vectors and some
measures; a bidirectional LSTM reads the page's whole sequence and gives every block one of LABELS. The main text
is the blocks labelled `main`. The net is trained in numpy on generated pages and on at most SAMPLE whole pages of the
input of at most `example_chars` characters, labelled by the roles that their elements and class names declare; in
half of the examples it does not get to see those names, so that it must tell roles by elements, order and words, too.

Null and empty pages have no blocks. Nothing is dropped or capped within a page; a line break is white space. Repeated
rows give equal results, an empty table none; columns beyond the three named ones do not matter.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, span_hashes, text_bytes, tidied, words
from .recurrent import F32, Adam, init, lstm, lstm_back, lstm_params

LABELS = ("main", "menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments")
SAMPLE, BITS, PATH, WORD, HIDDEN, MEASURES = 200, 12, 16, 8, 16, 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-label)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
# element names of the HTML standard: fixed values
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style template iframe title head textarea select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"button", "label", "option"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl div article section main body html td th li nav aside footer header form".split())


def blocks_of(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path parts, characters in links) of the leaf blocks in page order."""
    page, out, stack, text, links, at = page or "", [], [], [], 0, 0

    def flush():
        nonlocal links
        if text:
            t = _SPACE.sub(" ", "".join(text)).strip()
            if t:
                out.append((t, tuple(p for _, parts in stack for p in parts), links))
            text.clear()
        links = 0

    def add(raw):
        nonlocal links
        if raw:
            t = entities.unescape(raw)
            text.append(t)
            if any(n == "a" for n, _ in stack):
                links += len(t)

    m = _TOKEN.search(page)
    while m:
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        elif name in _RAW and name != "head" and not m[1] and not m[3].endswith("/>"):
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name and m[1]:
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(n in _BLOCK for n, _ in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                if name not in _BLOCK and stack[k][0] in _SCOPE:
                    break
        elif name == "br":
            text.append(" ")
        elif name:
            if name in _BLOCK:
                flush()
                if name in _CLOSES_P:
                    _end(stack, {"p"})
                if name in _IMPLIED:
                    _end(stack, _IMPLIED[name])
            if name not in _VOID and not m[3].endswith("/>"):
                stack.append((name, _parts(name, m[3])))
        m = _TOKEN.search(page, at)
    add(page[at:])
    flush()
    return out


def _end(stack, names):
    """Closes what the standard lets a start tag close, within the nearest scope."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in _SCOPE:
            return


def _parts(name: str, attrs: str) -> tuple[str, ...]:
    out = [name]
    if len(attrs) > 1:
        for a in _ATTR.finditer(attrs):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("hidden", "style"):
                out += ["hidden"] * (key == "hidden" or "display:none" in value.replace(" ", "").lower())
            else:
                out += [f"{key}={w}" for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]
    return tuple(out)


# what element and class names declare: fixed values, most telling first
_DECLARED = (
    ("comments", {"comment", "comments", "disqus", "respond", "replies", "reply", "discussion"}),
    ("advert", {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad"}),
    ("notice", {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "popup", "modal", "paywall", "banner", "hidden", "dialog"}),
    ("form", {"form", "fieldset", "button", "label", "search", "login"}),
    ("menu", {"nav", "menu", "breadcrumb", "breadcrumbs", "navigation", "navbar", "pagination", "pager", "share", "social", "tags"}),
    ("sidebar", {"aside", "sidebar", "related", "widget", "recommended", "complementary"}),
    ("footer", {"footer", "copyright", "contentinfo", "legal"}),
    ("header", {"header", "masthead", "topbar", "logo"}),
)
_MAIN = {"article", "main", "content", "post", "entry", "story", "body-text", "articlebody"}


def declared(path: tuple[str, ...]) -> int:
    """The label that a path's names declare; main where none does."""
    names = {p.split("=")[-1] for p in path}
    inside = bool(names & _MAIN)
    for label, own in _DECLARED:
        if names & own and not (label == "header" and inside):
            return LABELS.index(label)
    return 0


def nameless(page: list, rng) -> list:
    """The page's blocks without what class names and the like say: of all elements, or of some."""
    share = 1.0 if rng.random() < 0.5 else rng.random()
    named = sorted({p for _, path, _ in page for p in path if "=" in p or p == "hidden"})
    gone = {p for p in named if rng.random() < share}
    return [(t, tuple(p for p in path if p not in gone), n) for t, path, n in page]


def _generated(rng, vocabulary: list[str]) -> str:
    """A page of random make-up; its names declare the labels."""
    w = lambda lo, hi: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(lo, hi)))
    pick = lambda *x: x[rng.integers(len(x))]
    paras = lambda: "".join(pick(f"<p>{w(8, 90)}</p>", f"<h2>{w(2, 7)}</h2><p>{w(10, 60)}</p>", f"<ul><li>{w(3, 12)}</li><li>{w(3, 12)}</li></ul>", f"<blockquote>{w(6, 30)}</blockquote>", f"<p>{w(5, 20)} <a href='#'>{w(1, 3)}</a> {w(5, 20)}<p>{w(6, 40)}", f"<pre>{w(5, 30)}</pre>", f"<table><tr><td>{w(1, 4)}</td><td>{w(1, 4)}</td></tr></table>") for _ in range(rng.integers(1, 9) if rng.random() < 0.97 else rng.integers(100, 500)))
    links = lambda: "".join(f"<li><a href='/x'>{w(1, 3)}</a></li>" for _ in range(rng.integers(2, 8)))
    extras = {
        "menu": lambda: pick(f"<nav><ul>{links()}</ul></nav>", f"<div class='menu'><ul>{links()}</ul></div>", f"<div class='breadcrumbs'><a href='/'>{w(1, 2)}</a></div>"),
        "header": lambda: pick(f"<header><a href='/'>{w(1, 3)}</a></header>", f"<div id='masthead'>{w(1, 5)}</div>", f"<header><h1>{w(1, 4)}</h1><p>{w(3, 9)}</p></header>"),
        "footer": lambda: pick(f"<footer>&copy; {w(2, 12)}</footer>", f"<div class='footer'><p>{w(3, 14)}</p><ul>{links()}</ul></div>"),
        "sidebar": lambda: pick(f"<aside><h3>{w(1, 3)}</h3><ul>{links()}</ul></aside>", f"<div class='sidebar'><p>{w(4, 30)}</p></div>", f"<div id='related-posts'><p>{w(3, 20)}</p></div>"),
        "notice": lambda: pick(f"<div class='cookie-notice'>{w(5, 20)}</div>", f"<div id='newsletter'><p>{w(4, 16)}</p></div>", f"<div class='alert'>{w(3, 15)}</div>"),
        "advert": lambda: pick(f"<div class='ad'>{w(3, 20)}</div>", f"<div class='sponsored'><p>{w(4, 22)}</p></div>", f"<section class='promo'>{w(3, 15)}</section>"),
        "form": lambda: pick(f"<form><label>{w(1, 3)}</label><button>{w(1, 2)}</button></form>", f"<form class='search'><p>{w(2, 6)}</p></form>"),
        "comments": lambda: pick(f"<section class='comments'><h3>{w(1, 3)}</h3><div class='comment'><p>{w(4, 60)}</p></div></section>", f"<div id='comments'><ul><li>{w(4, 40)}</li></ul></div>"),
    }
    junk = lambda: pick("", "site-", "page-", f"{vocabulary[rng.integers(len(vocabulary))]} ", "js-", "my_")
    named = {k: sorted(own) for k, own in _DECLARED}
    other = lambda k: f"<{(t := pick('div', 'section', 'div'))} {pick('class', 'id')}='{junk()}{pick(*named[k])}'>{pick(f'<p>{w(2, 30)}</p>', w(1, 12), f'<h3>{w(1, 4)}</h3><ul><li>{w(2, 8)}</li></ul>')}</{t}>"
    some = lambda *kinds: "".join(other(k) if rng.random() < 0.4 else extras[k]() for k in rng.permutation(kinds) if rng.random() < 0.6)
    inner = f"<h1>{w(2, 9)}</h1>" * int(rng.random() < 0.8) + paras() + some("advert", "sidebar", "notice", "form")
    inner += paras() * int(rng.random() < 0.5)
    body = pick(f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article>{some('comments')}</main>", f"<div class='content'>{inner}</div>", f"<div id='post'><div class='entry'>{inner}</div></div>", f"<article><header><h1>{w(2, 8)}</h1></header>{paras()}</article>", f"<div>{inner}</div>", f"<div class='{junk()}{pick(*sorted(_MAIN))}'>{inner}</div>")
    return f"<html><head><title>{w(2, 5)}</title></head><body>{some('header', 'menu', 'notice', 'advert', 'form')}{body}{some('comments', 'sidebar', 'advert', 'form', 'notice')}{some('footer', 'menu')}</body></html>"


class Pages:
    """The inputs of some pages' blocks: hashed path parts, hashed words, measures."""

    _parts: dict[str, int] = {}

    def __init__(self, pages: list[list[tuple[str, tuple[str, ...], int]]]):
        self.count = np.array([len(p) for p in pages], np.int64)
        flat = [b for p in pages for b in p]
        known = self._parts
        ids = []
        for _, path, _ in flat:
            for x in path or ("",):
                if x not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[x] = zlib.crc32(x.encode()) >> (32 - BITS)
                ids.append(known[x])
        self.path = np.array(ids, np.int64)
        self.path_at = np.cumsum([0, *(len(p) or 1 for _, p, _ in flat)])
        data, offs = text_bytes(pa.array([t for t, _, _ in flat], pa.string()))
        s, e, self.word_of = words(LOWER[data], offs, ALNUM)
        self.word = (span_hashes(LOWER[data], s, e) >> np.uint64(64 - BITS)).astype(np.int64)
        self.words = np.bincount(self.word_of, minlength=len(flat)).astype(F32)
        chars = np.array([len(t) for t, _, _ in flat], F32)
        first = np.repeat(np.cumsum(self.count) - self.count, self.count)
        where = (np.arange(len(flat)) - first) / np.maximum(1, np.repeat(self.count, self.count))
        self.measures = np.stack([np.log1p(chars) / 8, np.array([x for _, _, x in flat], F32) / np.maximum(chars, 1), np.log1p(self.words) / 6, where, np.ones(len(flat))], 1).astype(F32) if flat else np.zeros((0, MEASURES), F32)

    def inputs(self, p):
        n = len(self.measures)
        if not n:
            return np.zeros((0, PATH + WORD + MEASURES), F32)
        path = np.add.reduceat(p["path"][self.path], self.path_at[:-1])
        vec = p["word"][self.word]
        word = np.stack([np.bincount(self.word_of, vec[:, k], minlength=n) for k in range(WORD)], 1) / np.maximum(self.words, 1)[:, None]
        return np.concatenate([path, word.astype(F32), self.measures], 1)


class Labeller:
    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.p = {"path": init(rng, 1 << BITS, PATH, scale=0.3), "word": init(rng, 1 << BITS, WORD, scale=0.1)}
        for k in "fb":
            self.p |= lstm_params(rng, k, PATH + WORD + MEASURES, HIDDEN)
        self.p |= {"O": init(rng, 2 * HIDDEN, len(LABELS)), "o": np.zeros(len(LABELS), F32)}

    def _run(self, X, mask, keep):
        p = self.p
        f, kf = lstm(X, mask, p["fW"], p["fb"], p["fU"], keep=keep)
        b, kb = lstm(X, mask, p["bW"], p["bb"], p["bU"], reverse=True, keep=keep)
        H = np.concatenate([f, b], 2)
        return H, H @ p["O"] + p["o"], kf, kb

    def learn(self, pages: Pages, labels: np.ndarray, opt):
        p, flat = self.p, pages.inputs(self.p)
        at, mask = _grid(pages.count)
        X = flat[at] * mask[:, :, None]
        H, Z, kf, kb = self._run(X, mask, True)
        q = np.exp(Z - Z.max(2, keepdims=True))
        q /= q.sum(2, keepdims=True)
        t, n = np.nonzero(mask)
        q[t, n, labels[at[t, n]]] -= 1
        d = (q * mask[:, :, None] / max(1, len(t))).astype(F32)
        g = {"O": H.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, len(LABELS)), "o": d.sum((0, 1))}
        dH = d @ p["O"].T
        dXf, g["fW"], g["fb"], g["fU"] = lstm_back(dH[:, :, :HIDDEN], X, mask, p["fW"], p["fb"], p["fU"], kf)
        dXb, g["bW"], g["bb"], g["bU"] = lstm_back(dH[:, :, HIDDEN:], X, mask, p["bW"], p["bb"], p["bU"], kb, reverse=True)
        dX = np.zeros_like(flat)
        dX[at[t, n]] = (dXf + dXb)[t, n]
        g["path"], g["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
        np.add.at(g["path"], pages.path, np.repeat(dX[:, :PATH], np.diff(pages.path_at), 0))
        np.add.at(g["word"], pages.word, (dX[:, PATH : PATH + WORD] / np.maximum(pages.words, 1)[:, None])[pages.word_of])
        opt.step(g)

    def label(self, parsed: list) -> list[np.ndarray]:
        """Labels of every block of pages given as their blocks; pages of like length run together."""
        out = [np.zeros(0, np.int64)] * len(parsed)
        order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(parsed[order[hi]]) <= 20_000:
                hi += 1
            own = order[lo:hi]
            pages = Pages([parsed[k] for k in own])
            at, mask = _grid(pages.count)
            best = self._run(pages.inputs(self.p)[at] * mask[:, :, None], mask, False)[1].argmax(2)
            for j, k in enumerate(own):
                out[k] = best[: len(parsed[k]), j]
            lo = hi
        return out


def _grid(count):
    """(T, N) block numbers and mask of pages with these counts."""
    t = np.arange(count.max())[:, None]
    mask = t < count
    return np.where(mask, t + (np.cumsum(count) - count)[None, :], 0), mask.astype(F32)


def fit(pages: list[str], *, made: int = 600, epochs: int = 10, seed: int = 4) -> Labeller:
    rng, net = np.random.default_rng(seed), Labeller()
    parsed = [b for p in pages if (b := blocks_of(p))]
    vocabulary = sorted({w for p in parsed for t, _, _ in p for w in t.split()}) or ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(500)]
    vocabulary = [entities.escape(w) for w in vocabulary]
    parsed += [blocks_of(_generated(rng, vocabulary)) for _ in range(made)]
    parsed = [p for p in parsed if p]
    roles = [np.array([declared(path) for _, path, _ in p]) for p in parsed]
    opt = Adam(net.p, 1e-2)
    for epoch in range(epochs):
        opt.rate = 1e-2 * 0.7**epoch
        order = rng.permutation(len(parsed))
        for lo in range(0, len(order), 24):
            own = order[lo : lo + 24]
            seen = [nameless(parsed[k], rng) if rng.random() < 0.5 else parsed[k] for k in own]
            net.learn(Pages(seen), np.concatenate([roles[k] for k in own]), opt)
    return net


def sample(pages: DataFrame, html_col: str, most: int = SAMPLE, example_chars: int = 100_000) -> list[str]:
    """At most `most` whole pages of at most `example_chars` characters, those with the smallest hashes."""
    some = pages.select(pages[html_col].alias("t")).where(f"length(t) <= {example_chars}").select("t", F.xxhash64("t").alias("h"))
    last = some.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = some.where(F.col("h") <= last).groupBy("h").agg(F.first("t").alias("t")).collect()  # no text but these is sent
    return [r.t for r in sorted(rows, key=lambda r: r.h)]


def main_text(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", model: Labeller | None = None, example_chars: int = 100_000) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every page: its main blocks, joined by newlines."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(sample(pages, html_col, example_chars=example_chars)))  # of fixed size

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "html", 2 << 20):
                parsed = [blocks_of(h) for h in b.column("html").to_pylist()]
                labels = shared.value.label(parsed)
                text = ["\n".join(t for (t, _, _), k in zip(p, own) if k == 0) for p, own in zip(parsed, labels)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in text], [len(p) for p in parsed], [int((x == 0).sum()) for x in labels]))],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    narrow = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return narrow.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
