"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Tokens are words, and an end after each text. The model is a bigram model with Dirichlet smoothing towards the
add-half unigram model: p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU). It is learned from all documents that are not
held out, and scores all.

The corpus is read once, into blocks of numbered tokens. Two exchanges follow, each of a block's distinct items
only: words go to word shards, which count and number them; bigrams go to bigram shards, which count them, build
the trie and answer with the log probability of each of the block's bigrams; the block then adds them up over its
documents. So a bigram that every document holds is one entry a block. A bigram's shard is its context's, unless the
context is so frequent that it would fill a shard: those are spread by the whole bigram. No table of the
vocabulary or the model is ever in one place; shards have a bounded size and grow in number with the input, and a
block's items are sorted by shard once, whatever the number of shards.

Null and empty texts have the end token alone. Repeated rows are counted and scored as often as they occur. An
empty table gives no rows. If no document is learned from, every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, blocks, crc_of, mix, pack, release, span_hashes, text_bytes, tidied, unpack, words, written
from .eftrie import NgramTrie

HELD_MOD, HELD_OUT, MU = 5, 1, 16.0
BLOCK_BYTES, SHARD_WORDS, SHARD_TOKENS = 8 << 20, 1_000_000, 1_200_000
END = np.uint64(0x454E442D454E4421)
_BLOCK = "block long, docs array<long>, held binary, lens binary, words binary, counts binary, tokens binary, n_words long, n_tokens long"


def _by_shard(shard: np.ndarray):
    """(order, [(shard, slice of the order)]) of the items' shards, from one sort."""
    order = np.argsort(shard, kind="stable")
    own = shard[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order, [(int(own[lo]), slice(lo, hi)) for lo, hi in zip(cuts, [*cuts[1:], len(own)])]


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def _delta(a):
    return np.diff(a, prepend=a.dtype.type(0))


def _tokenised(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                data, offs = text_bytes(b.column("text"))
                s, e, doc = words(LOWER[data], offs, NOT_SPACE)
                n = b.num_rows
                lens = np.bincount(doc, minlength=n) + 1
                tokens = np.full(len(s) + n, END, np.uint64)
                tokens[np.arange(len(s)) + doc] = span_hashes(LOWER[data], s, e)
                kinds, tokens = np.unique(tokens, return_inverse=True)
                order = np.argsort(-np.bincount(tokens), kind="stable")  # small numbers for frequent words compress
                kinds, tokens = kinds[order], _inverse(order)[tokens]
                ids = b.column("doc_id").to_pylist()
                held = np.array([crc_of(x) % HELD_MOD == HELD_OUT for x in ids], bool)
                counts = np.bincount(tokens[np.repeat(~held, lens)], minlength=len(kinds))
                yield pa.RecordBatch.from_pylist([{"block": block, "docs": ids, "held": held.tobytes(), "lens": lens.astype("<i4").tobytes(), "words": kinds.tobytes(), "counts": pack(counts.astype("<u4")), "tokens": pack(tokens.astype("<u4")), "n_words": len(kinds), "n_tokens": int(lens.sum())}], schema=_BLOCK_ARROW)
                block += 1

    return docs.mapInArrow(tidied(run), _BLOCK)


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "lens", "words", "counts", "tokens")), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


_WORDS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def _word_counts(parts: DataFrame, shards: int) -> DataFrame:
    """Per block and word shard: the corpus's counts and numbers of the block's words; block -1 has the totals."""

    def send(batches):
        for b in batches:
            for r in b.to_pylist():
                w, (c,) = np.frombuffer(r["words"], np.uint64), unpack(r["counts"], "<u4")
                order, parts = _by_shard((w % np.uint64(shards)).astype(np.int64))
                w, c = w[order], c[order]
                for k, own in parts:
                    yield pa.RecordBatch.from_pydict({"shard": [k], "block": [r["block"]], "words": [w[own].tobytes()], "counts": [pack(c[own])]}, schema=_WORDS_ARROW)

    def count(key, t):
        rows = t.select(["block", "words", "counts"]).to_pylist()
        each = [np.frombuffer(r["words"], np.uint64) for r in rows]
        kinds, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(r["counts"], "<u4")[0] for r in rows]), minlength=len(kinds)).astype(np.int64)
        at = _inverse(np.argsort(-total, kind="stable"))[at]
        total = -np.sort(-total)
        ends = np.cumsum([len(x) for x in each])
        parts = [at[hi - len(x) : hi] for x, hi in zip(each, ends)]
        k = key[0].as_py()
        return pa.table({
            "block": pa.array([*(r["block"] for r in rows), -1], pa.int64()), "shard": pa.array([k] * (len(rows) + 1), pa.int32()),
            "counts": pa.array([*(pack(total[p], p * shards + k) for p in parts), None], pa.binary()),
            "n": pa.array([0] * len(rows) + [int(total.sum())], pa.int64()), "v": pa.array([0] * len(rows) + [int((total > 0).sum())], pa.int64()),
        })

    sent = parts.select("block", "words", "counts").mapInArrow(tidied(send), "shard int, block long, words binary, counts binary")
    return sent.groupBy("shard").applyInArrow(tidied(count), "block long, shard int, counts binary, n long, v long")


_SENT = "shard int, block long, docs array<long>, held binary, lens binary, known binary, base binary, slots binary, grams binary"
_SENT_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), *((c.split()[0], pa.binary()) for c in _SENT.split(", ")[3:])])


def _bigrams(parts: DataFrame, counts: DataFrame, n: int, v: int, word_shards: int, shards: int) -> DataFrame:
    """Per block: one row (shard -1) with its documents' base figures and where each token's bigram stands among the
    block's, and its distinct bigrams for each bigram shard, in that order."""
    room = n + 0.5 * (v + 1)

    def send(left, right):
        out = []
        replies = [r["counts"] for r in sorted(right.to_pylist(), key=lambda r: r["shard"])]
        for r in left.to_pylist():
            w = np.frombuffer(r["words"], np.uint64)
            order, _ = _by_shard((w % np.uint64(word_shards)).astype(np.int64))
            c, ids = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            if len(w):
                c[order], ids[order] = (np.concatenate(x) for x in zip(*(unpack(x, np.int64, np.int64) for x in replies)))
            tokens, lens = unpack(r["tokens"], "<u4")[0].astype(np.int64), np.frombuffer(r["lens"], "<i4").astype(np.int64)
            held = np.frombuffer(r["held"], bool)
            doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
            ct = c[tokens]
            base = np.bincount(doc, np.log10((ct + 0.5) / room), minlength=len(lens))
            known = np.bincount(doc[ct > 0], minlength=len(lens))
            # number 0 is the start of a text; its count is that of the ends
            first = np.cumsum(lens) - lens
            number = (ids + 1).astype(np.uint64)[tokens]
            keys = number.copy()
            keys[1:] |= number[:-1] << np.uint64(32)
            keys[first] = number[first]
            before_c = np.r_[0, ct[:-1]]
            before_c[first] = ct[first + lens - 1]
            del number, tokens
            keys, place, inverse = np.unique(keys, return_index=True, return_inverse=True)
            own = np.bincount(inverse[np.repeat(~held, lens)], minlength=len(keys))
            bc, wc = before_c[place], ct[place]
            spread = bc > max(1, n // (4 * shards))
            order, parts = _by_shard((mix(np.where(spread, keys, keys >> np.uint64(32))) % np.uint64(shards)).astype(np.int64))
            slots = pack(_inverse(order)[inverse].astype("<u4"))
            out.append({"shard": -1, "block": r["block"], "docs": r["docs"], "held": r["held"], "lens": r["lens"], "known": known.tobytes(), "base": base.tobytes(), "slots": slots})
            keys, own, bc, wc = keys[order], own[order].astype("<u4"), bc[order], wc[order]
            for k, at in parts:
                out.append({"shard": k, "block": r["block"], "grams": pack(_delta(keys[at]), own[at], bc[at], wc[at])})
        return pa.Table.from_pylist(out, schema=_SENT_ARROW)

    return parts.groupBy("block").cogroup(counts.where("block >= 0").groupBy("block")).applyInArrow(tidied(send), _SENT)


def _answers(sent: DataFrame, room: float) -> DataFrame:
    """Per block and bigram shard: the log10 probabilities of the bigrams that the block sent, in its order."""

    def answer(t):
        rows = t.select(["block", "shard", "grams"]).to_pylist()
        keys, counts, before, word = zip(*(unpack(r["grams"], np.uint64, "<u4", np.int64, np.int64) for r in rows))
        ends = np.cumsum([len(x) for x in keys])
        kinds, place, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in keys]), return_index=True, return_inverse=True)
        c = np.bincount(at, np.concatenate(counts), minlength=len(kinds))
        before, p = np.concatenate(before)[place], (np.concatenate(word)[place] + 0.5) / room
        seen = c > 0
        grams = np.stack([(kinds >> np.uint64(32)).astype(np.int64), (kinds & np.uint64(0xFFFFFFFF)).astype(np.int64)], 1)
        trie = NgramTrie.view(NgramTrie.build(grams[seen], np.log10((c + MU * p) / (before + MU))[seen]).to_bytes())
        lp = trie.log_prob(grams)
        lp = np.where(np.isnan(lp), np.log10(MU * p / (before + MU)), lp).astype("<f4")
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()),
            "probs": pa.array([pack(lp[at[hi - len(x) : hi]]) for x, hi in zip(keys, ends)], pa.binary()),
        })

    return sent.groupBy("shard").applyInArrow(tidied(answer), "block long, shard int, probs binary")


def score(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    parts = written(_tokenised(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))), "tokens")
    sizes = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    word_shards, shards = 1 + sizes.w // SHARD_WORDS, 1 + sizes.t // SHARD_TOKENS
    counts = written(_word_counts(parts, word_shards), "counts")
    total = counts.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    room = total.n + 0.5 * (total.v + 1)
    sent = written(_bigrams(parts, counts, total.n, total.v, word_shards, shards), "bigrams")
    release(parts, counts)
    answers = written(_answers(sent.where("shard >= 0").select("shard", "block", "grams"), room), "answers")

    def join(left, right):
        out = []
        replies = [r["probs"] for r in sorted(right.to_pylist(), key=lambda r: r["shard"])]
        for r in left.to_pylist():
            n, lens = len(r["docs"]), np.frombuffer(r["lens"], "<i4").astype(np.int64)
            lp = np.concatenate([unpack(x, "<f4")[0] for x in replies]).astype(np.float64)
            score = np.bincount(np.repeat(np.arange(n), lens), lp[unpack(r["slots"], "<u4")[0]], minlength=n)
            out.append(pa.table({
                "doc_id": pa.array(r["docs"], pa.int64()), "held_out": pa.array(np.frombuffer(r["held"], bool)), "n_tokens": pa.array(lens),
                "n_known": pa.array(np.frombuffer(r["known"], np.int64)), "train_tokens": pa.array([total.n] * n, pa.int64()), "base_score": pa.array(np.frombuffer(r["base"], np.float64)),
                "score": pa.array(score),
            }))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in _OUT})

    own = sent.where("shard = -1").drop("shard", "grams")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidied(join), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]
