"""Vector bin packing of token sequences.

Examples have three demands: tokens, segments (one each) and loss-bearing tokens. Bins (training sequences)
are filled one at a time; the next example is the one whose demand vector has the largest weighted dot
product with what the bin has left (Panigrahy et al., 2011). Where nothing fits whole, an example is cut, as
documents may be. Each task packs what it reads: no shuffle, and memory is one pool of examples' tails.

All tokens of a document bear loss; of a conversation those of the answering roles do, so that all three demands
differ. Null text is an empty document or turn (the end id alone). An empty table gives no pieces. Repeated rows are
packed as often as they occur. Only the named columns are read, so further columns do not matter.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, span_hashes, tidied, words

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """The ids of the tokenizer in `path`. Where the file's pre-tokenizer treats text as `_split` does, each distinct
    run between spaces is encoded once and kept by a 64-bit hash, up to `most` bytes; whether it does is tried out,
    character by character, when the file is loaded. Texts with other characters, or with an added token's string, go
    to the tokenizer whole, and so do all texts if another rule holds."""

    #: Latin letters, digits, punctuation and plain white space, whose runs are candidates for the cache.
    _RANGES = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x12F), (0x131, 0x24F), (0x2013, 0x2026))

    def __init__(self, path: str, most: int = 128 << 20):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)").search
        self.plain = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in self._RANGES) + "]*").fullmatch
        self._forget()
        if not self._agrees():
            self.plain = lambda _: None

    def _forget(self):
        """Of each run's hash its number; of each number its ids, in one array with their ends; of each pre-token its ids."""
        self.numbers, self.flat, self.ends, self.parts = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64), {}

    def _agrees(self) -> bool:
        """Whether runs encoded by themselves give the tokenizer's ids, for every character in several places."""
        chars = [chr(c) for a, z in self._RANGES for c in range(a, z + 1)]
        probes = [p for c in chars for p in (f"ab{c}cd E{c} {c}{c}x 1{c}2", f"{c} it's We'LL {c}a_b{c}") if not self.added(p)]
        return all(x.tolist() == y.ids for x, y in zip(self._cached(probes), self.tok.encode_batch(probes, add_special_tokens=False)))

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(self.plain(t)) and not self.added(t) for t in texts]
        cached = iter(self._cached([t for t, p in zip(texts, plain) if p]))
        return [next(cached) if p else np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain)]

    def _cached(self, texts: list[str]) -> list[np.ndarray]:
        raw = [(t if t.isascii() else unicodedata.normalize("NFC", t)).lower().encode() for t in texts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw], dtype=np.int64)]
        s, e, doc = words(data, offs, NOT_SPACE)
        kinds, first, run = np.unique(span_hashes(data, s, e), return_index=True, return_inverse=True)
        if (len(self.numbers) + len(self.parts)) * 200 + self.flat.nbytes > self.most:
            self._forget()
        numbers = self.numbers
        number = np.array([numbers.get(h, -1) for h in kinds.tolist()], np.int64)
        if len(new := np.flatnonzero(number < 0)):
            found = [self._encode(bytes(data[a:z]).decode()) for a, z in zip(s[first[new]].tolist(), e[first[new]].tolist())]
            number[new] = len(numbers) + np.arange(len(new))
            numbers.update(zip(kinds[new].tolist(), number[new].tolist()))
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in found])]
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        number = number[run]
        size = self.ends[number + 1] - self.ends[number]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[number] - ends + size, size)]
        cuts = np.r_[0, ends][np.searchsorted(doc, np.arange(len(texts) + 1))]
        return [ids[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _encode(self, chunk: str) -> bytes:
        own = self.parts.get(chunk)
        return own if own is not None else b"".join([self._part(p) for p in self.split(chunk)])

    def _part(self, part: str) -> bytes:
        if (own := self.parts.get(part)) is None:
            found = self.tok.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS))
            own = self.parts[part] = array("I", [t.id for t in found]).tobytes()
        return own


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 stays, other bytes count up from 256."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in kept)
    return {b: 256 + n for n, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


@dataclass
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Item:
    key: object
    #: What is left of the ids, and which number the first of them has among all of them.
    ids: np.ndarray
    #: Loss-bearing ids before each of them and in all; None: all bear loss.
    loss: np.ndarray | None = None
    first: int = 0
    total: int = -1

    def __post_init__(self):
        self.total = len(self.ids) if self.total < 0 else self.total

    def loss_of(self, n: int) -> int:
        """Of the next n ids."""
        return n if self.loss is None else int(self.loss[n] - self.loss[0])

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest head within both limits."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[0] + loss, "right")) - 1)

    def take(self, n: int) -> Item:
        """The next n ids, which go."""
        head = Item(self.key, self.ids[:n], None if self.loss is None else self.loss[: n + 1], self.first, self.total)
        self.ids, self.first = self.ids[n:], self.first + n
        self.loss = None if self.loss is None else self.loss[n:]
        return head

    def kept(self) -> Item:
        """Itself, without a hold on the ids that went."""
        self.ids = self.ids.copy()
        self.loss = None if self.loss is None else self.loss.copy()
        return self


@dataclass
class Packer:
    """Packs a stream of items through a pool of at most `pool` of them; yields bins, lists of items."""

    limits: Limits = field(default_factory=Limits)
    pool: int = 2048

    def pack(self, items):
        waiting: list[Item] = []
        full = min(self.limits.tokens, self.limits.loss)
        for x in items:
            # a piece that fills a bin by itself
            while (n := x.fitting(self.limits.tokens, self.limits.loss)) and (n == self.limits.tokens or x.loss is None and n == full):
                yield [x.take(n)]
            if len(x.ids):
                waiting.append(x.kept())
            if len(waiting) >= self.pool:
                waiting = yield from self._fill(waiting, self.pool // 2)
        yield from self._fill(waiting, 0)

    def _fill(self, waiting: list[Item], keep: int):
        """Fills bins until at most `keep` items are left, which it returns."""
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        need = np.array([(len(x.ids), 1, x.loss_of(len(x.ids))) for x in waiting], np.float64).reshape(-1, 3)
        weight = (need / cap).mean(0) / cap**2 if len(need) else cap
        alive = np.ones(len(waiting), bool)
        count = len(waiting)
        while count > keep:
            left, parts = cap.copy(), []
            while count and left[1] >= 1 and left[0] >= 1:
                fits = alive & (need[:, 0] <= left[0]) & (need[:, 2] <= left[2])
                value = np.where(fits, need @ (weight * left), -1.0)
                k = int(value.argmax())
                if value[k] >= 0:
                    parts.append(waiting[k].take(len(waiting[k].ids)))
                    left -= need[k]
                    alive[k], count = False, count - 1
                    continue
                # nothing fits whole: the head of the longest item that may give one fills the rest
                for k in np.argsort(-np.where(alive, need[:, 0], -1), kind="stable")[:8]:
                    x = waiting[k]
                    if alive[k] and (n := x.fitting(int(left[0]), int(left[2]))) > 0:
                        parts.append(x.take(n))
                        left -= (n, 1, parts[-1].loss_of(n))
                        need[k] = len(x.ids), 1, x.loss_of(len(x.ids))
                        break
                else:
                    break
            yield parts
        return [x for x, a in zip(waiting, alive) if a]


def power_of_two_parts(parts: list[Item], full: int):
    """A bin that is not full, as sequences whose lengths are powers of two, which need no padding."""
    total = sum(len(x.ids) for x in parts)
    if total >= full or not total:
        yield parts
        return
    parts, at = list(parts), 0
    for bit in reversed(range(total.bit_length())):
        room, out = total & (1 << bit), []
        while room:
            n = min(room, len(parts[at].ids))
            out.append(parts[at].take(n))
            room -= n
            at += not len(parts[at].ids)
        if out:
            yield out


def _packed(items, limits: Limits):
    """Arrow batches of the pieces' rows."""
    from pyspark import TaskContext

    rows, seq = [], TaskContext.get().partitionId() << 40
    for whole in Packer(limits).pack(items):
        for part in power_of_two_parts(whole, limits.tokens):
            at = 0
            for x in part:
                n = len(x.ids)
                rows.append((x.key, x.first, n, zlib.crc32(np.ascontiguousarray(x.ids, "<u4")), x.total, seq, at, x.loss_of(n)))
                at += n
            seq += 1
        if len(rows) > 20_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def pack_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", end_id: int = 1, limits: Limits | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    The ids of a text, then `end_id`; each id lies in exactly one piece. sequence_id is unique in the
    result, offset gapless from 0 in each sequence. Only the end of a task's input makes sequences that
    are not full; those have lengths that are powers of two.
    """
    path, limits = tokenizer_path or vocabulary_path(), limits or Limits()

    def run(batches):
        tok = CachedTokenizer(path)

        def items():
            for b in (b for batch in batches for b in blocks(batch, "text")):
                for key, ids in zip(b.column(0).to_pylist(), tok.batch([t or "" for t in b.column(1).to_pylist()])):
                    yield Item(key, np.append(ids, np.uint32(end_id)))

        yield from _packed(items(), limits)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), SCHEMA)


#: Turns of one conversation that make one example at most; longer ones are several examples.
TURNS = 256


def pack_conversations(turns: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", answers: tuple[str, ...] = ("assistant",), end_id: int = 1, limits: Limits | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Instruction data: a conversation's turns, in order, make one example, each turn followed by `end_id`; only the
    ids of turns in the roles `answers` bear loss. One row per piece, as of pack_documents, with the conversation's id
    as doc_id. Turns with equal numbers are ordered by role and text; a null id or turn is a value of its own.
    """
    path, limits = tokenizer_path or vocabulary_path(), limits or Limits(segments=64, loss=1024)

    def run(batches):
        tok = CachedTokenizer(path)

        def items():
            for b in batches:
                for key, own in zip(b.column(0).to_pylist(), b.column(1)):
                    parts, loss, own = [], [], own.as_py()
                    for t, ids in zip(own, tok.batch([t["text"] or "" for t in own])):
                        parts.append(np.append(ids, np.uint32(end_id)))
                        loss.append(np.full(len(parts[-1]), t["role"] in answers))
                    yield Item(key, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(loss))])

        yield from _packed(items(), limits)

    one = turns.select(turns[id_col].cast("long").alias("doc_id"), turns[turn_col].cast("long").alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    own = one.groupBy("doc_id", F.floor(F.col("turn") / TURNS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("own"))
    return own.select("doc_id", "own").mapInArrow(tidied(run), SCHEMA)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)
