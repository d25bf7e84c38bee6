"""Benchmark decontamination with a distributed positional inverted index.

The index is stored: for every block of training documents its terms (64-bit hashes of words) and, for each, the
sorted list of its positions. A test phrase is a window of an item's words. It is looked up by its rarest term: the
corpus's frequencies of the test terms are joined to the phrases, and the rarest term of each is joined to the blocks
that hold it; a phrase with a term that no document has goes no further. In such a block the phrase's lists,
shifted by their offsets, are intersected from the rarest on (exact matches), and around each posting of the rarest
term the shortest stretch that holds all of the phrase's terms in any order is found (proximity matches). No
postings but those of such blocks are read again, and neither documents nor test items are ever in one place.

Null or empty text has no words; a null item has no windows, and a null item id counts as -1. An empty table gives no
rows, an empty benchmark no hits. Repeated rows are answered one by one, whatever their ids. Only the named columns
are read; very long texts are blocks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, fresh, maybe_among, pack, salted_join, span_hashes, text_bytes, tidied, unpack, words, written

WIDTH = 10
#: Words that a stretch may have to count as a proximity match.
SLOP = 2 * WIDTH
#: Phrases that are looked up in a block at once, about; items that are kept with a phrase, at most.
PHRASES, ITEMS = 1 << 16, 64
#: Candidates that are intersected at once.
_MOST = 1 << 18


class PositionalIndex:
    """A block's postings: for each of the sorted terms its count, and all places in the order of their terms. Words of
    different documents lie `gap` places apart."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.vocabulary, self.count = vocabulary, counts.astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.count)]
        self.span = int(places.max()) + 1 + (1 << 20) if len(places) else 1
        self.keys = np.repeat(np.arange(len(counts)), self.count) * self.span + places

    @classmethod
    def of(cls, hashes: np.ndarray, doc: np.ndarray, gap: int) -> PositionalIndex:
        vocabulary, term, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return cls(vocabulary, counts, (np.arange(len(hashes)) + doc * gap)[np.argsort(term, kind="stable")])

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of terms, or -1."""
        if not len(self.vocabulary):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _rarest_first(self, terms: np.ndarray, lengths: np.ndarray):
        """Yields (phrases, order of their terms by rarity, places of the rarest); of a piece of the phrases each."""
        rarity = np.where(np.arange(terms.shape[1]) < lengths[:, None], np.where(terms >= 0, self.count[terms], 0), np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")
        live = np.flatnonzero(rarity[np.arange(len(terms)), order[:, 0]] > 0)
        sizes, lo = np.cumsum(rarity[live, order[live, 0]]), 0
        while lo < len(live):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + _MOST, "right")))
            own = live[lo:hi]
            first = terms[own, order[own, 0]]
            n = self.count[first]
            phrase = np.repeat(own, n)
            at = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[first], n)
            yield phrase, order, self.keys[at] - terms[phrase, order[phrase, 0]] * self.span
            lo = hi

    def phrases(self, terms: np.ndarray, lengths: np.ndarray):
        """Yields (phrase numbers, first places) of all exact occurrences; terms are padded rows of term numbers."""
        for phrase, order, place in self._rarest_first(terms, lengths) if len(terms) else ():
            base = place - order[phrase, 0]
            for k in range(1, terms.shape[1]):
                offset = order[phrase, k]
                key = np.maximum(terms[phrase, offset], 0) * self.span + base + offset
                has = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                keep = (k >= lengths[phrase]) | has & (base + offset >= 0)
                phrase, base = phrase[keep], base[keep]
            yield phrase, base

    def proximity(self, terms: np.ndarray, lengths: np.ndarray, slop: int):
        """Yields (phrase numbers, first places, last places) of the shortest stretch of at most `slop` places that
        holds a posting of the phrase's rarest term and all its other terms, in any order; one for each posting."""
        for phrase, order, place in self._rarest_first(terms, lengths) if len(terms) else ():
            width = terms.shape[1]
            left, right = np.zeros((len(phrase), width), np.int64), np.zeros((len(phrase), width), np.int64)
            near = np.ones(len(phrase), bool)
            for k in range(1, width):
                own = np.flatnonzero(near & (k < lengths[phrase]))
                term = terms[phrase[own], order[phrase[own], k]]
                key = term * self.span + place[own]
                lo, hi = self.start[term], self.start[term + 1]
                at = np.searchsorted(self.keys, key)
                right[own, k] = np.where(at < hi, self.keys[np.minimum(at, len(self.keys) - 1)] - key, slop)
                at = np.searchsorted(self.keys, key, "right") - 1
                left[own, k] = np.where(at >= lo, key - self.keys[np.maximum(at, 0)], slop)
                near[own] = np.minimum(left[own, k], right[own, k]) < slop
            phrase, place, left, right = phrase[near], place[near], left[near], right[near]
            best = np.full(len(phrase), slop + 1, np.int64)
            first, last = place.copy(), place.copy()
            for k in range(width):  # as far to the left as the k-th term, as far to the right as what that leaves out
                after = np.where(left > left[:, [k]], right, 0).max(1)
                size = left[:, k] + after + 1
                better = size < best
                best[better] = size[better]
                first[better], last[better] = (place - left[:, k])[better], (place + after)[better]
            ok = best <= slop
            yield phrase[ok], first[ok], last[ok]


def _terms_of(texts):
    data, offs = text_bytes(texts)
    data = LOWER[data]
    s, e, doc = words(data, offs, ALNUM)
    return span_hashes(data, s, e), doc


INDEX = "block long, docs array<long>, n_words binary, vocabulary array<long>, counts array<int>, places binary"
_INDEX_ARROW = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("n_words", pa.binary()), ("vocabulary", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary())])


def postings(docs: DataFrame, *, id_col="doc_id", text_col="text", gap: int = SLOP) -> DataFrame:
    """The positional index, for storing: a row for each block of documents, with its sorted terms, how often each
    occurs, and the places of all in the order of the terms."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in blocks(batch, "text"):
                h, doc = _terms_of(b.column("text"))
                index = PositionalIndex.of(h, doc, gap)
                step = np.diff(index.keys % index.span, prepend=0).astype("<i4")
                row = {"block": block, "docs": b.column("doc_id"), "n_words": np.bincount(doc, minlength=b.num_rows).astype("<i4").tobytes(), "vocabulary": index.vocabulary.view(np.int64), "counts": index.count.astype(np.int32), "places": pack(step)}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if not pa.types.is_list(f.type) else pa.ListArray.from_arrays(pa.array([0, len(row[f.name])], pa.int32()), row[f.name] if isinstance(row[f.name], pa.Array) else pa.array(row[f.name], f.type.value_type)) for f in _INDEX_ARROW], schema=_INDEX_ARROW)
                block += 1

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), INDEX)


def phrases_of(benchmark: DataFrame, *, item_col="item_id", item_text="text", width: int = WIDTH) -> DataFrame:
    """(item, terms): the windows of `width` consecutive words of each item; a shorter one is a window itself."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "t"):
                h, doc = _terms_of(b.column("t"))
                n = np.bincount(doc, minlength=b.num_rows)
                first = np.cumsum(n) - n
                per = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
                own = np.repeat(np.arange(b.num_rows), per)
                at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
                size = np.minimum(n[own], width)
                ends = np.cumsum(size)
                values = h[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(at, size)]
                terms = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(own)), terms], names=["item", "terms"])

    items = benchmark.select(F.coalesce(benchmark[item_col].cast("long"), F.lit(-1)).alias("i"), benchmark[item_text].alias("t"))
    return items.mapInArrow(tidied(run), "item long, terms array<long>")


def _candidates(index: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text: str):
    """(blocks with the phrases to look up in them, items of the phrases that more than ITEMS items have)."""
    own = written(phrases_of(benchmark, item_col=item_col, item_text=item_text, width=width), "windows")
    # phrases by their terms; a phrase that a third of all items have is counted before it is shuffled
    phrases = own.groupBy("terms").agg(F.count("*").alias("n")).withColumn("phrase", F.monotonically_increasing_id())
    phrases = written(phrases, "phrases")
    pairs = written(salted_join(own, phrases.select("terms", "phrase"), "terms", "item", phrases.select("terms", "n")).groupBy("phrase", "item").agg(F.lit(1).alias("one")).drop("one"), "pairs")
    sizes = pairs.groupBy("phrase").agg(F.count("*").alias("k"))
    few = pairs.join(sizes.where(f"k <= {ITEMS}"), "phrase").groupBy("phrase").agg(F.collect_list("item").alias("items"))
    many = pairs.join(sizes.where(f"k > {ITEMS}"), "phrase", "left_semi")
    each = phrases.select("phrase", F.size("terms").alias("n"), F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("kinds"))
    held = index.select("block", F.explode(F.arrays_zip("vocabulary", "counts")).alias("p")).select("block", F.col("p.vocabulary").alias("term"), F.col("p.counts").alias("n"))
    held = written(held.join(each.select("term").distinct(), "term", "left_semi"), "held")
    often = written(held.groupBy("term").agg(F.sum("n").alias("n")), "often")
    rarest = salted_join(each.drop("n"), often, "term", "phrase").groupBy("phrase").agg(F.count("*").alias("k"), F.max("kinds").alias("kinds"), F.min_by("term", F.struct("n", "term")).alias("term")).where("k = kinds")
    found = held.select("term", "block").join(rarest.select("term", "phrase"), "term").join(phrases.select("phrase", "terms"), "phrase").join(few, "phrase", "left")
    parts = 1 + phrases.count() // PHRASES
    look = found.groupBy("block", F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("phrase", "terms", F.coalesce("items", F.array().cast("array<long>")).alias("items"))).alias("look"))
    return index.join(look.drop("part"), "block"), many


_FOUND = "block long, d int, kind string, a long, b long, c long"


def _looked_up(rows: DataFrame, slop: int, gap: int, every: bool) -> DataFrame:
    """What is found, by block and number of the document in it.

    Of kind `hit`: words (a, b) that exact matches cover, in stretches apart. `exact` and `near`: an item (c null) or
    a phrase with too many items to have them at hand (c = 1) is in a. With `every`: each match of phrase a at words
    (b, c), of kind `exact at` or `near at`.
    """

    def run(batches):
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                out = _matches(row, slop, gap, every)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["block", "d", "kind", "a", "b", "c"])

    return rows.select("block", "n_words", "vocabulary", "counts", "places", "look").mapInArrow(tidied(run), _FOUND)


def _matches(row: pa.RecordBatch, slop: int, gap: int, every: bool):
    n_words = np.frombuffer(row.column("n_words")[0].as_py(), "<i4").astype(np.int64)
    counts = np.asarray(row.column("counts")[0].values, np.int64)
    places = np.cumsum(unpack(row.column("places")[0].as_py(), "<i4")[0].astype(np.int64))
    index = PositionalIndex(np.asarray(row.column("vocabulary")[0].values).view(np.uint64), counts, places)
    look = row.column("look")[0].values
    names, lists, items = (look.field(k) for k in ("phrase", "terms", "items"))
    names = np.asarray(names)
    offs = np.asarray(lists.offsets)
    lengths = np.diff(offs)
    width = int(lengths.max())
    terms = np.full((len(lengths), width), -1, np.int64)
    real = np.arange(width) < lengths[:, None]
    terms[real] = index.terms(np.asarray(lists.values)[offs[0] : offs[-1]].view(np.uint64))
    first = np.cumsum(n_words) - n_words + np.arange(len(n_words)) * gap  # the place of each document's first word
    item_offs, item_values = np.asarray(items.offsets), np.asarray(items.values)
    out: list[tuple] = []
    told: dict[str, set] = {"exact": set(), "near": set()}
    cover: dict[int, list] = {}
    exact = ((p, a, a + lengths[p] - 1) for p, a in index.phrases(terms, lengths))
    for kind, found in (("exact", exact), ("near", index.proximity(terms, lengths, slop) if slop else ())):
        for phrase, lo, hi in found:
            d = np.searchsorted(first, lo, "right") - 1
            # documents without words stand where the next one begins
            a, z = lo - first[d], hi - first[d] + 1
            for k, p, s, e in zip(d.tolist(), phrase.tolist(), a.tolist(), z.tolist()):
                told[kind].add((k, p))
                if kind == "exact":
                    cover.setdefault(k, []).append((s, e))
                if every:
                    out.append((k, f"{kind} at", int(names[p]), s, e))
    for k, spans in cover.items():
        spans.sort()
        lo, hi = spans[0]
        for s, e in spans[1:]:
            if s > hi:
                out.append((k, "hit", lo, hi, None))
                lo = s
            hi = max(hi, e)
        out.append((k, "hit", lo, hi, None))
    for kind, pairs in told.items():
        of = set()
        for k, p in pairs:
            own = item_values[item_offs[p] : item_offs[p + 1]].tolist()
            of |= {(k, i, None) for i in own} if own else {(k, int(names[p]), 1)}
        out += [(k, kind, i, None, c) for k, i, c in of]
    block = row.column("block")[0].as_py()
    return ([block] * len(out), *(list(c) for c in zip(*out))) if out else ([],) * 6


def _indexed(docs, id_col, text_col, slop, width):
    gap = max(slop, width)
    return written(postings(docs, id_col=id_col, text_col=text_col, gap=gap), "index"), gap


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """Per document: its words, those inside any occurrence of a test window, the items that occur, and those that
    occur in proximity: all words of one of their windows within `slop` words, in any order.

    items_sha256 is of the ids of the items that occur, as text, sorted and comma-joined.
    """
    index, gap = _indexed(docs, id_col, text_col, slop, width)
    rows, many = _candidates(index, benchmark, width, item_col, item_text)
    found = written(_looked_up(rows, slop, gap, False), "found")
    so_far = Window.partitionBy("block", "d").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    hits = found.where("kind = 'hit'").withColumn("upto", F.coalesce(F.max("b").over(so_far), F.lit(0)))
    hits = hits.groupBy("block", "d").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "upto"))).alias("n_hit"))
    items = found.where("kind in ('exact', 'near')")
    shared = items.where("c = 1").join(many.withColumnRenamed("phrase", "a"), "a").select("block", "d", "kind", "item")
    items = items.where("c is null").select("block", "d", "kind", F.col("a").alias("item")).unionByName(shared).distinct()
    of = items.groupBy("block", "d").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "exact", F.col("item").cast("string")))).alias("ids"), F.count_if(F.col("kind") == "near").alias("n_near"))
    base = index.select("block", F.posexplode("docs").alias("d", "doc_id"), "n_words")
    # four little-endian bytes a document
    byte = lambda k: F.conv(F.hex(F.substring("n_words", F.col("d") * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    base = base.select("block", "d", "doc_id", sum(byte(k) * 256**k for k in range(4)).alias("n_words"))
    out = base.join(hits.join(of, ["block", "d"], "full_outer"), ["block", "d"], "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """The rows of docs, whole, in which no test window occurs. Rows are told apart by a number that is written with
    them, so null and repeated ids are fine."""
    row, maybe = fresh(docs, "row_number", "maybe_hit")
    docs, columns = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), docs.columns
    index, gap = _indexed(docs, row, "text", 0, width)
    rows, _ = _candidates(index, benchmark, width, "item_id", "text")
    found = _looked_up(rows, 0, gap, False).where("kind = 'hit'").select("block", "d").distinct()
    gone = index.select("block", F.posexplode("docs").alias("d", row)).join(found, ["block", "d"], "left_semi").select(row)
    gone = written(gone, "hit")
    marked = maybe_among(docs, gone, row, maybe)
    rest = marked.where(F.col(maybe)).join(gone, row, "left_anti")
    return marked.where(~F.col(maybe)).select(*columns).unionByName(rest.select(*columns))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", width: int = WIDTH, slop: int = 0) -> DataFrame:
    """Occurrences as rows (doc_id, item_id, start, end) in words: exact ones of each window, or, with slop, stretches
    of at most that many words that hold all of a window's terms in any order: around each posting of the term that
    is rarest in its block the shortest one."""
    index, gap = _indexed(docs, id_col, text_col, slop, width)
    rows, many = _candidates(index, benchmark, width, item_col, item_text)
    found = written(_looked_up(rows, slop, gap, True), "found")
    kind = "near at" if slop else "exact at"
    at = found.where(F.col("kind") == kind).select("block", "d", F.col("a").alias("phrase"), F.col("b").alias("start"), F.col("c").alias("end"))
    items = phrases_of(benchmark, item_col=item_col, item_text=item_text, width=width)
    name = rows.select(F.explode("look").alias("l")).select("l.phrase", "l.terms").distinct().join(items, "terms").select("phrase", "item")
    ids = index.select("block", F.posexplode("docs").alias("d", "doc_id"))
    return at.join(name, "phrase").join(ids, ["block", "d"]).select("doc_id", F.col("item").alias("item_id"), "start", "end").distinct()
