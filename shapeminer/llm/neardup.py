"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document is its set of word shingles. Texts with equal sets form a class; each class has a signature of 40
16-bit MinHash symbols, whose Hamming distance (symbols that differ) is about 40 (1 - Jaccard). Signatures are
split into 10 chunks of 4 symbols. By pigeonhole two signatures at distance at most 19 have a chunk with at most
one error; each chunk is therefore indexed four times, each time without one of its symbols, and all such pairs
share a key. A Jaccard similarity of 0.8 exceeds distance 19 with a chance of about one in 10^5. Pairs under the
threshold are confirmed on the full shingle sets, which are cut by ranges of hashes into pieces of about PIECE
shingles, so that no row, and no task that gets the rows of one text, grows with the length of a text.

A bucket is never expanded into all its pairs: its members are compared with a few pivots, confirmed links are
merged into components, and only members that are then still in different components of a bucket are compared
further, in blocks that return links alone: by signatures, then by sets where signatures are near. Joins to a hot
bucket or pivot are salted.

Null text, and text without words, has an empty set: linked with nothing, a component of its own. Repeated rows
and ties are fine; component ids are smallest doc_ids. A null doc_id takes part under no id and gets none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, blocks, fresh, gram_hashes, maybe_among, mix, release, salted_join, span_hashes, text_bytes, tidied, words, written
from .components import components

SYMBOLS, CHUNK = 40, 4
#: Largest signature distance that the index is sure to find: one error a chunk at most in some chunk.
MOST_ERRORS = 2 * (SYMBOLS // CHUNK) - 1
#: Shingles and rows of one side of a block pair, about; columns of one matrix product.
BLOCK_SHINGLES, BLOCK_ROWS, COLUMNS = 400_000, 2048, 2048
#: Shingles of one piece of a set, about.
PIECE = 4096
_MULT = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SIGS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def shingle_sets(texts, n: int):
    """(doc, hash) of the distinct n-word shingles, sorted by both; a shorter text's one shingle is all its words."""
    data, offs = text_bytes(texts)
    data = LOWER[data]
    s, e, doc = words(data, offs, NOT_SPACE)
    h = span_hashes(data, s, e)
    g = gram_hashes(h, n)
    whole = doc[: len(g)] == doc[n - 1 :] if len(g) else np.zeros(0, bool)
    g, d = g[whole], doc[: len(whole)][whole]
    count = np.bincount(doc, minlength=len(texts))
    for k in np.flatnonzero((count > 0) & (count < n)):
        lo = np.searchsorted(doc, k)
        g, d = np.append(g, gram_hashes(h[lo : lo + count[k]], int(count[k])) ^ np.uint64(count[k])), np.append(d, k)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]


def signatures(docs: DataFrame, n: int, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature) of every document."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                d, g = shingle_sets(b.column("text"), n)
                start = np.searchsorted(d, np.arange(b.num_rows + 1))
                count = np.diff(start)
                digest, sig = [None] * b.num_rows, [None] * b.num_rows
                full = np.flatnonzero(count)
                if len(full):
                    low = np.empty((len(full), SYMBOLS), np.uint64)
                    for j in range(SYMBOLS):
                        low[:, j] = np.minimum.reduceat(g * _MULT[j], start[full])
                    low = mix(low).astype("<u2")
                    for k, row in zip(full, low):
                        digest[k] = hashlib.blake2b(g[start[k] : start[k + 1]].tobytes(), digest_size=16).digest()
                        sig[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], schema=_SIGS)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), "doc_id long, n_shingles long, digest binary, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, part, rep): a key for each chunk and each symbol left out of it."""

    def run(batches):
        for b in batches:
            rep = np.asarray(b.column("rep"))
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS // CHUNK, CHUNK).astype(np.uint64)
            part = 0
            for c in range(SYMBOLS // CHUNK):
                for out in range(CHUNK):
                    key = np.full(len(rep), part, np.uint64)
                    for k in range(CHUNK):
                        if k != out:
                            key = (key << np.uint64(16)) | sig[:, c, k]
                    yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64)), pa.array(np.full(len(rep), part, np.int32)), pa.array(rep)], names=["key", "part", "rep"])
                    part += 1

    return classes.select("rep", "sig").mapInArrow(tidied(run), "key long, part int, rep long")


def _near(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (x, y), with their sizes, whose signatures differ in MOST_ERRORS symbols at most and whose sizes allow the similarity."""
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    joined = salted_join(salted_join(pairs, side("x"), "x", "y"), side("y"), "y", "x").where(F.expr(f"100 * least(nx, ny) >= {least} * greatest(nx, ny)"))

    def run(batches):
        for b in batches:
            sx, sy = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("sx", "sy"))
            keep = pa.array((sx != sy).sum(1) <= MOST_ERRORS)
            yield b.select(["x", "y", "nx", "ny"]).filter(keep)

    return joined.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(tidied(run), "x long, y long, nx long, ny long")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, set) of the documents with these ids, and of a few others."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                d, g = shingle_sets(b.column("text"), n)
                at = pa.array(np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(g.view(np.int64)))], names=["id", "set"])

    return maybe_among(docs, ids, "doc_id", "maybe").where("maybe").select("doc_id", "text").mapInArrow(tidied(run), "id long, set array<long>")


def _level(size: int, most: int) -> int:
    """A set of this size is cut into 2^level pieces."""
    return (max(0, size - 1) // most).bit_length()


def _pieces(docs: DataFrame, ids: DataFrame, n: int, least: int, most: int = PIECE) -> DataFrame:
    """(id, row, n, level, piece, set): the sets of `_sets`, cut by the leading `level` bits of the hashes; no empty pieces.

    A set comes at its own level and at those of all larger sets that can have the similarity with it. `row` tells
    apart the rows of a repeated id; n is the size of the whole set.
    """

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                d, g = shingle_sets(b.column("text"), n)
                start = np.searchsorted(d, np.arange(b.num_rows + 1))
                parts = []
                for k in np.flatnonzero(np.diff(start)):
                    own = g[start[k] : start[k + 1]]
                    for level in range(_level(len(own), most), _level(100 * len(own) // least, most) + 1):
                        at = np.searchsorted(own, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)) if level else []
                        size = np.diff(np.concatenate([[0], at, [len(own)]]).astype(np.int64))
                        full = np.flatnonzero(size)
                        parts.append((np.full(len(full), k), np.full(len(full), len(own)), np.full(len(full), level, np.int32), full.astype(np.int32), size[full], own))
                if parts:
                    k, size_of, level, piece, size, values = map(np.concatenate, zip(*parts))
                    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    of = [b.column(c).take(pa.array(k)) for c in ("doc_id", "row")]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(size_of), pa.array(level), pa.array(piece), pa.ListArray.from_arrays(at, pa.array(values.view(np.int64)))], names=["id", "row", "n", "level", "piece", "set"])

    found = maybe_among(docs, ids, "doc_id", "maybe").where("maybe and doc_id is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return found.mapInArrow(tidied(run), "id long, row long, n long, level int, piece int, set array<long>")


def _confirmed(pairs: DataFrame, pieces: DataFrame, least: int, most: int = PIECE) -> DataFrame:
    """The pairs whose full shingle sets have the similarity: 100 * intersection >= least * union.

    Both sets of a pair are taken at the larger one's level, and the sizes of their pieces' intersections are added.
    """
    above = f"(greatest(nx, ny) - 1) div {most}"
    cut = pairs.select("x", "y", F.expr(f"if({above} = 0, 0, length(bin({above})))").alias("level")).distinct()
    cut = cut.withColumn("piece", F.expr("explode(sequence(0, shiftleft(1, level) - 1))"))
    key = lambda c: F.struct(F.col(c).alias("id"), "level", "piece")
    cut = cut.select(key("x").alias("x"), key("y").alias("y"))
    one, two = (pieces.select(key("id").alias(k), F.col("row").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("set").alias(f"s{k}")) for k in "xy")
    return (
        salted_join(salted_join(cut, one, "x", "y"), two, "y", "x")
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.level").alias("level"), "rx", "ry", (F.col("nx") + F.col("ny")).alias("both"), F.size(F.array_intersect("sx", "sy")).alias("inter"))
        .groupBy("a", "b", "level", "rx", "ry", "both").agg(F.sum("inter").alias("inter"))
        .where(f"100L * inter >= {least}L * (both - inter)").select("a", "b")
    )


def _links_between(table: pa.Table, least: int) -> pa.Table:
    """Of one block pair: a link from each row of side 0 to each other component of side 1, if there is one.

    Only rows whose signatures are near are compared by their sets. Sizes of intersections come from products of
    incidence matrices, COLUMNS shingles at a time.
    """
    side = np.asarray(table["side"])
    rows = [np.flatnonzero(side == k) for k in (0, 1)]
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, SYMBOLS)
    near = np.zeros((len(rows[0]), len(rows[1])), np.uint8)
    for k in range(SYMBOLS):
        near += sig[rows[0], k][:, None] != sig[rows[1], k][None, :]
    near = near <= MOST_ERRORS
    table, side = table.take(pa.array(np.sort(np.concatenate([r[near.any(1 - k)] for k, r in enumerate(rows)])))), None
    near = near[near.any(1)][:, near.any(0)]
    side = np.asarray(table["side"])
    rows = [np.flatnonzero(side == k) for k in (0, 1)]
    out_x, out_y = [], []
    if near.size:
        rep, comp = np.asarray(table["rep"]), np.asarray(table["c"])
        flat = table["set"].combine_chunks()
        at, values = np.asarray(flat.offsets), np.asarray(flat.values)
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        kinds, column = np.unique(values[at[0] : at[-1]], return_inverse=True)
        both = np.zeros((len(rows[0]), len(rows[1])), np.float32)
        m = [np.empty((len(r), COLUMNS), np.float32) for r in rows]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        place = np.empty(len(side), np.int64)
        for r in rows:
            place[r] = np.arange(len(r))
        for lo in range(0, len(kinds), COLUMNS):
            part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
            for k in (0, 1):
                m[k].fill(0)
                own = side[owner[part]] == k
                m[k][place[owner[part][own]], column[part][own] - lo] = 1
            both += m[0] @ m[1].T
        for k, j in enumerate(rows[0]):
            union = size[j] + size[rows[1]] - both[k].astype(np.int64)
            hits = rows[1][near[k] & (100 * both[k].astype(np.int64) >= least * union) & (comp[rows[1]] != comp[j])]
            _, first = np.unique(comp[hits], return_index=True)
            out_x += [rep[j]] * len(first)
            out_y += rep[hits[first]].tolist()
    return pa.table({"a": pa.array(out_x, pa.int64()), "b": pa.array(out_y, pa.int64())})


def _rest(members: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, n: int, least: int) -> DataFrame:
    """Links between members of one bucket that are still in different components.

    In each such bucket one component has the most members; the others' members are compared, in blocks, with all
    members of the buckets that this component leads. So the work is the product of the stragglers and the rest,
    not of all with all, and blocks of bounded size share it out.
    """
    own = members.where("size > 2").join(found, members.rep == found.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    split = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    open_ = written(own.join(split, "key"), "open")
    top = open_.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("t")).select("key", (-F.col("t.c")).alias("top"))
    led = written(open_.join(top, "key").groupBy("top", "rep", "c").agg(F.lit(1).alias("one")).drop("one"), "led")
    led = led.join(classes.select("rep", "n", "sig"), "rep")
    stray = F.when(F.col("c") != F.col("top"), F.col("n")).otherwise(0)
    many = lambda v: F.ceil(F.greatest(F.sum(v) / BLOCK_SHINGLES, F.count_if(v > 0) / BLOCK_ROWS)).cast("int")
    blocks_of = led.groupBy("top").agg(many(stray).alias("sb"), many(F.col("n")).alias("mb"))
    led = led.join(blocks_of, "top")
    block = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    one = led.where("c != top").select("top", "rep", "sig", "c", F.lit(0).alias("side"), block("sb").alias("s"), "mb").select("top", "rep", "sig", "c", "side", "s", spread("mb").alias("m"))
    two = led.where("sb > 0").select("top", "rep", "sig", "c", F.lit(1).alias("side"), block("mb").alias("m"), "sb").select("top", "rep", "sig", "c", "side", spread("sb").alias("s"), "m")
    sets = written(_sets(docs, led.select(F.col("rep").alias("doc_id")).distinct(), n), "sets")
    rows = one.unionByName(two).join(sets, F.col("rep") == sets["id"]).select("top", "s", "m", "side", "rep", "sig", "c", "set")
    out = written(rows.groupBy("top", "s", "m").applyInArrow(tidied(lambda t: _links_between(t, least)), "a long, b long"), "rest")
    release(open_, sets)
    return out


def near_duplicates(docs: DataFrame, *, shingle: int = 4, least: int = 80, id_col="doc_id", text_col="text", pivots: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Texts are linked from a Jaccard similarity of least / 100 of their `shingle`-word sets; component_id is
    the smallest doc_id that links reach.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sigs = written(signatures(docs, shingle), "sigs")
    known = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows")), "classes")
    keys = _keys(classes)
    # which members are pivots depends on the chunk, so that one unlucky pivot does not leave a group apart
    rank = F.struct(F.xxhash64("rep", F.pmod(F.col("part"), F.lit(pivots))).alias("r"), F.col("rep").alias("pivot"))
    shared = keys.groupBy("key").agg(F.min(rank).alias("p"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size")).where("lo != hi")
    shared = written(shared.select("key", "p.pivot", "size"), "shared")
    members = written(salted_join(keys, shared, "key", "rep", shared.select("key", "size")).select("key", "rep", "pivot", "size"), "members")
    pairs = members.where("rep != pivot").select(F.greatest("rep", "pivot").alias("x"), F.least("rep", "pivot").alias("y")).distinct()
    pairs = written(pairs, "pairs")
    near = written(_near(pairs, classes, least), "near")
    ids = near.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    sets = written(_pieces(docs, ids, shingle, least), "sets")
    links = written(_confirmed(near, sets, least), "links")
    release(shared, pairs, near, sets)
    found = written(components(links), "found")
    rest = _rest(members, found, docs, classes, shingle, least)
    if not rest.isEmpty():
        found = written(components(links.unionByName(rest)), "found")
    of = written(classes.join(found, classes.rep == found.node, "left").select("digest", "rows", F.coalesce("component", "rep").alias("c")), "of")
    release(members, links, rest, classes)
    out = salted_join(sigs, of.select("digest", "c"), "digest", "doc_id", of.select("digest", "rows"), "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicated(docs: DataFrame, *, shingle: int = 5, least: int = 80) -> DataFrame:
    """docs without all but one row of each group of near duplicates: the one with the smallest doc_id, null last.

    Rows are told apart by a number that is written with them, so null and repeated doc_ids are fine.
    """
    columns = docs.columns
    row, maybe = fresh(docs, "row_number", "maybe_gone")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = near_duplicates(docs, shingle=shingle, least=least, id_col=row).where("not kept").select(F.col("doc_id").alias("r"), F.col("component_id").alias("g"))
    near = written(near, "near")
    grouped = near.unionByName(near.select(F.col("g").alias("r"), "g").distinct())
    ranks = docs.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("rank"))
    grouped = written(ranks.join(grouped, "r").select("r", "g", "rank"), "grouped")
    first = grouped.groupBy("g").agg(F.min("rank").alias("first"))
    gone = written(salted_join(grouped, first, "g", "r").where(F.col("r") != F.col("first")[row]).select(F.col("r").alias(row)), "gone")
    release(near, grouped)
    marked = maybe_among(docs, gone, row, maybe)
    rest = marked.where(F.col(maybe)).join(gone, row, "left_anti")
    return marked.where(~F.col(maybe)).select(*columns).unionByName(rest.select(*columns))
