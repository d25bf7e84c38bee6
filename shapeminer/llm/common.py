"""Shared pieces of the corpus operators: shared storage, Arrow blocks, vectorised word hashing."""

from __future__ import annotations

import atexit
import inspect
import os
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
BLOCK_BYTES = 1 << 20
_M1, _M2, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x100000001B3


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by the path that they share with the driver."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parents[2]
    seen = {os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if str(home) in seen or getattr(sc, "_shapeminer_shipped", False):
        return
    archive = f"{tempfile.mkdtemp(prefix='shapeminer-')}/shapeminer.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((home / "shapeminer").rglob("*.py")):
            z.write(f, f.relative_to(home))
    sc.addPyFile(archive)
    sc._shapeminer_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where a local session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="shapeminer-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # the exchanges behind it are of no further use
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in tables:
        _drop(df.sparkSession, df._written_path)


#: Bits (log 2) of the id filter.
BLOOM_BITS = 25


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from df's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def maybe_among(df: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """df with one more column, the boolean `flag`: false where the row's id is surely not among `ids` (one column).

    The filter is a hashed bitmap of 2^BLOOM_BITS bits, broadcast as bitmaps of 4 KB, 4 MB at most whatever the
    input; it saves shuffling the other rows' texts. Larger sets of ids make it less selective, never wrong.
    """
    bucket, bits = fresh(df, "bucket_of_ids", "bits_of_ids")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BLOOM_BITS))
    maps = ids.select(place(F.col(f"`{ids.columns[0]}`").cast("long")).alias("p")).select(F.bitmap_bucket_number("p").alias(bucket), F.bitmap_bit_position("p").alias("at"))
    maps = F.broadcast(maps.groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(bits)))
    at = F.bitmap_bit_position(place(df[id_col].cast("long")))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    out = df.withColumn(bucket, F.bitmap_bucket_number(place(df[id_col].cast("long")))).join(maps, bucket, "left")
    return out.select(*(df[c] for c in df.columns), F.coalesce(bit, F.lit(False)).alias(flag))


def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def tidy() -> None:
    """Gives what a Python worker has freed back to the system, so that reused workers do not add up."""
    pa.default_memory_pool().release_unused()
    _libc()(0)


def tidied(run):
    """A function of Arrow batches, or of groups, that leaves its worker tidy."""
    if inspect.isgeneratorfunction(run):

        def wrapped(batches):
            try:
                yield from run(batches)
            finally:
                tidy()

        return wrapped

    # Spark tells functions of a table from those of a key and a table by their parameters
    if len(inspect.signature(run).parameters) == 1:
        return lambda t: _then_tidy(run, t)
    return lambda a, b: _then_tidy(run, a, b)


def _then_tidy(run, *args):
    try:
        return run(*args)
    finally:
        tidy()


#: A key is hot from one in HOT of a join's rows on; so fewer than HOT keys are, and their list may be broadcast.
HOT = 200


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left with the columns of right's one row for its `key`; rows without one go, unless `how` is left.

    A hot key's rows are dealt out by a hash of `by` to as many parts as it has HOTths of left, and right's row is
    copied to each of them: at most 2 * HOT copies in all. counts: (key, n) of left, where they are known.
    """
    salt, parts, n = fresh(left.join(right, key), "salt_of_key", "parts_of_key", "rows_of_key")
    counts = (left.groupBy(key).agg(F.count("*").alias(n)) if counts is None else counts.toDF(key, n)).where(F.col(n) >= HOT)
    total = left.count()
    hot = F.broadcast(counts.where(F.col(n) * HOT > total).select(key, F.ceil(F.col(n) * HOT / max(total, 1)).cast("int").alias(parts)))
    deal = F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col(parts)).cast("int"))
    one = left.join(hot, key, "left").withColumn(salt, deal).drop(parts)
    two = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return one.join(two, [key, salt], how).drop(salt)


def filter_rows(df: DataFrame, keep) -> DataFrame:
    """The rows of df, with all their columns, for which keep(Arrow batch) has true."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                yield b.filter(pa.array(keep(b)))

    return df.mapInArrow(tidied(run), df.schema)


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id's text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def crc_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES):
    """Slices of a batch with about `most` bytes of text; one longer text makes a slice of its own."""
    size = np.cumsum(_lengths(batch.column(text)))
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _lengths(arr) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False), np.int64)


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    import pyarrow.compute as pc

    arr = pc.fill_null(arr, "").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes whose word hashes are computed at once; tables of powers reach as far, and further only for longer words.
STRETCH = 1 << 18
_POW: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if n <= STRETCH + 1 and _POW:
        return _POW
    out = []
    for p in (_P, pow(_P, -1, 1 << 64)):
        step = np.full(max(n, STRETCH + 1), p, np.uint64)
        step[0] = 1
        out.append(np.cumprod(step))
    if n <= STRETCH + 1:
        _POW[:] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _M1
    h = h ^ (h >> np.uint64(32))
    h = h * _M2
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
    """(starts, ends, doc) of the maximal runs of `kind` bytes; runs end where a document does."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ok = kind[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = ok.copy()
    start[1:] &= ~ok[:-1] | first[1:n]
    end = ok.copy()
    end[:-1] &= ~ok[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, which lie in order; computed in stretches, so that the tables stay small."""
    out, lo = np.empty(len(s), np.uint64), 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + STRETCH, "right")))
        part, a, z = data[s[lo] : e[hi - 1]], s[lo:hi] - s[lo], e[lo:hi] - s[lo]
        pw, inv = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * pw[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[z] - total[a]) * inv[a] + (z - a).astype(np.uint64) * _M2)
        lo = hi
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each position; the last n - 1 positions are left out."""
    g = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        g = mix(g * _M1 + h[k : len(h) - n + 1 + k])
    return g


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed together."""
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays), 1)


def unpack(b: bytes, *dtypes) -> list[np.ndarray]:
    raw, out = np.frombuffer(zstandard.decompress(b), np.uint8), []
    at = 4 * len(dtypes)
    for n, dtype in zip(raw[:at].view("<u4").tolist(), map(np.dtype, dtypes)):
        out.append(np.ascontiguousarray(raw[at : at + n * dtype.itemsize].reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
