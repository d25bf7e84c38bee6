"""ISO base media containers: a text's bytes as 8-bit audio samples in an MP4 file, and a reader that walks nested
boxes and decodes the sample tables without decoding payloads.

The writer stores a payload as one `raw ` track of unsigned 8-bit mono samples: ftyp, mdat, moov, with the sample
table split into chunks of CHUNK samples; a sync sample table marks every chunk's first sample as a keyframe. The
reader takes any such container: it finds the tracks' codecs, durations and sample sizes, and maps keyframes to
byte ranges through stsc, stco/co64, stsz and stss. 64-bit box sizes and chunk offsets are read and, where needed,
written.

Null text is empty; an empty payload is padded like any other. Very long texts are containers of their own size; an
empty table gives no rows. Malformed containers raise ValueError in `probe`;
the column operator gives them null results instead. Equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, tidied

RATE, CHUNK, BLOCK = 8000, 4096, 64
_CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))
_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *content: bytes) -> bytes:
    size = 8 + sum(map(len, content))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *content))


def full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


def padded(payload: bytes, unit: int = BLOCK) -> bytes:
    """The payload with bytes 0 up to a positive multiple of unit."""
    return payload + bytes(-len(payload) % unit or (0 if payload else unit))


def write(payload: bytes, *, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """An MP4 file whose one audio track holds the payload as 8-bit samples."""
    n = len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    mdat = box(b"mdat", payload)
    base = len(ftyp) + len(mdat) - n
    count = -(-n // chunk) if n else 0
    offsets = [base + k * chunk for k in range(count)]
    if offsets and offsets[-1] >= 1 << 32:
        stco = full(b"co64", struct.pack(f">I{count}Q", count, *offsets))
    else:
        stco = full(b"stco", struct.pack(f">I{count}I", count, *offsets))
    runs = [(1, chunk, 1)] if n >= chunk else []
    if n % chunk:
        runs.append((count, n % chunk, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1) if n else struct.pack(">I", 0)),
        full(b"stss", struct.pack(f">I{count}I", count, *(1 + k * chunk for k in range(count)))),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", 1, n)),
        stco,
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), hdlr, minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), _UNITY, bytes(8), flags=7)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, mdat, box(b"moov", mvhd, box(b"trak", tkhd, mdia))))


def boxes(data, lo: int = 0, hi: int | None = None):
    """(kind, start of content, end) of the boxes between lo and hi, one level."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise ValueError("a box header is cut off")
            (size,), head = struct.unpack_from(">Q", data, lo + 8), 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield kind, lo + head, lo + size
        lo += size


def walk(data, lo: int = 0, hi: int | None = None, path: tuple = ()):
    """All boxes below, depth first, as (path of kinds, start of content, end)."""
    for kind, s, e in boxes(data, lo, hi):
        yield (*path, kind), s, e
        if kind in _CONTAINERS:
            yield from walk(data, s, e, (*path, kind))


@dataclass
class Track:
    kind: str
    codec: str
    timescale: int
    duration: int
    samples: int
    #: Chunks as (first sample, samples, file offset, bytes).
    chunks: list[tuple[int, int, int, int]]
    #: Keyframes as (sample number from 0, first byte, end byte) in the file.
    keyframes: list[tuple[int, int, int]]


def _table(data, at: int, fmt: str, size: int, end: int):
    (n,) = struct.unpack_from(">I", data, at)
    if at + 4 + n * size > end:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(">" + fmt, bytes(data[at + 4 : at + 4 + n * size])))


def _track(data, lo: int, hi: int) -> Track:
    found = {p[-1]: (s, e) for p, s, e in walk(data, lo, hi)}
    try:
        handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
        s, _ = found[b"mdhd"]
        timescale, duration = struct.unpack_from(">IQ" if data[s] else ">II", data, s + (20 if data[s] else 12))
        s, e = found[b"stsd"]
        codec = bytes(data[s + 12 : s + 16]).decode("latin-1")
        s, e = found[b"stsz"]
        fixed, samples = struct.unpack_from(">II", data, s + 4)
        sizes = None if fixed else [x for (x,) in _table(data, s + 8, "I", 4, e)]
        offsets = [x for (x,) in (_table(data, found[b"co64"][0] + 4, "Q", 8, found[b"co64"][1]) if b"co64" in found else _table(data, found[b"stco"][0] + 4, "I", 4, found[b"stco"][1]))]
        runs = _table(data, found[b"stsc"][0] + 4, "III", 12, found[b"stsc"][1])
        sync = [x - 1 for (x,) in _table(data, found[b"stss"][0] + 4, "I", 4, found[b"stss"][1])] if b"stss" in found else range(samples)
    except (KeyError, struct.error) as e:
        raise ValueError(f"a track lacks a table or has it cut off: {e}") from e
    chunks, first = [], 0
    for k, (start, per, _) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(offsets)
        for c in range(start - 1, last):
            if c >= len(offsets):
                raise ValueError("the chunk map names a chunk that is not there")
            per_c = min(per, samples - first)
            chunks.append((first, per_c, offsets[c], per_c * fixed if sizes is None else sum(sizes[first : first + per_c])))
            first += per_c
    keyframes, at = [], 0
    for sample in sync:
        while at < len(chunks) and sample >= chunks[at][0] + chunks[at][1]:
            at += 1
        if at == len(chunks):
            raise ValueError("a keyframe lies beyond the last sample")
        head, _, offset, _ = chunks[at]
        start = offset + (fixed * (sample - head) if sizes is None else sum(sizes[head:sample]))
        keyframes.append((sample, start, start + (fixed or sizes[sample])))
    return Track(handler, codec, timescale, duration, samples, chunks, keyframes)


def probe(data) -> list[Track]:
    """The tracks of a container; payloads are not touched."""
    tracks = []
    for kind, s, e in boxes(data):
        if kind == b"moov":
            tracks += [_track(data, ts, te) for k, ts, te in boxes(data, s, e) if k == b"trak"]
    if not tracks:
        raise ValueError("no track")
    return tracks


def read(data, track: Track) -> bytes:
    """The track's stored bytes, through its chunk map."""
    out = [bytes(data[o : o + n]) for _, _, o, n in track.chunks]
    if any(len(x) != n for x, (_, _, _, n) in zip(out, track.chunks)):
        raise ValueError("a chunk lies beyond the file")
    return b"".join(out)


def feature(t: Track) -> str:
    """Codec, duration, samples, keyframes and the first and last keyframe's byte ranges."""
    ends = [t.keyframes[0], t.keyframes[-1]] if t.keyframes else []
    return f"{t.codec.strip()};{t.kind};{t.duration}/{t.timescale};samples={t.samples};chunks={len(t.chunks)};keyframes={len(t.keyframes)};" + ",".join(f"{a}-{b}" for _, a, b in ends)


def store(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row: the text's padded UTF-8 as a container."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                raw = [(t or "").encode() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([write(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


#: Of `describe`: what is found in the stored form.
FOUND = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframe_ranges array<struct<first:long,end:long>>"


def describe(media: DataFrame, *, media_col="media") -> DataFrame:
    """media without its payload column, and with what the containers hold; malformed or null ones give nulls."""
    kept = [c for c in media.columns if c != media_col]
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]

    def one(data: bytes | None):
        try:
            t = probe(memoryview(data))[0]
            got = read(data, t)
        except (ValueError, TypeError):
            return (None,) * len(types)
        ranges = [{"first": a, "end": b} for _, a, b in t.keyframes]
        return len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(t), t.codec, t.duration / t.timescale if t.timescale else None, ranges

    def run(batches):
        for b in (b for batch in batches for b in blocks(batch, media_col, 4 << 20)):
            cols = zip(*(one(x) for x in b.column(media_col).to_pylist())) if b.num_rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*kept).schema), FOUND])
    return media.select(*kept, media_col).mapInArrow(tidied(run), schema)
