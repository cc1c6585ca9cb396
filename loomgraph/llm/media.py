"""Media columns: ISO base media containers, written and walked without decoding payloads.

probe() walks the nested boxes of a container and decodes its sample tables (stts, stss, stsc, stsz,
stco or co64) into codec, duration and the byte ranges of the keyframes; it never looks at the payload.
mux() stores bytes losslessly as an audio track of 8-bit samples, payload() reads them back by the tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import in_small_batches, materialize, text_of, utf8

UNIT = 192  # bytes of an access unit: 192 samples of 8 bits
RATE = 48_000
UNITS_PER_CHUNK = 64  # the first unit of each chunk is a keyframe
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}


class MediaError(ValueError):
    """The bytes are not a container that can be walked."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container with one 8-bit audio track of the payload, whose length is a multiple of UNIT."""
    if len(payload) % UNIT:
        raise MediaError("the payload must fill whole units")
    units = len(payload) // UNIT
    chunks = -(-units // UNITS_PER_CHUNK)
    rest = units % UNITS_PER_CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    far = len(payload) > 0x7FFF0000

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        runs = [(1, UNITS_PER_CHUNK, 1)] if chunks > 1 or not rest else []
        if rest:
            runs.append((chunks, rest, 1))
        offsets = (first + UNIT * UNITS_PER_CHUNK * np.arange(chunks, dtype=np.int64)).astype(">u8" if far else ">u4")
        keys = (1 + UNITS_PER_CHUNK * np.arange(chunks, dtype=np.int64)).astype(">u4")
        table = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, units, UNIT) if units else struct.pack(">I", 0)),
            _full(b"stss", 0, 0, struct.pack(">I", chunks), keys.tobytes()),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs) if units else 0), b"".join(struct.pack(">III", *r) for r in runs) if units else b""),
            _full(b"stsz", 0, 0, struct.pack(">II", UNIT, units)),
            _full(b"co64" if far else b"stco", 0, 0, struct.pack(">I", chunks), offsets.tobytes()),
        )
        times = struct.pack(">QQIQ", 0, 0, RATE, len(payload))
        media = _box(
            b"mdia",
            _full(b"mdhd", 1, 0, times, struct.pack(">HH", 0x55C4, 0)),
            _full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"payload\0"),
            _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), table),
        )
        track = _full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), matrix, bytes(8))
        return _box(b"moov", _full(b"mvhd", 1, 0, times, struct.pack(">IH10x", 0x10000, 256), matrix, bytes(24), struct.pack(">I", 2)), _box(b"trak", track, media))

    data = struct.pack(">I4s", len(payload) + 8, b"mdat") if not far else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    first = len(head) + len(moov(0)) + len(data)
    return b"".join([head, moov(first), data, payload])


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box between start and end."""
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise MediaError(f"box at {start} is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box {kind!r} at {start} has a wrong size")
        yield kind, body, start + size
        start += size


@dataclass
class Track:
    codec: str = ""
    kind: str = ""
    timescale: int = 0
    duration: int = 0
    units: int = 0
    sizes: np.ndarray | int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray | None = None

    def size_of(self, at: np.ndarray) -> np.ndarray:
        return np.full(len(at), self.sizes, np.int64) if isinstance(self.sizes, int) else self.sizes[at]

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (offset, length) of the keyframes; without a stss table every unit is one."""
        at = np.arange(self.units) if self.keys is None else self.keys[(self.keys >= 0) & (self.keys < self.units)]
        return list(zip(self.offsets[at].tolist(), self.size_of(at).tolist(), strict=True))


def _table(data: memoryview, start: int, end: int, width: int, kind: str = ">u4", skip: int = 0) -> np.ndarray:
    """The entries of a counted table: width numbers each."""
    n = struct.unpack_from(">I", data, start + 4 + skip)[0]
    item = np.dtype(kind).itemsize
    if start + 8 + skip + n * width * item > end:
        raise MediaError("a table is cut off")
    return np.frombuffer(data, kind, n * width, start + 8 + skip).astype(np.int64).reshape(n, width)


def _compact(data: memoryview, start: int, end: int) -> np.ndarray:
    """The sizes of a stz2 table: 4, 8 or 16 bits each, of 4 bits the upper ones first."""
    bits, n = data[start + 7], struct.unpack_from(">I", data, start + 8)[0]
    if bits not in (4, 8, 16):
        raise MediaError(f"compact sizes of {bits} bits")
    if start + 12 + (n * bits + 7) // 8 > end:
        raise MediaError("a table is cut off")
    if bits == 16:
        return np.frombuffer(data, ">u2", n, start + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, start + 12)
    return (raw if bits == 8 else np.stack((raw >> 4, raw & 15), axis=1).ravel()[:n]).astype(np.int64)


def probe(media: bytes) -> list[Track]:
    """The tracks of a container, from its boxes and tables alone; MediaError if they contradict themselves.

    Units of fragments (moof) are not decoded: such a file is a MediaError, too.
    """
    data, tracks = memoryview(media), []

    def walk(start: int, end: int, track: Track | None, found: dict) -> None:
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                own, tables = Track(), {}
                walk(a, b, own, tables)
                _place(own, tables)
                tracks.append(own)
            elif kind == b"moof":
                raise MediaError("units in fragments (moof) are not decoded")
            elif kind in CONTAINERS:
                walk(a, b, track, found)
            elif track is None:
                continue
            elif kind == b"mdhd":
                track.timescale, track.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                track.kind = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                track.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
            elif kind == b"stts":
                found["stts"] = _table(data, a, b, 2)
            elif kind == b"stss":
                found["stss"] = _table(data, a, b, 1)[:, 0] - 1
            elif kind == b"stsc":
                found["stsc"] = _table(data, a, b, 3)
            elif kind == b"stsz":
                one, n = struct.unpack_from(">II", data, a + 4)
                found["stsz"] = (one, n) if one else (_table(data, a, b, 1, skip=4)[:, 0], n)
            elif kind == b"stz2":
                sizes = _compact(data, a, b)
                found["stsz"] = (sizes, len(sizes))
            elif kind in (b"stco", b"co64"):
                found["stco"] = _table(data, a, b, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]

    try:
        walk(0, len(data), None, {})
    except (struct.error, IndexError) as e:
        raise MediaError(str(e)) from e
    if not tracks:
        raise MediaError("no track")
    return tracks


def _place(track: Track, found: dict) -> None:
    """Where each unit of the track lies, from chunk offsets, units per chunk and unit sizes."""
    track.sizes, track.units = found.get("stsz", (0, 0))
    track.keys = found.get("stss")
    chunks, runs = found.get("stco", np.zeros(0, np.int64)), found.get("stsc", np.zeros((0, 3), np.int64))
    if not track.units:
        return
    if not len(runs) or not len(chunks) or runs[0, 0] != 1:
        raise MediaError("units without chunks")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks)).clip(0, len(chunks))))
    if len(per) != len(chunks) or per.sum() != track.units or (per <= 0).any():
        raise MediaError("chunks and units do not agree")
    if "stts" in found and found["stts"][:, 0].sum() != track.units:
        raise MediaError("times and units do not agree")
    sizes = track.size_of(np.arange(track.units))
    before = np.cumsum(sizes) - sizes
    starts = np.cumsum(per) - per
    track.offsets = np.repeat(chunks - before[starts], per) + before


def payload(media: bytes, track: Track) -> bytes:
    """The track's stored bytes, unit by unit as the tables place them."""
    sizes = track.size_of(np.arange(track.units))
    if not track.units:
        return b""
    ends = track.offsets + sizes
    if ends.max() > len(media):
        raise MediaError("units lie beyond the end")
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, track.units) - 1
    view = memoryview(media)
    return b"".join(view[track.offsets[a] : ends[b]] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


def padded(text: bytes) -> bytes:
    """The text with bytes 32 up to a positive multiple of UNIT."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def media_column(text: Column) -> Column:
    """The text, UTF-8 and padded, stored in a container; null and empty texts are one unit of padding, equal texts give equal bytes.

    A payload of 2 GB or more gets 64-bit sizes and offsets; a value of a table holds 2 GB at most, so such a text fails in Spark before.
    """

    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        data, at = utf8(texts)
        raw = data.tobytes()
        return pa.array([mux(padded(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())

    return run(text_of(text))


INFO = "codec string, timescale long, duration long, units long, keyframes array<struct<offset:long,length:long>>, error string, tracks array<struct<codec:string,timescale:long,duration:long,units:long,keyframes:array<struct<offset:long,length:long>>>>"


def media_info(df: DataFrame, column: str = "media") -> DataFrame:
    """Adds a struct `info` of INFO: the first track's codec, duration (in timescale) and keyframe byte ranges, and tracks with these of each.

    Only boxes and tables are read. Null or damaged bytes give a struct with the error and null in the rest;
    repeated rows each count; other columns stay.
    """
    kind = T.StructType.fromDDL(INFO)

    @F.arrow_udf(kind)
    def run(media: pa.Array) -> pa.Array:
        out = []
        for x in media:
            if not x.is_valid:
                out.append({"error": "null"})
                continue
            try:
                tracks = [{"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "units": t.units, "keyframes": [{"offset": a, "length": b} for a, b in t.keyframes()]} for t in probe(x.as_buffer())]
                out.append({**tracks[0], "tracks": tracks})
            except MediaError as e:
                out.append({"error": str(e)})
        ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        fields = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("units", pa.int64()), ("keyframes", ranges)]
        return pa.array(out, pa.struct([*fields, ("error", pa.string()), ("tracks", pa.list_(pa.struct(fields)))]))

    return df.withColumn("info", run(F.col(column)))


KEYFRAMES = "array<struct<offset:long,length:long>>"
DIGEST = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, keyframes {KEYFRAMES}"


def media_digest(media: Column) -> Column:
    """A struct of DIGEST from the stored bytes: the payload is read back by the sample tables.

    Null bytes give null in every field; bytes that are no container of mux() or probe() are a MediaError.
    """

    @F.arrow_udf(T.StructType.fromDDL(DIGEST))
    def run(stored: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in range(10)]
        for x in stored:
            own = x.as_buffer()
            if own is None:
                for c in columns:
                    c.append(None)
                continue
            t = probe(own)[0]
            back = payload(own, t)
            keys = t.keyframes()
            ranges = zlib.crc32(np.array(keys, np.int64).tobytes())
            feature = f"codec={t.codec.strip()} kind={t.kind} timescale={t.timescale} duration={t.duration} units={t.units} keyframes={len(keys)} first={keys[0][0]}+{keys[0][1]} last={keys[-1][0]}+{keys[-1][1]} ranges={ranges:08x}"
            for c, v in zip(columns, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), own.size, hashlib.sha256(own).hexdigest(), feature, t.codec, t.timescale, t.duration, [{"offset": a, "length": b} for a, b in keys]), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
        names = [f.split()[0] for f in DIGEST.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run(media)


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8, unpadded) and the columns of DIGEST of every whole text, read back from its stored form.

    The containers are written to the shared folder as a table and read from there. Null text is empty (one unit of padding); a
    very long text is one container, as media_column() says; null ids stay; repeated rows each give a row; other columns are
    not read; no rows, no result rows.
    """
    rows = in_small_batches(docs).select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), media_column(F.col("text")).alias("media"))
    stored = materialize(rows, "media", compression="zstd")
    return stored.select("doc_id", "n_bytes", media_digest(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")
