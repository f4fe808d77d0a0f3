"""Matroska media columns: EBML elements, clusters, lacing and cues, to and from packet tables.

`parse` reads a file's bytes into packets (track, timestamp, byte range of each frame) without copying frames; `mux`
writes samples as one PCM track. Both follow the public EBML (RFC 8794) and Matroska (RFC 9559) specifications.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids: fixed values of the format.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}

RATE, FRAME, LACE, SPAN = 8000, 256, 8, 1 << 14  #: samples a second, bytes of a frame, frames of a block, samples of a cluster


class MediaError(ValueError):
    """Bytes that are no readable Matroska file."""


# ---------------------------------------------------------------- writing


def size_vint(n: int, width: int = 0) -> bytes:
    """A size with its length marker, as short as it goes or ``width`` bytes long (all ones is kept for 'unknown')."""
    width = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(lacing flags, block payload): none for one frame, fixed for equal sizes, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x04, head + b"".join(frames)
    out = [head, size_vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(k for k in range(1, 9) if abs(b - a) < 1 << 7 * k - 1)
        out.append(size_vint(b - a + (1 << 7 * width - 1) - 1, width))
    return 0x06, b"".join(out + frames)


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_ID_LENGTH, 4) + uint(EBML_SIZE_LENGTH, 8) + element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
_TRACK = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """One track of 8-bit PCM; a timestamp unit is a sample. Blocks are laced, clusters are cued."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 10**9 // RATE) + element(MUXING_APP, b"treeline") + element(WRITING_APP, b"treeline") + element(DURATION, struct.pack(">d", len(samples))))
    parts, cues, at = [info, _TRACK], [], len(info) + len(_TRACK)
    for begin in range(0, len(samples), SPAN):
        body = [uint(TIMESTAMP, begin)]
        for first in range(begin, min(begin + SPAN, len(samples)), FRAME * LACE):
            part = samples[first : min(first + FRAME * LACE, begin + SPAN)]
            flags, packed = lace([part[k : k + FRAME] for k in range(0, len(part), FRAME)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", first - begin, 0x80 | flags) + packed))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, begin) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- reading


@dataclass
class Media:
    """Packets as (track, timestamp in ns, first byte, bytes, key frame, cluster); cues as (time in ns, track, cluster byte)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _vint(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int, bool]:
    """(value, next byte, all value bits are ones); ``keep`` leaves the marker, as ids have it."""
    if at >= end or not data[at]:
        raise MediaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MediaError(f"a cut integer at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return raw if keep else value, at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end of the body) of the elements in a range; an unknown size reaches to the range's end."""
    while at < end:
        ident, at, _ = _vint(data, at, end, True)
        size, at, unknown = _vint(data, at, end, False)
        stop = end if unknown else at + size
        if unknown and ident == CLUSTER:  # ends where the next top element begins
            stop = at
            while stop < end:
                inner, body, _ = _vint(data, stop, end, True)
                if inner in _TOP:
                    break
                length, body, _ = _vint(data, body, end, False)
                stop = body + length
        if stop > end:
            raise MediaError(f"element {ident:#x} passes its parent's end")
        yield ident, at, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return {0: lambda x: 0.0, 4: lambda x: struct.unpack(">f", x)[0], 8: lambda x: struct.unpack(">d", x)[0]}.get(b - a, lambda x: 0.0)(data[a:b])


def frame_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of a block's frames: no lacing 0, Xiph 1, fixed 2, EBML 3."""
    if lacing == 0:
        return [(at, end - at)]
    if at >= end:
        raise MediaError("a lace without a count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise MediaError("a fixed lace that its frames do not fill")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise MediaError("a cut lace")
                at += 1
                size += data[at - 1]
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for k in range(count - 1):
            value, then, _ = _vint(data, at, end, False)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (then - at) - 1) - 1))
            at = then
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("a lace longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(data: bytes, a: int, b: int, base: int, simple: bool, cluster: int, media: Media) -> None:
    track, at, _ = _vint(data, a, b, False)
    if at + 3 > b:
        raise MediaError("a cut block")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    when = (base + relative) * media.scale
    for k, (first, size) in enumerate(frame_ranges(data, at + 3, b, flags >> 1 & 3)):
        media.packets.append((track, when + k * step, first, size, bool(flags & 0x80) and simple, cluster))


def parse(data: bytes) -> Media:
    """All packets, tracks and cues; raises `MediaError` for anything that is no whole Matroska file."""
    media, seen = Media(), False
    for ident, a, b in elements(data, 0, len(data)):
        if ident == EBML:
            kind = next((data[x:y] for i, x, y in elements(data, a, b) if i == DOCTYPE), b"matroska")
            if kind.rstrip(b"\0") not in (b"matroska", b"webm"):
                raise MediaError(f"a document of type {kind!r}")
            seen = True
        elif ident == SEGMENT and seen:
            segment = a
            for i, x, y in elements(data, a, b):
                if i == INFO:
                    for j, p, q in elements(data, x, y):
                        if j == TIMESTAMP_SCALE:
                            media.scale = _number(data, p, q)
                        elif j == DURATION:
                            media.duration = _real(data, p, q)
                elif i == TRACKS:
                    for j, p, q in elements(data, x, y):
                        if j == TRACK_ENTRY:
                            _track(data, p, q, media)
                elif i == CLUSTER:
                    number, base = len(media.clusters), 0
                    media.clusters.append(x)
                    for j, p, q in elements(data, x, y):
                        if j == TIMESTAMP:
                            base = _number(data, p, q)
                        elif j == SIMPLE_BLOCK:
                            _block(data, p, q, base, True, number, media)
                        elif j == BLOCK_GROUP:
                            for k, r, s in elements(data, p, q):
                                if k == BLOCK:
                                    _block(data, r, s, base, False, number, media)
                elif i == CUES:
                    for j, p, q in elements(data, x, y):
                        if j == CUE_POINT:
                            time, places = 0, []
                            for k, r, s in elements(data, p, q):
                                if k == CUE_TIME:
                                    time = _number(data, r, s)
                                elif k == CUE_POSITIONS:
                                    place = {m: _number(data, t, u) for m, t, u in elements(data, r, s)}
                                    places.append((place.get(CUE_TRACK, 0), segment + place.get(CUE_CLUSTER, 0)))
                            media.cues += [(time * media.scale, t, c) for t, c in places]
    if not seen:
        raise MediaError("no EBML header")
    return media


def _track(data: bytes, a: int, b: int, media: Media) -> None:
    track = {"number": 0, "codec": "", "frame_ns": 0, "rate": 0.0, "bits": 0}
    for i, x, y in elements(data, a, b):
        if i == TRACK_NUMBER:
            track["number"] = _number(data, x, y)
        elif i == CODEC_ID:
            track["codec"] = data[x:y].decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            track["frame_ns"] = _number(data, x, y)
        elif i == AUDIO:
            for j, p, q in elements(data, x, y):
                if j == FREQUENCY:
                    track["rate"] = _real(data, p, q)
                elif j == BIT_DEPTH:
                    track["bits"] = _number(data, p, q)
    media.tracks[track["number"]] = track


# ---------------------------------------------------------------- columns

PACKETS = "doc_id {0}, packet long, track long, timestamp_ns long, first_byte long, n_bytes long, key_frame boolean, cluster int, error string"


def packets(media: DataFrame, column: str = "media", ident: str = "doc_id") -> DataFrame:
    """The packet table of a binary column: a row per packet, in file order.

    Null gives no row; bytes that cannot be parsed, or hold a number beyond 64 bits, give one row with ``error`` set and the rest null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, value in enumerate(batch.column(1)):
                if not value.is_valid:
                    continue
                try:
                    found = [(k, n, *p, None) for n, p in enumerate(parse(value.as_py()).packets)]
                    if any(abs(x) >= 1 << 63 for row in found for x in row[2:6]):
                        raise MediaError("a number does not fit in 64 bits")
                    rows += found
                except MediaError as error:
                    rows.append((k, *[None] * 7, str(error)))
            if rows:
                of, *rest = zip(*rows)
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *[pa.array(c, t) for c, t in zip(rest, kinds)]], names=["doc_id", "packet", "track", "timestamp_ns", "first_byte", "n_bytes", "key_frame", "cluster", "error"])

    source = media.select(F.col(ident).alias("doc_id"), F.col(column).cast("binary").alias("media"))
    return source.mapInArrow(run, PACKETS.format(source.schema[0].dataType.simpleString()))


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def encode(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a Matroska file of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(1)]
            for k in range(0, len(raw), 512):  # a few files at a time
                part = raw[k : k + 512]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 512), pa.array([len(x) for x in part], pa.int64()), pa.array([mux(padded(x)) for x in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def digest(data: bytes) -> tuple[int, str, int, str]:
    """Payload bytes, their SHA-256, the CRC-32 of the last 64, and a feature line, all from the stored packets."""
    media = parse(data)
    payload = b"".join([data[first : first + size] for _, _, first, size, _, _ in media.packets])
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    change = int(np.count_nonzero(np.diff(samples < 0)))
    feature = f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};samples={len(samples)};sum={int(samples.sum())};energy={int((samples * samples).sum())};crossings={change};peak={int(np.abs(samples).max(initial=0))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature


def round_trip(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row.

    Null and empty texts give 64 zero samples. Equal texts give equal values; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [v.as_buffer().to_pybytes() for v in batch.column(2)]
            rows = [digest(f) for f in files]
            size, sha, crc, feature = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()), pa.array(feature, pa.string())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    stored = encode(docs, text, ident)
    return stored.mapInArrow(run, f"doc_id {stored.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("doc_id", ident)
