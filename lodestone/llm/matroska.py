"""Media columns: Matroska files made of and parsed from bytes.

write() stores bytes as 8-bit mono audio samples (codec A_PCM/INT/LIT) in a Matroska file: EBML header, Segment,
Info, Tracks, Clusters of SimpleBlocks with fixed-size lacing, and Cues. parse() reads any Matroska file: variable-length
element ids and sizes (unknown sizes of Segment and Cluster included), SimpleBlock and BlockGroup/Block, all four
lacings, and Cues, and gives a packet table with timestamps, tracks and byte ranges.

Null texts count as empty. An empty text's payload is one frame of blanks. Equal texts give equal files. Damaged
files raise ValueError in parse(); packets() turns that into a row with an error and no packets, so one bad file does not end the
job. Extra columns pass through, unless they have the name of a result, which replaces them; helper columns take names that no column has. Repeated rows
are repeated, so there are no ties to settle. A very long text is one file, made and parsed in one task, in memory of some times its size. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.llm.shared import columns_free, documents, lean, small_batches

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, FLAG_LACING, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MUXING_APP, WRITING_APP = 0x4D80, 0x5741
#: Elements that may have an unknown size end where one of these begins.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE = 8000  # samples a second
FRAME = 192  # samples a frame: 24 ms
LACED = 16  # frames a block at most
BLOCKS = 64  # blocks a cluster at most


def vint(n: int) -> bytes:
    """An EBML size in as few bytes as it needs."""
    for k in range(1, 9):
        if n < (1 << (7 * k)) - 1:
            return (n | 1 << (7 * k)).to_bytes(k, "big")
    raise ValueError("too large for an EBML size")


def element(id: int, body: bytes) -> bytes:
    return id.to_bytes((id.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(id: int, n: int) -> bytes:
    return element(id, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def write(payload: bytes) -> bytes:
    """A Matroska file whose one audio track holds the payload; its length must be a multiple of FRAME."""
    if len(payload) % FRAME:
        raise ValueError(f"the payload must be a multiple of {FRAME} bytes")
    ms = 1000 * FRAME // RATE
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / RATE * 1000)) + element(MUXING_APP, b"lodestone") + element(WRITING_APP, b"lodestone"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, ms * 1_000_000)
    body = [info, element(TRACKS, element(TRACK_ENTRY, track + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))]
    at, cues = sum(map(len, body)), []
    step = FRAME * LACED
    for lo in range(0, len(payload), step * BLOCKS):
        time = lo // FRAME * ms
        parts = [_uint(TIMESTAMP, time)]
        for b in range(lo, min(len(payload), lo + step * BLOCKS), step):
            data = payload[b : b + step]
            n = len(data) // FRAME
            flags = 0x80 | (0x04 if n > 1 else 0)  # key frame; fixed-size lacing
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // FRAME * ms - time, flags) + (bytes([n - 1]) if n > 1 else b"") + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    size: int
    keyframe: bool
    lacing: int


@dataclass
class Media:
    doc_type: str
    scale: int
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ticks, track, byte of the cluster
    clusters: list[int]  # byte of each


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """An id (keep: with its marker) or a size at a place, and the place after it; a size of ones only is -1."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    k = 9 - data[at].bit_length()
    if at + k > len(data):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + k], "big")
    if not keep:
        n &= (1 << (7 * k)) - 1
        n = -1 if n == (1 << (7 * k)) - 1 else n
    return n, at + k


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, start of the body, end of the body) of the elements from `at` to `end`."""
    while at < end:
        id, body = _number(data, at, True)
        size, body = _number(data, body, False)
        if inside == CLUSTER and id in _TOP:
            return
        if size < 0:
            if id not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size of element {id:x}")
            stop = end
            if id == CLUSTER:  # it ends where an element of the level above begins
                stop = body
                for _, _, _, e in elements(data, body, end, CLUSTER):
                    stop = e
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element {id:x} at byte {at} is cut off")
        yield id, at, body, stop
        at = stop


def _lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block; kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("a laced block without frames")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("fixed-size lacing that does not divide")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while True:
                    byte, at = data[at], at + 1
                    size += byte
                    if byte < 255:
                        break
            else:
                first = at
                size, at = _number(data, at, False)
                if k:  # a difference, its middle at 2**(7*bytes-1)-1
                    size = sizes[-1] + size - ((1 << (7 * (at - first) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("lace sizes beyond the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file; ValueError if it is none or damaged."""
    try:
        return _parse(data)
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"damaged: {e}") from e


def _parse(data: bytes) -> Media:
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    out = Media("", 1_000_000, {}, [], [], [])
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for id, _, a, b in elements(data, top[0][2], top[0][3]):
        if id == 0x4282:
            out.doc_type = data[a:b].rstrip(b"\0").decode()
    for id, _, seg, seg_end in top:
        if id != SEGMENT:
            continue
        for id, first, a, b in elements(data, seg, seg_end):
            if id == INFO:
                for i, _, x, y in elements(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        out.scale = whole(x, y)
            elif id == TRACKS:
                for i, _, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        t = {"number": 0, "type": 0, "codec": "", "default_ns": 0, "rate": 8000.0, "channels": 1, "bits": 0}
                        for j, _, p, q in elements(data, x, y):
                            if j in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                                t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns"}[j]] = whole(p, q)
                            elif j == CODEC_ID:
                                t["codec"] = data[p:q].decode()
                            elif j == AUDIO:
                                for k, _, r, s in elements(data, p, q):
                                    if k == SAMPLING:
                                        t["rate"] = real(r, s)
                                    elif k in (CHANNELS, BIT_DEPTH):
                                        t["channels" if k == CHANNELS else "bits"] = whole(r, s)
                        out.tracks[t["number"]] = t
            elif id == CLUSTER:
                out.clusters.append(first)
                base = 0
                for i, _, x, y in elements(data, a, b, CLUSTER):
                    if i == TIMESTAMP:
                        base = whole(x, y)
                    elif i == SIMPLE_BLOCK:
                        _block(data, x, y, base, True, out)
                    elif i == BLOCK_GROUP:
                        for j, _, p, q in elements(data, x, y):
                            if j == BLOCK:
                                _block(data, p, q, base, False, out)
            elif id == CUES:
                for i, _, x, y in elements(data, a, b):
                    if i == CUE_POINT:
                        time, where = 0, []
                        for j, _, p, q in elements(data, x, y):
                            if j == CUE_TIME:
                                time = whole(p, q)
                            elif j == CUE_TRACK_POSITIONS:
                                got = {k: whole(r, s) for k, _, r, s in elements(data, p, q)}
                                where.append((got.get(CUE_TRACK, 0), seg + got.get(CUE_CLUSTER_POSITION, 0)))
                        out.cues += [(time, t, at) for t, at in where]
    return out


def _block(data: bytes, a: int, b: int, base: int, simple: bool, out: Media) -> None:
    track, at = _number(data, a, False)
    rel, flags = struct.unpack(">hB", data[at : at + 3])
    kind = flags >> 1 & 3
    step = out.tracks.get(track, {}).get("default_ns", 0)
    for k, (start, size) in enumerate(_lace(data, at + 3, b, kind)):
        out.packets.append(Packet(track, (base + rel) * out.scale + k * step, start, size, bool(flags & 0x80) if simple else True, kind))


def samples(data: bytes, media: Media, track: int) -> bytes:
    """A track's packets, one after the other in the order of their timestamps."""
    return b"".join(data[p.start : p.start + p.size] for p in sorted((p for p in media.packets if p.track == track), key=lambda p: (p.timestamp_ns, p.start)))


def feature(pcm: bytes, media: Media) -> str:
    """What the samples sound like, as text: rounded so that it is the same everywhere."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64)
    frames = x.reshape(-1, FRAME)
    span = (frames.max(1) - frames.min(1)).mean()
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    t = media.tracks[1]
    return f"codec={t['codec']} rate={t['rate']:.0f} bits={t['bits']} packets={len(media.packets)} clusters={len(media.clusters)} cues={len(media.cues)} ms={1000 * len(x) // RATE} mean={x.mean():.3f} energy={(x * x).mean():.3f} range={span:.3f} crossings={crossings}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def media_column(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """docs with the text as a Matroska file in a binary column, and its unpadded length."""
    kept = [c for c in docs.columns if c not in (media, n_bytes)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                got = [padded(x) for x in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array([g[1] for g in got], pa.int64()), pa.array([write(g[0]) for g in got], pa.binary())], names=[*kept, n_bytes, media])

    small_batches(docs.sparkSession)
    (body,) = columns_free(docs, "__text")
    return docs.select(*kept, docs[text].alias(body)).mapInArrow(lean(run), schema)


PACKETS = "array<struct<track:int,timestamp_ns:bigint,start:bigint,size:bigint,keyframe:boolean,lacing:int>>"


def packets(files: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of files, with the packet table of each file as `packets` and what is wrong with it as `error`; null is an error."""
    kept = [c for c in files.columns if c not in (media, "packets", "error")]
    schema = T.StructType([files.schema[c] for c in kept] + [T.StructField("packets", T._parse_datatype_string(PACKETS)), T.StructField("error", T.StringType())])
    kind = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                tables, errors = [], []
                for x in part.column(len(kept)).to_pylist():
                    try:
                        if x is None:
                            raise ValueError("null")
                        tables.append([vars(p) for p in parse(x).packets])
                        errors.append(None)
                    except ValueError as e:
                        tables.append([])
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(tables, kind), pa.array(errors, pa.string())], names=[*kept, "packets", "error"])

    (body,) = columns_free(files, "__media")
    return files.select(*kept, files[media].alias(body)).mapInArrow(lean(run), schema)


def digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both."""
    schema = T.StructType([docs.schema[id], *T._parse_datatype_string("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields])
    long, string = pa.int64(), pa.string()

    def row(text: str | None) -> tuple:
        payload, n = padded(text)
        stored = write(payload)
        media = parse(stored)
        back = samples(stored, media, 1)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return n, len(back), sha(back), zlib.crc32(back[-16:]), len(stored), sha(stored), feature(back, media)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = list(zip(*map(row, part.column(1).to_pylist()), strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(v), k) for v, k in zip(got, (long, long, string, long, long, string, string), strict=True))], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.select(id, docs[text].alias("__text")).mapInArrow(lean(run), schema)


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
