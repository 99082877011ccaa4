"""Media columns: Matroska files in a binary column, and their packets as tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, prepare_tasks

# Element ids of the format.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 192
#: Samples a second: a frame lasts 24 ms.
RATE = 8000
BLOCK_FRAMES = 8
CLUSTER_BLOCKS = 32
PAD = b" "


class Packet(NamedTuple):
    track: int
    timestamp: int
    duration: int | None
    cluster: int
    block: int
    frame: int
    lacing: str
    keyframe: bool
    start: int
    end: int


class Media(NamedTuple):
    doc_type: str
    timestamp_scale: int
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]


def element_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length size; the value with all bits set is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(i: int, body: bytes) -> bytes:
    return element_id(i) + size_bytes(len(body)) + body


def unsigned(i: int, value: int) -> bytes:
    return element(i, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block after its flags."""
    if lacing == NO_LACING:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    return element(SIMPLE_BLOCK, size_bytes(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + lace(frames, lacing))


def encode(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` as one track of unsigned 8-bit samples, frames of 192 laced by eight.

    ``payload`` must be a positive multiple of 192 bytes. Blocks of a cluster take fixed, Xiph and EBML lacing in turn;
    single frames are not laced. Each cluster has a cue. The bytes depend on ``payload`` only.
    """
    if not payload or len(payload) % FRAME:
        raise ValueError("payload must be a positive multiple of the frame size")
    ms = FRAME * 1000 // RATE
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">f", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    track = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_TYPE, 2) + unsigned(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    step = FRAME * BLOCK_FRAMES
    for c in range(0, len(payload), step * CLUSTER_BLOCKS):
        time, body = c // FRAME * ms, [unsigned(TIMESTAMP, c // FRAME * ms)]
        for k, b in enumerate(range(c, min(len(payload), c + step * CLUSTER_BLOCKS), step)):
            frames = [payload[i : i + FRAME] for i in range(b, min(len(payload), b + step), FRAME)]
            body.append(block(1, k * BLOCK_FRAMES * ms, frames, NO_LACING if len(frames) == 1 else (FIXED, XIPH, EBML_LACING)[k % 3]))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and the offset after it; None for an unknown size."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length number at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value ^= 1 << 7 * width
    return (None if value == (1 << 7 * width) - 1 else value), at + width


#: What can follow a segment or cluster of unknown size, and so ends it.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}


def children(data: bytes, start: int, end: int, of_cluster: bool = False) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of the elements in a range; an unknown size lasts to the next element of a higher level."""
    while start < end:
        i, at = read_vint(data, start, keep_marker=True)
        if of_cluster and i in TOP_LEVEL:
            return
        n, at = read_vint(data, at)
        if n is None:
            stop = end
            if i == CLUSTER:
                stop = at
                for _, _, stop in children(data, at, end, of_cluster=True):
                    pass
        else:
            stop = at + n
        if stop > end:
            raise ValueError(f"element {i:#x} at {start} is cut short")
        yield i, at, stop
        start = stop


def number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def unlace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block."""
    if lacing == NO_LACING:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("frames of a fixed lacing differ in size")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                before = at
                n, at = read_vint(data, at)
                if k:
                    n = sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    ranges = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("laced frames exceed their block")
        ranges.append((at, at + n))
        at += n
    return ranges


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a file; raises ValueError if an element is cut short or malformed.

    A packet lasts its share of its block's duration if the block has one, else its track's default duration, else it is not
    known how long. A laced packet comes after those before it; where durations aren't known it has its block's timestamp.
    """
    doc_type, scale, tracks, packets, cues, clusters = "", 1_000_000, [], [], [], []
    for i, a, b in children(data, 0, len(data)):
        if i == EBML:
            doc_type = next((data[x:y].decode() for j, x, y in children(data, a, b) if j == DOC_TYPE), "")
        if i != SEGMENT:
            continue
        for j, x, y in children(data, a, b):
            if j == INFO:
                scale = next((number(data, p, q) for k, p, q in children(data, x, y) if k == TIMESTAMP_SCALE), scale)
            elif j == TRACKS:
                for k, p, q in children(data, x, y):
                    if k == TRACK_ENTRY:
                        e = {m: (u, v) for m, u, v in children(data, p, q)}
                        s = {m: (u, v) for m, u, v in children(data, *e[AUDIO])} if AUDIO in e else {}
                        codec = data[slice(*e[CODEC_ID])].decode() if CODEC_ID in e else ""
                        tracks.append({"track": number(data, *e[TRACK_NUMBER]), "codec": codec, "bit_depth": number(data, *s[BIT_DEPTH]) if BIT_DEPTH in s else None, "duration_ns": number(data, *e[DEFAULT_DURATION]) if DEFAULT_DURATION in e else None})
            elif j == CLUSTER:
                time, nth = 0, 0
                clusters.append(x)
                for k, p, q in children(data, x, y):
                    if k == TIMESTAMP:
                        time = number(data, p, q)
                    group = list(children(data, p, q)) if k == BLOCK_GROUP else []
                    lasts = next((number(data, u, v) for m, u, v in group if m == BLOCK_DURATION), None)
                    for u, v, simple in [(p, q, True)] if k == SIMPLE_BLOCK else [(u, v, False) for m, u, v in group if m == BLOCK]:
                        track, at = read_vint(data, u)
                        relative, flags = struct.unpack_from(">hB", data, at)
                        lacing = flags >> 1 & 3
                        frames = unlace(data, at + 3, v, lacing)
                        own = next((e["duration_ns"] for e in tracks if e["track"] == track), None)
                        ticks = lasts / len(frames) if lasts is not None else own / scale if own is not None else None
                        for f, (s, t) in enumerate(frames):
                            begin = time + relative + round(f * (ticks or 0))
                            packets.append(Packet(track, begin, None if ticks is None else round(ticks), len(clusters) - 1, nth, f, LACINGS[lacing], simple and bool(flags & 0x80), s, t))
                        nth += 1
            elif j == CUES:
                for k, p, q in children(data, x, y):
                    if k == CUE_POINT:
                        c = {m: (u, v) for m, u, v in children(data, p, q)}
                        pos = {m: (u, v) for m, u, v in children(data, *c[CUE_POSITIONS])}
                        cues.append((number(data, *c[CUE_TIME]), number(data, *pos[CUE_TRACK]), a + number(data, *pos[CUE_CLUSTER])))
    return Media(doc_type, scale, tracks, packets, cues, clusters)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of ``text`` filled with spaces to a positive multiple of the frame size, and its length before."""
    data = (text or "").encode()
    return data + PAD * (-len(data) % FRAME or (FRAME if not data else 0)), len(data)


MEDIA = "doc_id {}, n_bytes long, media binary"


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text stored losslessly as a Matroska file of 8-bit samples.

    Null text counts as empty and gives one frame of spaces. Ids may be null or repeat; each row has its own file, and equal
    texts have equal files. Empty input gives no rows. Other columns are ignored.
    """
    prepare_tasks(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 4 << 20):
            made = [padded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(store, MEDIA.format(dict(docs.dtypes)[id_col]))


PACKETS = "track int, timestamp long, duration long, cluster int, block int, frame int, lacing string, keyframe boolean, start long, end long"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: doc_id and the fields of ``Packet``; ``timestamp`` and ``duration`` in ticks of the file's scale, byte range end exclusive.

    Null media gives no packets; a malformed file raises, and Spark reports the task. Ids may be null or repeat. Empty input gives
    no rows. Other columns are ignored.
    """
    prepare_tasks(media.sparkSession)

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "media", 1 << 20):
            ids, rows = [], []
            for doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                found = parse(data).packets if data is not None else []
                ids += [doc_id] * len(found)
                rows += found
            columns = list(zip(*rows)) or [[] for _ in Packet._fields]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *Packet._fields]
            )

    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(packets, f"doc_id {dict(media.dtypes)[id_col]}, {PACKETS}")


def features(data: bytes) -> dict:
    """Figures of one stored file, all of them from its packets read back."""
    media = parse(data)
    if not media.packets:
        raise ValueError("no packets")
    payload = b"".join([data[p.start : p.end] for p in media.packets])
    counts = dict.fromkeys(LACINGS, 0)
    for p in media.packets:
        counts[p.lacing] += 1
    cues_ok = len(media.cues) == len(media.clusters) and all(data[at : at + 4] == element_id(CLUSTER) for _, _, at in media.cues)
    feature = {
        "tracks": len(media.tracks), "clusters": len(media.clusters), "packets": len(media.packets), "cues": len(media.cues), "cues_ok": int(cues_ok),
        "end_ms": max(p.timestamp + (p.duration or 0) for p in media.packets) * media.timestamp_scale // 1_000_000,
        **{f"laced_{k}": v for k, v in counts.items()}, "level": int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) // len(payload),
    }
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": ";".join(f"{k}={v}" for k, v in feature.items()),
    }


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of each row of ``text_to_media``, from the stored bytes alone.

    Null media gives nulls; a malformed file raises. Ids may be null or repeat, each row has its own result. Empty input gives no
    rows. Other columns are ignored.
    """
    prepare_tasks(media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "media", 4 << 20):
            found = [features(m) if m is not None else {} for m in batch.column("media").to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([f.get(n) for f in found], k) for n, k in zip(names, kinds))], ["doc_id", "n_bytes", *names]
            )

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media file for each document, read back. Null and empty texts are one frame of spaces; equal texts give equal rows but for the id."""
    stored = materialize(text_to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return media_features(stored)


def media_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packet table of each document's file says: packets, blocks, clusters, times in ms and bytes."""
    stored = materialize(text_to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return packet_table(stored).groupBy("doc_id").agg(
        F.count("*").alias("packets"), F.count_distinct("cluster", "block").alias("blocks"), F.count_distinct("cluster").alias("clusters"),
        F.sum("timestamp").alias("sum_ms"), F.max(F.col("timestamp") + F.col("duration")).alias("end_ms"), F.sum(F.col("end") - F.col("start")).alias("bytes"),
        F.count_if("keyframe").alias("keyframes"),
    )


MEDIA_PACKETS_SQL = f"""
WITH n AS (SELECT doc_id, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / {FRAME}))::BIGINT AS p FROM documents)
SELECT doc_id, p AS packets, ceil(p / {BLOCK_FRAMES})::BIGINT AS blocks, ceil(p / {BLOCK_FRAMES * CLUSTER_BLOCKS})::BIGINT AS clusters,
       ({FRAME * 1000 // RATE} * p * (p - 1) // 2)::BIGINT AS sum_ms, ({FRAME * 1000 // RATE} * p)::BIGINT AS end_ms, ({FRAME} * p)::BIGINT AS bytes, p AS keyframes FROM n
"""
