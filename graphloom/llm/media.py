"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

``mux_payloads`` stores bytes as the 8-bit PCM samples of an audio track; ``packet_table`` and
``demux`` read any Matroska bytes, whoever wrote them. Times are nanoseconds: ticks of the file's
own scale, and for the further frames of a lace the track's default duration each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import lean_task

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, TIMESTAMP_SCALE, DURATION, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x2AD7B1, 0x4489, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
#: Nanoseconds of a tick where a file doesn't say.
TICK = 1_000_000
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, MUXING_APP, WRITING_APP = 0x4282, 0x4D80, 0x5741
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

LACINGS = ("none", "xiph", "fixed", "ebml")
FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, RATE = 512, 8, 16, 8000
PACKET = "track:int,timestamp:bigint,offset:bigint,size:bigint,keyframe:boolean,lacing:string,lace:int,cluster:bigint"
MEDIA = f"packets array<struct<{PACKET}>>, cues array<struct<time:bigint,track:int,cluster:bigint>>, codecs array<string>, status string"
_PACKET_ARROW = pa.list_(pa.struct([("track", pa.int32()), ("timestamp", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("lace", pa.int32()), ("cluster", pa.int64())]))
_CUE_ARROW = pa.list_(pa.struct([("time", pa.int64()), ("track", pa.int32()), ("cluster", pa.int64())]))


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length EBML size."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | value).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: int) -> bytes:
    """Frames of one block under lacing mode 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if mode == 0:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if mode == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif mode == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
            head += vint(b - a + (1 << (7 * w - 1)) - 1, w)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track whose samples are the payload. The lacing turns with the blocks, and is fixed only where all frames are alike."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"graphloom") + element(WRITING_APP, b"graphloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    head += element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, per = [head], [], FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    at = len(head)
    for c in range(0, len(frames), per):
        start = c * FRAME * 1000 // RATE
        parts = [number(TIMESTAMP, start)]
        for k, b in enumerate(range(c, min(c + per, len(frames)), FRAMES_A_BLOCK)):
            group = frames[b : min(b + FRAMES_A_BLOCK, c + per)]
            mode = 0 if len(group) == 1 else (2, 3, 1)[k % 3] if len(group[-1]) == FRAME else (3, 1)[k % 2]
            relative = b * FRAME * 1000 // RATE - start
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | mode << 1) + lace(group, mode)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


def read_vint(raw: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next place); None is the unknown size."""
    first = raw[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    if at + width > len(raw):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(raw[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def lace_sizes(raw: bytes, at: int, end: int, mode: int) -> tuple[list[int], int]:
    """Frame sizes of a block's body, and where the first frame begins."""
    if mode == 0:
        return [end - at], at
    n, at = raw[at] + 1, at + 1
    if mode == 2:
        if (end - at) % n:
            raise ValueError(f"fixed lacing of {n} frames doesn't divide {end - at} bytes")
        return [(end - at) // n] * n, at
    sizes = []
    for i in range(n - 1):
        if mode == 1:
            size = 0
            while raw[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + raw[at], at + 1
        else:
            value, after = read_vint(raw, at)
            size = value if not i else sizes[-1] + value - (1 << (7 * (after - at) - 1)) + 1
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    return sizes, at


def parse(raw: bytes) -> tuple[list[tuple], list[tuple], list[str], str]:
    """Packets, cues and codecs of a file in file order; status ok, or what is wrong, with all that precedes the fault."""
    packets: list[list] = []
    cues: list[tuple] = []
    codecs: list[str] = []
    segment, cluster, clock, cue_time, cue_track = 0, 0, 0, 0, 0
    scale, entry, group = TICK, 0, 0  # group: the first packet of the block group that is open
    durations: dict[int, int] = {}
    status = ""
    ends: list[tuple[int, int]] = []  # (kind, end) of the masters that are open
    at = 0
    try:
        while at < len(raw):
            while ends and at >= ends[-1][1]:
                ends.pop()
            begin = at
            kind, at = read_vint(raw, at, True)
            size, at = read_vint(raw, at)
            while kind in TOP_LEVEL and ends and ends[-1][0] != SEGMENT:
                ends.pop()  # a cluster of unknown size ends here
            limit = ends[-1][1] if ends else len(raw)
            end = limit if size is None else at + size
            if end > limit:
                raise ValueError(f"element {kind:#x} at {begin} is cut off")
            if kind in MASTERS:
                ends.append((kind, end))
                if kind == SEGMENT:
                    segment = at
                elif kind == CLUSTER:
                    cluster, clock = begin - segment, 0
                elif kind == BLOCK_GROUP:
                    group = len(packets)
                continue
            if kind == TIMESTAMP:
                clock = int.from_bytes(raw[at:end], "big")
            elif kind == TIMESTAMP_SCALE:
                scale = int.from_bytes(raw[at:end], "big") or TICK
            elif kind == TRACK_NUMBER:
                entry = int.from_bytes(raw[at:end], "big")
            elif kind == DEFAULT_DURATION:
                durations[entry] = int.from_bytes(raw[at:end], "big")
            elif kind == REFERENCE_BLOCK:
                for p in packets[group:]:
                    p[4] = False  # it needs another block
            elif kind == CODEC_ID:
                codecs.append(raw[at:end].decode("ascii", "replace"))
            elif kind == CUE_TIME:
                cue_time = int.from_bytes(raw[at:end], "big")
            elif kind == CUE_TRACK:
                cue_track = int.from_bytes(raw[at:end], "big")
            elif kind == CUE_CLUSTER:
                cues.append((cue_time, cue_track, int.from_bytes(raw[at:end], "big")))
            elif kind in (SIMPLE_BLOCK, BLOCK):
                track, p = read_vint(raw, at)
                relative, flags = struct.unpack_from(">hB", raw, p)
                mode = flags >> 1 & 3
                sizes, p = lace_sizes(raw, p + 3, end, mode)
                for i, s in enumerate(sizes):
                    packets.append([track, clock + relative, p, s, kind == BLOCK or flags >= 0x80, LACINGS[mode], i, cluster])
                    p += s
            at = end
    except (ValueError, IndexError, struct.error) as e:
        status = str(e) or "cut off"
    timed = [(p[0], p[1] * scale + p[6] * durations.get(p[0], 0), *p[2:]) for p in packets]
    return timed, [(t * scale, *c) for t, *c in cues], codecs, status or ("ok" if segment else "no segment")


def _each(function, names: list[str], types: list[pa.DataType]):
    """mapInArrow of (key, bytes) rows; function: bytes -> values of the further columns. Rows go out in small batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [function((v.as_buffer().to_pybytes() if v.is_valid else b"")) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return lean_task(task)


def mux_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", align: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of ``align``, as a Matroska file.

    Null text is empty: 64 zero bytes. Rows are independent, so ties and repeated rows each give
    a row, a null id stays, no rows give none, and other columns are ignored. A file depends on
    the text alone. A text of any length is one file, made whole, and takes its size a few times.
    """

    def one(raw: bytes) -> tuple[int, bytes]:
        return len(raw), mux(raw + b"\0" * (-len(raw) % align or (0 if raw else align)))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(_each(one, ["doc_id", "n_bytes", "media"], [pa.int64(), pa.binary()]), "doc_id long, n_bytes long, media binary")


def _demuxed(df: DataFrame, id_col: str, media_col: str, payload: bool) -> DataFrame:
    def one(raw: bytes) -> tuple:
        packets, cues, codecs, status = parse(raw)
        return (packets, cues, codecs, status, *([b"".join(raw[p[2] : p[2] + p[3]] for p in packets)] if payload else []))

    types = [_PACKET_ARROW, _CUE_ARROW, pa.list_(pa.string()), pa.string(), *([pa.binary()] if payload else [])]
    names = [id_col, "packets", "cues", "codecs", "status", *(["payload"] if payload else [])]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {MEDIA}" + ", payload binary" * payload
    return df.select(id_col, F.col(media_col).alias("media")).mapInArrow(_each(one, names, types), schema)


def demux(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each file: packets, cues, codecs, status and payload (the frames' bytes read back, in file order).

    Null or foreign bytes give no packets and a status that isn't ``ok``; a file that is cut off
    gives what precedes the cut.
    """
    return _demuxed(df, id_col, media_col, True)


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id, packet (its number in the file), track, timestamp, offset, size, keyframe, lacing, lace, cluster."""
    return _demuxed(df, id_col, media_col, False).select(id_col, F.posexplode("packets").alias("packet", "p")).select(id_col, "packet", "p.*")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads it back and digests it; the feature tells of packets, clusters, lacings, length and signal (level, and the sum of steps from sample to sample).

    Odd input as in ``mux_payloads``.
    """

    def one(raw: bytes) -> tuple:
        packets, cues, codecs, status = parse(raw)
        payload = b"".join(raw[p[2] : p[2] + p[3]] for p in packets)
        samples = np.frombuffer(payload, np.uint8).astype(np.int16)
        return packets, cues, codecs, status, payload, raw, int(samples.sum(dtype=np.int64)), int(np.abs(np.diff(samples)).sum(dtype=np.int64))

    media = mux_payloads(df, id_col, text_col).select("doc_id", F.struct("n_bytes", "media").alias("m"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                m = part.column(1)
                rows = [one(v.as_buffer().to_pybytes()) for v in m.field("media")]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (_PACKET_ARROW, _CUE_ARROW, pa.list_(pa.string()), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), m.field("n_bytes"), *cols], names=["doc_id", "n_bytes", "packets", "cues", "codecs", "status", "payload", "media", "level", "steps"])

    read = media.mapInArrow(lean_task(task), f"doc_id long, n_bytes long, {MEDIA}, payload binary, media binary, level long, steps long")
    count = lambda name: F.size(F.filter("packets", lambda p: p["lacing"] == name))
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.col("status"), F.array_join("codecs", "+"), F.concat(F.lit("packets="), F.size("packets")), F.concat(F.lit("clusters="), F.size("cues")),
                    *(F.concat(F.lit(f"{n}="), count(n)) for n in LACINGS),
                    F.concat(F.lit("last_ns="), F.coalesce(F.array_max(F.transform("packets", lambda p: p["timestamp"])), F.lit(0))),
                    F.concat(F.lit("level="), F.col("level")), F.concat(F.lit("steps="), F.col("steps")),
                    F.concat(F.lit("crc="), F.hex(F.crc32("payload")))).alias("feature"),
    )
