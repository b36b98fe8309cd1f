"""Matroska media columns: write payloads as PCM tracks, parse EBML back into packet tables.

The container layout (element ids, vint coding, lacing) is the public Matroska / EBML specification (RFC 9559, 8794).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import texts

# Element ids of the Matroska specification.
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, TYPE, LACED, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, STAMP, SIMPLE, GROUP, BLOCK, SPAN = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_AT}
TOP = {INFO, TRACKS, CLUSTER, CUES}  # what ends a cluster of unknown size

SAMPLE_RATE, FRAME, LACE, BLOCKS = 8000, 1024, 8, 16  # a frame lasts 128 ms; a cluster holds 128 KiB, about 16 s


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def vint(n: int) -> bytes:
    """EBML size: the shortest length whose value bits aren't all ones."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _element(i: int, body: bytes) -> bytes:
    return _id(i) + vint(len(body)) + body


def _uint(i: int, n: int) -> bytes:
    return _element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], at: int) -> bytes:
    """A SimpleBlock of track 1; equal frames get fixed-size lacing, others EBML lacing."""
    head = b"\x81" + struct.pack(">h", at)
    if len(frames) == 1:
        return _element(SIMPLE, head + b"\x80" + frames[0])
    if len({len(f) for f in frames}) == 1:
        return _element(SIMPLE, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes = vint(len(frames[0]))
    for a, b in zip(frames, frames[1:-1], strict=False):
        d, k = len(b) - len(a), 1
        while abs(d) >= (1 << 7 * k - 1) - 1:
            k += 1
        sizes += (d + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return _element(SIMPLE, head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """Store a payload as unsigned 8-bit mono PCM: clusters of laced SimpleBlocks and one cue for each cluster."""
    ms = len(payload) * 1000 // SAMPLE_RATE
    track = _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _uint(LACED, 1) + _element(CODEC, b"A_PCM/INT/LIT")
    track += _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    head = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", ms)))
    body = [head + _element(TRACKS, _element(ENTRY, track))]
    at, cues, step = len(body[0]), [], FRAME * LACE
    for start in range(0, len(payload), step * BLOCKS):
        stamp = start * 1000 // SAMPLE_RATE
        blocks = []
        for b in range(start, min(len(payload), start + step * BLOCKS), step):
            part = payload[b : b + step]
            blocks.append(_laced([part[i : i + FRAME] for i in range(0, len(part), FRAME)], (b - start) * 1000 // SAMPLE_RATE))
        cues.append(_element(POINT, _uint(CUE_TIME, stamp) + _element(CUE_AT, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(_element(CLUSTER, _uint(STAMP, stamp) + b"".join(blocks)))
        at += len(body[-1])
    body.append(_element(CUES, b"".join(cues)))
    return _element(EBML, _element(DOCTYPE, b"matroska")) + _element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next position); ``keep`` leaves the length marker in (ids). An all-ones size means unknown: -1."""
    first = data[at]
    if not first:
        raise ValueError(f"no vint at {at}")
    k = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + k], "big")
    if at + k > len(data):
        raise ValueError(f"vint at {at} is cut off")
    if not keep:
        n ^= 1 << 7 * k
        n = -1 if n == (1 << 7 * k) - 1 else n
    return n, at + k


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the (offset, size) of each frame of a block."""
    track, at = read_vint(data, at)
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, rel, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:  # Xiph: runs of 255
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:  # EBML: a size, then signed differences
        for i in range(n - 1):
            before = at
            value, at = read_vint(data, at)
            if value < 0:
                value = (1 << 7 * (at - before)) - 1
            sizes.append(value if not i else sizes[-1] + value - (1 << 7 * (at - before) - 1) + 1)
    else:  # fixed
        if (end - at) % n:
            raise ValueError("fixed lacing does not divide its block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, rel, flags, out


def parse(data: bytes) -> dict:
    """Packets [(track, timestamp ms, offset, size, lacing, keyframe)], cues [(time, track, offset)], tracks, scale, clusters."""
    out: dict = {"packets": [], "cues": [], "tracks": {}, "clusters": [], "scale": 1_000_000, "doctype": ""}
    state = {"stamp": 0, "segment": 0, "cue": 0, "cue_track": 0, "track": 0}

    def block(a: int, b: int, simple: bool) -> None:
        track, rel, flags, frames = _frames(data, a, b)
        per = out["tracks"].get(track, {}).get("bytes_per_s", 0)
        ticks = (state["stamp"] + rel) * out["scale"] / 1e6
        start = frames[0][0]
        for at, size in frames:
            out["packets"].append((track, round(ticks + ((at - start) * 1000 // per if per else 0)), at, size, flags >> 1 & 3, bool(flags & 0x80) or not simple))

    def walk(at: int, end: int, inside: int) -> int:
        while at < end:
            begun = at
            i, body = read_vint(data, at, True)
            if inside == CLUSTER and i in TOP:
                return begun
            size, body = read_vint(data, body)
            stop = end if size < 0 else body + size
            if stop > end:
                raise ValueError(f"element {i:x} at {begun} passes its parent's end")
            value = int.from_bytes(data[body:stop], "big") if i not in MASTERS and stop - body <= 8 else 0
            if i == SEGMENT:
                state["segment"] = body
            elif i == CLUSTER:
                out["clusters"].append(begun)
            elif i == STAMP:
                state["stamp"] = value
            elif i == SIMPLE or i == BLOCK:
                block(body, stop, i == SIMPLE)
            elif i == SCALE:
                out["scale"] = value
            elif i == DOCTYPE:
                out["doctype"] = data[body:stop].decode()
            elif i == NUMBER:
                state["track"] = value
                out["tracks"][value] = {"codec": "", "rate": 0.0, "depth": 8, "channels": 1, "bytes_per_s": 0}
            elif i == CODEC:
                out["tracks"][state["track"]]["codec"] = data[body:stop].decode()
            elif i == RATE:
                out["tracks"][state["track"]]["rate"] = struct.unpack(">d" if stop - body == 8 else ">f", data[body:stop])[0]
            elif i == DEPTH:
                out["tracks"][state["track"]]["depth"] = value
            elif i == CHANNELS:
                out["tracks"][state["track"]]["channels"] = value
            elif i == CUE_TIME:
                state["cue"] = value
            elif i == CUE_TRACK:
                state["cue_track"] = value
            elif i == CUE_CLUSTER:
                out["cues"].append((state["cue"], state["cue_track"], state["segment"] + value))
            if i in MASTERS:
                stop = walk(body, stop, i)
            if i == ENTRY:
                t = out["tracks"][state["track"]]
                t["bytes_per_s"] = int(t["rate"] * t["channels"] * t["depth"] // 8)
            at = stop
        return at

    walk(0, len(data), 0)
    return out


def payload_of(text: bytes) -> bytes:
    """The text's bytes, followed by bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def feature(parsed: dict, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    laced = sum(p[4] > 0 for p in parsed["packets"])
    return (
        f"packets={len(parsed['packets'])} laced={laced} clusters={len(parsed['clusters'])} cues={len(parsed['cues'])} "
        f"last_ms={parsed['packets'][-1][1]} mean={x.mean():.4f} rms={np.sqrt((x * x).mean()):.4f} "
        f"crossings={int(np.count_nonzero(np.diff(x < 0)))}"
    )


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as a Matroska file, read the file back by its packet table, and describe what was read.

    Row by row and map-only. Null and empty texts store 64 zero bytes; a null id stays null; other columns of
    ``docs`` are not read; repeated rows give repeated results; an empty table gives an empty one. ``with_media``
    also returns the container itself (``media``).
    """
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" if with_media else ""

    def run(batches):
        for batch, raw in texts(batches, "_text"):
            rows = []
            for text in raw:
                media = mux(payload_of(text))
                parsed = parse(media)
                if any(media[at : at + 4] != b"\x1f\x43\xb6\x75" for _, _, at in parsed["cues"]):
                    raise ValueError("a cue does not point at a cluster")
                back = b"".join(media[at : at + size] for _, _, at, size, _, _ in parsed["packets"])
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed, back), media))
            cols = list(zip(*rows, strict=True))[: 8 if with_media else 7]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=[id_col, *"n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature media".split()][: 9 if with_media else 8])

    src = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text"))
    return src.mapInArrow(run, schema)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each Matroska file: track, codec, timestamp, byte range, lacing, and the cue that seeks to it.

    Null media give no rows; malformed files give one row with ``error`` set and null packet columns.
    """
    schema = f"{id_col} long, packet int, track long, codec string, timestamp_ms long, byte_offset long, byte_size long, lacing string, keyframe boolean, cue_offset long, error string"
    kinds = ["none", "xiph", "fixed", "ebml"]

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    p = parse(data)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((i, *[None] * 9, str(e) or type(e).__name__))
                    continue
                for k, (track, ms, at, size, lace, key) in enumerate(p["packets"]):
                    cue = max((c for t, n, c in p["cues"] if n == track and t <= ms and c <= at), default=None)
                    rows.append((i, k, track, p["tracks"].get(track, {}).get("codec"), ms, at, size, kinds[lace], key, cue, None))
            if rows:
                names = [f.split()[0] for f in schema.split(", ")]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.select(media[id_col].cast("long").alias(id_col), media[media_col].alias("_media")).mapInArrow(run, schema)
