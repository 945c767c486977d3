"""ISO media containers as columns: write payloads as tracks, and index containers without decoding payloads.

A container is nested boxes. The index walks them, decodes the sample tables (time to sample, sample to chunk,
sizes, chunk offsets, sync samples) and keeps each video or audio track's codec, duration and keyframe byte ranges.
The writer stores bytes losslessly as a track of 8 x 8 pixels of 8 bits: one frame is 64 bytes.
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

from millrace.llm.common import key_texts, map_batches

SIDE = 8
FRAME = SIDE * SIDE
#: Frames a second, frames from one keyframe to the next, frames in a chunk.
TIMESCALE, GOP, CHUNK = 25, 16, 256
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of a frame."""
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b"\0")


def write_media(payload: bytes) -> bytes:
    """A container whose one video track has the payload (whole frames) as uncompressed grey pixels."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHHII4xH", 1, SIDE, SIDE, 0x480000, 0x480000, 1), bytes(32), struct.pack(">Hh", 40, -1))
    large = len(payload) > 0xF0000000

    def head(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
        sync = np.arange(1, frames + 1, GOP)
        stbl = box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, frames, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">3I", *r) for r in runs)),
            _full(b"stsz", struct.pack(">2I", FRAME, frames)),
            _full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        )
        minf = box(b"minf", _full(b"vmhd", bytes(8), flags=1), box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", _full(b"mdhd", struct.pack(">4IHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"qt  ", bytes(4), b"qt  ") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    size = len(head(0))
    return head(size + (16 if len(payload) + 8 >= 1 << 32 else 8)) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def ranges(self) -> list[tuple[int, int]]:
        """Start and end (exclusive) of each keyframe's bytes in the file."""
        return list(zip(self.offsets[self.keys].tolist(), (self.offsets[self.keys] + self.sizes[self.keys]).tolist(), strict=True))

    def payload(self, data: memoryview) -> bytes:
        """The samples' bytes in order; neighbouring ones are read at once."""
        if not len(self.offsets):
            return b""
        ends = self.offsets + self.sizes
        gaps = np.flatnonzero(self.offsets[1:] != ends[:-1])
        starts = self.offsets[np.concatenate([[0], gaps + 1])]
        stops = ends[np.concatenate([gaps, [len(ends) - 1]])]
        return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the bodies of the boxes in data[start:end]; a box that runs out of its parent ends it."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has {size} bytes, its parent ends at {end}")
        yield kind, start + head, start + size
        start += size


def _numbers(data: memoryview, at: int, count: int, kind: str, end: int) -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _trak(data: memoryview, start: int, end: int) -> Track:
    found: dict[bytes, tuple[int, int]] = {}

    def visit(a: int, b: int) -> None:
        for kind, x, y in walk(data, a, b):
            found[kind] = (x, y)
            if kind in CONTAINERS:
                visit(x, y)

    visit(start, end)
    track = Track()
    if b"hdlr" in found:
        track.handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
    if b"mdhd" in found:
        at = found[b"mdhd"][0]
        track.timescale, track.duration = struct.unpack_from(">IQ" if data[at] == 1 else ">II", data, at + (20 if data[at] == 1 else 12))
    if b"stsd" in found:
        at = found[b"stsd"][0]
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    if not {b"stsz", b"stz2"} & found.keys() or b"stsc" not in found or not {b"stco", b"co64"} & found.keys():
        return track
    same = 0
    if b"stsz" in found:
        at, stop = found[b"stsz"]
        same, count = struct.unpack_from(">2I", data, at + 4)
        sizes = _numbers(data, at + 12, count, ">u4", stop) if same == 0 else None
    else:
        at, stop = found[b"stz2"]
        width, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if width == 4:
            pairs = _numbers(data, at + 12, (count + 1) // 2, "u1", stop)
            sizes = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:count]
        elif width in (8, 16):
            sizes = _numbers(data, at + 12, count, f">u{width // 8}", stop)
        else:
            raise ValueError(f"sample sizes of {width} bits")
    at, stop = found.get(b"stco") or found[b"co64"]
    chunk = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4" if b"stco" in found else ">u8", stop)
    at, stop = found[b"stsc"]
    runs = _numbers(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4", stop).reshape(-1, 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1)))
    if per.sum() != count or same and count * same > len(data):
        raise ValueError(f"the chunks hold {per.sum()} samples, the sizes are {count}")
    track.sizes = np.full(count, same, np.int64) if sizes is None else sizes
    before = np.cumsum(track.sizes) - track.sizes
    first = np.repeat(np.cumsum(per) - per, per)
    track.offsets = np.repeat(chunk, per) + before - before[first] if count else np.zeros(0, np.int64)
    track.keys = np.arange(count)
    if b"stss" in found:
        at, stop = found[b"stss"]
        track.keys = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4", stop) - 1
    if b"stts" in found and not track.duration:
        at, stop = found[b"stts"]
        t = _numbers(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4", stop).reshape(-1, 2)
        track.duration = int((t[:, 0] * t[:, 1]).sum())
    return track


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of a container; ValueError or struct.error where it is damaged."""
    view = memoryview(data)
    return [_trak(view, a, b) for kind, x, y in walk(view, 0, len(view)) if kind == b"moov" for k, a, b in walk(view, x, y) if k == b"trak"]


INDEX = "tracks array<struct<codec: string, handler: string, timescale: long, duration: long, n_samples: long, keyframes: array<struct<start: long, end: long>>>>"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of docs (doc_id, text): the text's UTF-8 bytes, padded, as a container."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            return pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_media(pad(x)) for x in raw], pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

        return step

    return map_batches(key_texts(docs), make, "doc_id long, n_bytes long, media binary")


def index_media(media: DataFrame, digests: bool = False) -> DataFrame:
    """For (doc_id, n_bytes, media): the index of each track in the file's order, error, and with digests what the container and the first
    track's stored bytes hash to.

    A null or damaged container has null tracks and a text in error; one without tracks too. Repeated rows give repeated results, no
    rows none.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, n, scalar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = scalar.as_py()
                row = {"doc_id": doc_id, "n_bytes": n}
                try:
                    tracks = read_tracks(data) if data is not None else []
                    if not tracks:
                        row["error"] = "no media" if data is None else "no track"
                    else:
                        row["tracks"] = [{"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"start": a, "end": b} for a, b in t.ranges()]} for t in tracks]
                    if tracks and digests:
                        payload = tracks[0].payload(memoryview(data))
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-FRAME:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                except (ValueError, IndexError, struct.error) as e:
                    row = {"doc_id": doc_id, "n_bytes": n, "error": str(e) or "damaged"}
                rows.append(row)
            return pa.RecordBatch.from_pylist(rows, schema)

        return step

    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64())]
    text = "doc_id long, n_bytes long"
    if digests:
        kinds += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
        text += ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    track = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", ranges)])
    kinds += [("tracks", pa.list_(track)), ("error", pa.string())]
    schema = pa.schema(kinds)
    return map_batches(media.select("doc_id", "n_bytes", "media"), make, f"{text}, {INDEX}, error string")


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a container, and what reading it back gives: sizes and digests of payload and container, and the
    index as a feature string. Null texts count as empty (one frame of zeros); equal texts have equal values; repeated rows
    give repeated results, no rows none."""
    found = index_media(media_column(docs), digests=True).withColumn("track", F.try_element_at("tracks", F.lit(1)))
    found = found.select("*", "track.*").drop("track", "tracks")
    first, last = F.try_element_at("keyframes", F.lit(1)), F.try_element_at("keyframes", F.lit(-1))
    feature = F.format_string("codec=%s timescale=%d duration=%d samples=%d keyframes=%d first=%d-%d last=%d-%d", F.trim("codec"), "timescale", "duration", "n_samples", F.size("keyframes"), first["start"], first["end"], last["start"], last["end"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", (F.col("duration") / F.col("timescale")).alias("seconds"), "keyframes")
