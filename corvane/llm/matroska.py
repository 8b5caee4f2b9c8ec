"""Matroska media columns: a writer and a parser of EBML, and packet tables.

The writer stores bytes as one track of 8-bit PCM samples: 576 samples a frame at 57,600 Hz, so a frame
lasts 10 ms. Frames are laced into SimpleBlocks, blocks stand in clusters, and cues name each cluster.
The parser reads variable-length ids and sizes (unknown sizes too), clusters, BlockGroups and
SimpleBlocks with no, Xiph, EBML or fixed lacing, and cues.

Null payloads are empty; an empty payload is stored as one frame of padding. A null or damaged media
value gives no packets, and `info.error` says why. Repeated rows give repeated results, an empty table gives no rows, and
other columns of the input do not matter, whatever their names. Payloads of any length are stored whole, in as many clusters as they
take; a chunk holds one long payload alone.
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

from corvane.llm.common import chunks, mapped

FRAME = 576
FRAME_MS = 10
#: Bytes at the end of a payload that get a checksum of their own.
TAIL = 32
BLOCK_FRAMES = 8
CLUSTER_BLOCKS = 16
PAD = 255

# Element ids of the public Matroska specification.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, BITS = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
LACINGS = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


def vint(n: int, width: int = 0) -> bytes:
    """A size: the leading zero bits of the first byte tell the width; all ones are kept for unknown sizes."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: str) -> bytes:
    """The lacing head of a block's frames and then the frames."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == "none":
        head = b""
    elif lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes[:-1], sizes[1:-1]):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
            head += vint(b - a + (1 << (7 * w - 1)) - 1, w)
    return head + b"".join(frames)


def write(payload: bytes, lacing: str = "ebml") -> bytes:
    """A Matroska file of a payload whose length is a multiple of the frame's."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    per_block = 1 if lacing == "none" else BLOCK_FRAMES
    blocks = [(i * FRAME_MS, frames[i : i + per_block]) for i in range(0, len(frames), per_block)]
    track = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(FRAME_NS, FRAME_MS * 1_000_000)
    track += element(AUDIO, element(RATE, struct.pack(">d", FRAME * 1000 / FRAME_MS)) + number(CHANNELS, 1) + number(BITS, 8))
    body = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * FRAME_MS)))) + element(TRACKS, element(ENTRY, track))
    parts, at, cues = [body], len(body), []
    for i in range(0, len(blocks), CLUSTER_BLOCKS):
        start = blocks[i][0]
        cluster = number(TIME, start)
        for t, group in blocks[i : i + CLUSTER_BLOCKS]:
            kind = lacing if len(group) > 1 else "none"
            cluster += element(SIMPLE, vint(1) + struct.pack(">hB", t - start, 0x80 | LACINGS[kind] << 1) + lace(group, kind))
        parts.append(element(CLUSTER, cluster))
        cues.append(element(POINT, number(CUE_TIME, start) + element(PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    head = element(EBML, element(DOCTYPE, b"matroska"))
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds. packets: track, timestamp in ticks, offset and size in the file, key frame, cluster, lacing."""

    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    doctype: str = ""
    error: str | None = None


class Parser:
    def __init__(self, data: bytes):
        self.data, self.media, self.segment = data, Media(), 0

    def ident(self, at: int) -> tuple[int, int]:
        first = self.data[at]
        width = 9 - first.bit_length()
        if not 1 <= width <= 4 or at + width > len(self.data):
            raise ValueError(f"no element id at byte {at}")
        return int.from_bytes(self.data[at : at + width], "big"), at + width

    def size(self, at: int) -> tuple[int | None, int]:
        width = 9 - self.data[at].bit_length()
        if not 1 <= width <= 8 or at + width > len(self.data):
            raise ValueError(f"no size at byte {at}")
        n = int.from_bytes(self.data[at : at + width], "big") & ((1 << 7 * width) - 1)
        return (None if n == (1 << 7 * width) - 1 else n), at + width

    def children(self, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Id, start and end of the bodies of the elements in a range."""
        while at < end:
            ident, at = self.ident(at)
            n, at = self.size(at)
            if n is None:
                stop = end if ident != CLUSTER else self._until_top(at, end)
            else:
                stop = at + n
            if stop > end:
                raise ValueError(f"an element ends beyond its parent at byte {at}")
            yield ident, at, stop
            at = stop

    def _until_top(self, at: int, end: int) -> int:
        """End of a cluster of unknown size: where an element of the upper level begins."""
        while at < end:
            ident, after = self.ident(at)
            if ident in TOP_LEVEL:
                return at
            n, after = self.size(after)
            if n is None:
                raise ValueError("unknown size inside a cluster")
            at = after + n
        return end

    def whole(self, at: int, end: int) -> int:
        return int.from_bytes(self.data[at:end], "big")

    def parse(self) -> Media:
        try:
            for ident, at, end in self.children(0, len(self.data)):
                if ident == EBML:
                    for i, a, e in self.children(at, end):
                        if i == DOCTYPE:
                            self.media.doctype = self.data[a:e].decode("ascii", "replace")
                elif ident == SEGMENT:
                    self.segment = at
                    self._segment(at, end)
        except (ValueError, IndexError, struct.error) as e:
            self.media.error = str(e) or type(e).__name__
        return self.media

    def _segment(self, at: int, end: int) -> None:
        m = self.media
        for ident, a, e in self.children(at, end):
            if ident == INFO:
                m.scale = next((self.whole(x, y) for i, x, y in self.children(a, e) if i == SCALE), m.scale)
            elif ident == TRACKS:
                m.tracks += [self._track(x, y) for i, x, y in self.children(a, e) if i == ENTRY]
            elif ident == CLUSTER:
                self._cluster(a, e)
            elif ident == CUES:
                for i, x, y in self.children(a, e):
                    if i == POINT:
                        point = list(self.children(x, y))
                        time = next((self.whole(p, q) for j, p, q in point if j == CUE_TIME), 0)
                        for j, p, q in point:
                            if j == PLACES:
                                place = {k: self.whole(r, s) for k, r, s in self.children(p, q)}
                                m.cues.append((time, place.get(CUE_TRACK, 0), self.segment + place.get(CUE_CLUSTER, 0)))

    def _track(self, at: int, end: int) -> dict:
        out: dict = {"bits": 0, "rate": 0.0}
        for i, a, e in self.children(at, end):
            if i == NUMBER:
                out["number"] = self.whole(a, e)
            elif i == KIND:
                out["kind"] = self.whole(a, e)
            elif i == CODEC:
                out["codec"] = self.data[a:e].decode("ascii", "replace")
            elif i == FRAME_NS:
                out["frame_ns"] = self.whole(a, e)
            elif i == AUDIO:
                for j, x, y in self.children(a, e):
                    if j == BITS:
                        out["bits"] = self.whole(x, y)
                    elif j == RATE:
                        out["rate"] = struct.unpack(">d" if y - x == 8 else ">f", self.data[x:y])[0]
        return out

    def _cluster(self, at: int, end: int) -> None:
        index, start = len(self.media.clusters), 0
        self.media.clusters.append(at)
        for i, a, e in self.children(at, end):
            if i == TIME:
                start = self.whole(a, e)
            elif i == SIMPLE:
                self._block(a, e, start, index, None)
            elif i == GROUP:
                for j, x, y in self.children(a, e):
                    if j == BLOCK:
                        self._block(x, y, start, index, False)

    def _block(self, at: int, end: int, start: int, cluster: int, key: bool | None) -> None:
        track, at = self.size(at)
        offset, flags = struct.unpack_from(">hB", self.data, at)
        at += 3
        lacing = flags >> 1 & 3
        n = 1
        sizes: list[int] = []
        if lacing:
            n, at = self.data[at] + 1, at + 1
        if lacing == 1:
            for _ in range(n - 1):
                total = 0
                while self.data[at] == 255:
                    total, at = total + 255, at + 1
                sizes.append(total + self.data[at])
                at += 1
        elif lacing == 3 and n > 1:
            size, at = self.size(at)
            sizes.append(size or 0)
            for _ in range(n - 2):
                width = 9 - self.data[at].bit_length()
                step = int.from_bytes(self.data[at : at + width], "big") & ((1 << 7 * width) - 1)
                sizes.append(sizes[-1] + step - ((1 << (7 * width - 1)) - 1))
                at += width
        elif lacing == 2:
            if (end - at) % n:
                raise ValueError("fixed lacing of unequal frames")
            sizes = [(end - at) // n] * (n - 1)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError("laced frames end beyond their block")
        frame_ns = next((t.get("frame_ns", 0) for t in self.media.tracks if t.get("number") == track), 0)
        for k, size in enumerate(sizes):
            ticks = start + offset + k * frame_ns // self.media.scale
            self.media.packets.append((track, ticks, at, size, bool(flags & 0x80) if key is None else key, cluster, lacing))
            at += size


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[o : o + n] for t, _, o, n, *_ in media.packets if t == track])


def padded(raw: bytes) -> bytes:
    """Bytes 255 fill the payload up to a positive multiple of the frame."""
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: str = "ebml") -> DataFrame:
    """id, n_bytes, media: each text stored as a Matroska file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, raw), pa.int64()), pa.array((write(padded(r), lacing) for r in raw), pa.binary())], [id_col, "n_bytes", "media"])

    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"{id_col} {kind}, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: track, timestamp, byte range, key frame, cluster, lacing, and whether a cue names its cluster."""
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, packet long, track int, timestamp_ms double, byte_offset long, n_bytes long, keyframe boolean, cluster int, lacing int, cued boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            rows = []
            for ident, data in zip(batch.column(id_col).to_pylist(), batch.column("media").to_pylist()):
                m = Parser(data or b"").parse()
                cued = {c for _, _, c in m.cues}
                heads = [any(c < at <= c + 12 for c in cued) for at in m.clusters]
                rows += [(ident, k, t, ts * m.scale / 1e6, o, n, key, c, lac, heads[c]) for k, (t, ts, o, n, key, c, lac) in enumerate(m.packets)]
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                types = [batch.schema.field(id_col).type, pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return mapped(media.select(F.col(id_col), F.col(media_col).alias("media")), run, schema)


def feature(payload: bytes, m: Media) -> str:
    """What is computed from the packets read back: their counts and clock, and level statistics of the samples."""
    a = np.frombuffer(payload, np.uint8)
    mean, flips = (float(a.mean()), int(np.count_nonzero((a[1:] >= 128) != (a[:-1] >= 128)))) if len(a) else (0.0, 0)
    end = max((ts * m.scale // 1_000_000 for _, ts, *_ in m.packets), default=0)
    return f"tracks={len(m.tracks)};clusters={len(m.clusters)};cues={len(m.cues)};packets={len(m.packets)};last_ms={end};mean={mean:.6f};flips={flips}"


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of what the stored form gives back; a damaged file raises."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            rows = []
            for n, data in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                m = Parser(data).parse()
                if m.error:
                    raise ValueError(m.error)
                p = payload_of(data, m)
                rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature(p, m)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return mapped(media.select(id_col, "n_bytes", "media"), run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
