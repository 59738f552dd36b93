"""Media column: MPEG-1 Layer III audio that carries a payload, and a parser of such streams.

`store` puts a payload losslessly into valid mono frames: each has a header, a CRC-16, side
information of silence, and payload bytes in the part of the frame that decoders skip as
ancillary data. The stream starts with an ID3v2 tag that gives the payload's length and a
frame with a variable-bitrate table (frames, bytes, seek points); body frames have the
largest bitrate and the last one the smallest that fits. An empty ID3v1 tag ends the stream, so
that no payload can be taken for one.

`parse` reads any such stream: it skips tags at either end, finds frame headers by two in
sequence, resynchronises after junk, reads the table, verifies checksums and returns exact
durations and frame offsets. `payload_of` joins the carried bytes.

Defined results: null counts as empty. The payload is padded with zero bytes to a positive
multiple of 64, so that an empty text is stored too. Equal texts give equal bytes and
features. Repeated rows are returned each. An empty table gives an empty result. Only id and
text are used, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.text import text_slices, whole_text

# Fixed values of the format: MPEG-1 Layer III bitrates in kbit/s by index, sample rates by index, samples in a frame.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
UNIT = 64

#: Ours: 48 kHz, so that frame lengths are whole without padding, and mono, so that side information is 17 bytes.
RATE_INDEX, SIDE = 1, 17
SEEK_POINTS = 100


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        table.append(x)
    return table


_CRC = _crc_table()


def crc16(data: bytes, x: int = 0xFFFF) -> int:
    for b in data:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ b]
    return x


@dataclass(frozen=True)
class Header:
    bitrate: int
    rate: int
    size: int
    protected: bool
    side: int

    @property
    def start(self) -> int:
        """Of the bytes after header, checksum and side information."""
        return 4 + 2 * self.protected + self.side


def read_header(four: bytes) -> Header | None:
    """MPEG-1 Layer III only; None for anything else, free bitrate and reserved values."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xFE != 0xFA:
        return None
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if bitrate in (0, 15) or rate == 3:
        return None
    size = 144 * BITRATES[bitrate] * 1000 // RATES[rate] + (four[2] >> 1 & 1)
    return Header(BITRATES[bitrate], RATES[rate], size, not four[1] & 1, 17 if four[3] >> 6 == 3 else 32)


def _frame_start(index: int) -> bytes:
    """Header, checksum and silent side information of a mono frame of bitrate BITRATES[index]."""
    header = bytes([0xFF, 0xFA, index << 4 | RATE_INDEX << 2, 0xC0])
    side = bytes(SIDE)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


_STARTS = {i: _frame_start(i) for i in range(1, 15)}
_SIZES = {i: 144 * BITRATES[i] * 1000 // RATES[RATE_INDEX] for i in range(1, 15)}
_ROOM = {i: _SIZES[i] - len(_STARTS[i]) for i in range(1, 15)}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pad(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def store(payload: bytes) -> bytes:
    """The stream that carries a payload of any length."""
    full = _ROOM[14]
    whole, rest = divmod(len(payload), full)
    frames = [_STARTS[14] + payload[i * full : (i + 1) * full] for i in range(whole)]
    if rest:
        last = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        frames.append((_STARTS[last] + payload[whole * full :]).ljust(_SIZES[last], b"\0"))
    # The table lies in a frame of its own, after the side information; its own bytes count.
    total = _SIZES[9] + sum(map(len, frames))
    at, offsets = _SIZES[9], []
    for f in frames:
        offsets.append(at)
        at += len(f)
    seek = bytes(min(255, offsets[i * len(offsets) // SEEK_POINTS] * 256 // total) if offsets else 0 for i in range(SEEK_POINTS))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + (_STARTS[9] + table).ljust(_SIZES[9], b"\0") + b"".join(frames) + b"TAG" + bytes(125)


@dataclass
class Stream:
    """What parse found. offsets: of the audio frames, in bytes from the start of the stream."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] | None = None
    bad_checksums: int = 0
    junk_bytes: int = 0

    @property
    def samples(self) -> int:
        return SAMPLES * len(self.offsets)

    @property
    def seconds(self) -> float:
        return sum(SAMPLES / h.rate for h in self.headers)


def _read_tags(data: bytes, out: Stream) -> int:
    """Reads an ID3v2 tag's text frames; returns where the audio starts."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end = 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    at = 10
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        n = int.from_bytes(data[at + 4 : at + 8]) if data[3] < 4 else sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        body = data[at + 10 : at + 10 + n]
        if name == "TXXX":
            key, _, value = body[1:].lstrip(b"\0").partition(b"\0")
            out.tags[key.decode("latin-1")] = value.decode("latin-1")
        elif name[0] == "T":
            out.tags[name] = body[1:].decode("latin-1")
        at += 10 + n
    return end


def _read_table(frame: bytes, header: Header) -> dict[str, object] | None:
    at = 4 + 2 * header.protected + header.side
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        return None
    flags = int.from_bytes(frame[at + 4 : at + 8])
    at += 8
    out: dict[str, object] = {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(frame[at : at + 4])
            at += 4
    if flags & 4:
        out["seek"] = frame[at : at + SEEK_POINTS]
    return out


def parse(data: bytes) -> Stream:
    """Walks a stream. A header counts if another header or the end of the audio follows where it says, or if its checksum is right."""
    out = Stream()
    at = _read_tags(data, out)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    while at + 4 <= end:
        header = read_header(data[at : at + 4])
        after = at + header.size if header else 0
        sound = header and header.protected and after <= end and crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + header.side]) == int.from_bytes(data[at + 4 : at + 6])
        if header and after <= end and (sound or after + 4 > end or read_header(data[after : after + 4])):
            table = _read_table(data[at:after], header) if not out.offsets and out.table is None else None
            out.bad_checksums += header.protected and not sound
            if table is not None:
                out.table = table
            else:
                out.offsets.append(at)
                out.headers.append(header)
            at = after
            continue
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out.junk_bytes += nxt - at
        at = nxt
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The carried bytes, as long as the tag says, or all of them."""
    carried = b"".join(data[o + h.start : o + h.size] for o, h in zip(stream.offsets, stream.headers, strict=True))
    n = stream.tags.get("payload_bytes", "")
    return carried[: int(n)] if n.isdigit() else carried


def feature(data: bytes, stream: Stream) -> str:
    """Frames, samples, mean bitrate, checksum failures, whether the table agrees, and a digest of the seek offsets."""
    agrees = stream.table is not None and stream.table.get("frames") == len(stream.offsets)
    mean = sum(h.bitrate for h in stream.headers) / max(1, len(stream.headers))
    seek = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    return f"frames={len(stream.offsets)};samples={stream.samples};seconds={stream.seconds:.6f};kbps={mean:.3f};bad_crc={stream.bad_checksums};junk={stream.junk_bytes};table={'ok' if agrees else 'off'};seek_crc32={seek:08x}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media (binary), seconds, offsets (array) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 20):
            media = [store(pad(t.encode())) for t in batch.column("text").to_pylist()]
            found = [parse(m) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(media, pa.binary()), pa.array([s.seconds for s in found], pa.float64()), pa.array([s.offsets for s in found], pa.list_(pa.int64()))], ["id", "media", "seconds", "offsets"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, media binary, seconds double, offsets array<bigint>").withColumnRenamed("id", id_col)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests and features of what media_column stores, as read back from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in text_slices(batches, "text", 2 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                media = store(pad(raw))
                stream = parse(media)
                payload = payload_of(media, stream)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(media, stream)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("id", id_col)
