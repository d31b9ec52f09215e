"""MPEG audio columns: payloads stored in MPEG-1 layer III frames, and a parser for such streams.

write_stream() stores bytes as the ancillary data of silent frames: an ID3v2 tag, a frame with the variable-bitrate
table, then frames of the largest size and a last one of the smallest size that holds the rest. read_stream() accepts
any stream of MPEG 1, 2 or 2.5, layers I to III: it skips tags, resynchronises on headers that a second header of the
same kind or the end confirms, reads either variable-bitrate table, verifies the checksum of each protected layer III frame
(those of the other layers are counted as unchecked, as what they cover depends on the frame's bit allocation), and
gives the exact duration and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: kbit/s by index for (MPEG 1 or not, layer).
_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
BITRATES = {
    (True, 1): tuple(range(0, 449, 32)), (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): _LOW, (False, 3): _LOW,
}
#: Fixed values of the format: samples a second of MPEG 1, and what the versions divide them by.
RATES, DIVIDE = (44_100, 48_000, 32_000), {3: 1, 2: 2, 0: 4}
#: Fixed values of the format: bytes of layer III side information for (MPEG 1 or not, one channel or two).
SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}
BLOCK = 64
#: Bits of a header that all frames of a stream share: sync, version, layer and sample rate.
KIND = 0xFFFE0C00


def _shifted(byte: int) -> int:
    crc = byte << 8
    for _ in range(8):
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


_CRC = [_shifted(b) for b in range(256)]


def checksum(protected: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and start 0xFFFF, over the header's last two bytes and the side information."""
    crc = 0xFFFF
    for byte in protected:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    size: int  # bytes of the frame
    rate: int  # samples a second
    samples: int  # of the frame
    side: int  # bytes of side information; 0 where it is not layer III
    protected: bool
    kind: int


@lru_cache(4096)
def header(word: int) -> Header | None:
    """What a valid header says, else None. A frame of free bitrate has no size and is not valid here."""
    version, layer, index = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or word >> 10 & 3 == 3 or word & 3 == 2:
        return None
    one = version == 3
    rate = RATES[word >> 10 & 3] // DIVIDE[version]
    bits, pad = BITRATES[one, layer][index] * 1000, word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12 * bits // rate + pad) * 4 if layer == 1 else samples // 8 * bits // rate + pad
    return Header(size, rate, samples, SIDE[one, word >> 6 & 3 == 3] if layer == 3 else 0, not word >> 16 & 1, word & KIND)


def _frame(index: int, data: bytes) -> bytes:
    """One protected frame with one channel at 32 kHz."""
    head = struct.pack(">I", 0xFFFA0000 | index << 12 | 2 << 10 | 3 << 6)
    h = header(int.from_bytes(head))
    start = head + struct.pack(">H", checksum(head[2:] + bytes(h.side))) + bytes(h.side)
    return start + data + bytes(h.size - len(start) - len(data))


_HEADS = {i: _frame(i, b"")[:23] for i in range(1, 15)}  # header, checksum and side information
_ROOM = {i: len(_frame(i, b"")) - 23 for i in _HEADS}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    most = _ROOM[14]
    last = len(payload) % most or most if payload else 0
    full = (len(payload) - last) // most
    frames = [_HEADS[14] + payload[k * most : (k + 1) * most] for k in range(full)]
    if payload:
        frames.append(_frame(next(i for i in _ROOM if _ROOM[i] >= last), payload[full * most :]))
    body = b"".join(frames)
    first = _frame(5, b"")
    ends = np.cumsum([len(first), *map(len, frames)])
    total = len(first) + len(body)
    at = np.arange(100) * len(ends) // 100
    toc = bytes((256 * np.concatenate([[0], ends[:-1]])[at] // total).astype(np.uint8))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\0payload\0%d" % len(payload)
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + _frame(5, table) + body


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    rate: int = 0
    frame_samples: int = 0
    table: tuple[int | None, int | None, bytes] | None = None
    bad: int = 0
    unchecked: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def samples(self) -> int:
        return self.frame_samples * len(self.offsets)

    def seek(self, sample: int) -> int:
        """The byte at which the frame of a sample starts."""
        return self.offsets[sample // self.frame_samples]


def _safe(data: bytes) -> int:
    """A number of seven bits a byte."""
    n = 0
    for b in data:
        n = n << 7 | b & 127
    return n


#: Fixed values of the format: encodings of text by number.
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _texts(content: bytes) -> list[str]:
    """The strings of a text frame, which a zero character parts."""
    if not content or content[0] > 3:
        return []
    text = content[1:].decode(_ENCODINGS[content[0]], "replace")
    return [x.lstrip("\ufeff") for x in text.split("\0")]


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of the tag in front, and where it ends. A tag whose frames make no sense is skipped whole."""
    tags, start, stop = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and data[3] in (2, 3, 4):
        version, flags = data[3], data[5]
        size = _safe(data[6:10])
        start = min(stop, 10 + size + 10 * (version == 4 and flags >> 4 & 1))
        body = data[10 : min(stop, 10 + size)]
        if flags >> 7 and version < 4:  # unsynchronisation: a zero byte was put in behind each 255
            body = body.replace(b"\xff\0", b"\xff")
        at = 0
        if flags >> 6 & 1 and version > 2:  # an extended header; its size includes itself in version 4 only
            at = _safe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4])
        name_bytes, head = (3, 6) if version == 2 else (4, 10)
        while at + head <= len(body) and body[at]:
            name, length = body[at : at + name_bytes].decode("latin-1"), body[at + name_bytes : at + 2 * name_bytes]
            length = _safe(length) if version == 4 else int.from_bytes(length)
            content, found = body[at + head : at + head + length], []
            if version == 4 and body[at + 9] & 1 and len(content) >= 4:  # the frame's size without additions stands in front
                content = content[4:]
            if version == 4 and body[at + 9] & 2:
                content = content.replace(b"\xff\0", b"\xff")
            if name.startswith("T"):
                found = _texts(content)
            if name in ("TXXX", "TXX") and len(found) > 1:
                tags[found[0]] = found[1]
            elif found:
                tags[name] = found[0]
            at += head + length
    return tags, start


def _table(data: bytes, at: int, body: int, stop: int) -> tuple[int | None, int | None, bytes] | None:
    """(frames, bytes, seek table) of a frame that holds a variable-bitrate table; a count that it leaves out is None."""
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= stop:
        flags, place, counts = int.from_bytes(data[body + 4 : body + 8]), body + 8, []
        for bit in (1, 2):
            counts.append(int.from_bytes(data[place : place + 4]) if flags & bit else None)
            place += 4 if flags & bit else 0
        return counts[0], counts[1], data[place : min(stop, place + 100)] if flags & 4 else b""
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= stop:
        total, frames, entries, _, width = struct.unpack_from(">IIHHH", data, at + 46)
        return frames, total, data[at + 62 : min(stop, at + 62 + entries * width)]
    return None


def read_stream(data: bytes) -> Stream:
    """Parses a whole stream; damaged stretches are skipped and counted, bad checksums counted.

    The last 128 bytes are a tag only if they begin with its sign and no frame reaches into them.
    """
    out, stop = Stream(), len(data)
    out.tags, at = _tags(data)
    tail = stop - 128 if data[-128:-125] == b"TAG" else None
    held, first, kind = [], True, None
    in_step = False
    while at + 4 <= stop:
        h = header(int.from_bytes(data[at : at + 4]))
        ends = h and at + h.size
        sure = h and ends <= stop and (kind is None or h.kind == kind)
        if sure and not in_step and ends not in (stop, tail):
            behind = header(int.from_bytes(data[ends : ends + 4]))
            sure = behind and behind.kind == h.kind
        if at == tail:
            out.tags["title"] = data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            break
        if not sure:
            at, in_step = at + 1, False
            out.skipped += 1
            continue
        body = at + 4 + 2 * h.protected
        if h.protected and not h.side:
            out.unchecked += 1
        elif h.protected and int.from_bytes(data[at + 4 : at + 6]) != checksum(data[at + 2 : at + 4] + data[body : body + h.side]):
            out.bad += 1
            if not in_step:  # a header that nothing vouches for
                at += 1
                out.skipped += 1
                continue
        body += h.side
        table = _table(data, at, body, ends) if first else None
        if table:
            out.table = table
        else:
            out.offsets.append(at)
            out.sizes.append(h.size)
            held.append(data[body:ends])
        out.rate, out.frame_samples, kind, first, in_step = h.rate, h.samples, h.kind, False, True
        at = ends
    known = out.tags.get("payload", "")
    out.payload = b"".join(held)[: int(known) if known.isdigit() else None]
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, null as empty, and the text with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def stored(text: Column) -> Column:
    """struct(n_bytes, media): each text's payload as a stream."""

    @F.pandas_udf("n_bytes long, media binary")
    def write(texts: pd.Series) -> pd.DataFrame:
        rows = [padded(x) for x in texts]
        return pd.DataFrame({"n_bytes": [n for n, _ in rows], "media": [write_stream(p) for _, p in rows]})

    return write(text.cast("string"))


def parsed(media: Column, keep_payload: bool = True) -> Column:
    """What a stream holds: exact duration as samples over rate, seek offsets, table, checksum and skip counts, payload digests[, payload]."""
    schema = (
        "samples long, rate int, offsets array<long>, table_frames long, table_bytes long, toc binary, bad_frames int, skipped_bytes long, "
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string" + ", payload binary" * keep_payload
    )

    @F.pandas_udf(schema)
    def read(media: pd.Series) -> pd.DataFrame:
        rows = []
        for data in media:
            data = data or b""
            s = read_stream(data)
            frames, total, toc = s.table or (None, None, None)
            rows.append((s.samples, s.rate, s.offsets, frames, total, toc, s.bad, s.skipped, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), *([s.payload] if keep_payload else [])))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return read(media)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row; repeated rows stay apart, null ids are kept, other columns are left out.

    A null text is stored as an empty one. Texts are stored whole, one at a time; an empty table gives an empty table.
    """
    return docs.select(F.col(id_col), stored(F.col(text_col)).alias("s")).select(id_col, "s.n_bytes", "s.media")


def read_media(media: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The rows of store_texts() with what parsed() finds in place of the stream."""
    out = media.withColumn("p", parsed(F.col("media"), keep_payload))
    return out.select(*[c for c in media.columns if c != "media"], "p.*")
