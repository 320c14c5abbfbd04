"""Media columns: Ogg streams in binary columns.

Writing: a payload is cut into packets of one frame (192 bytes, 8-bit samples), dealt in
turn to logical streams, and each stream's packets are laced into pages; the granule
position of a page is the number of the stream's samples that end in it. Reading: pages are
found by their capture pattern and accepted by checksum, packets are reassembled from the
lacing values across pages, streams are told apart by serial number, and every packet gets
a time stamp from the granule positions.

Cases: a null payload counts as an empty one, which is padded to one frame; pages whose
checksum is wrong, or that are cut off, are skipped and counted, and a packet that ran
through one is dropped as incomplete; a packet whose length is a multiple of 255 ends with a
lacing value of 0; a granule position of -1 (no packet ends here) gives no time stamp; equal
payloads give equal bytes; only the id and payload columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import whole_texts

FRAME, RATE, SERIALS = 192, 48_000, (1, 2)
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class Page(NamedTuple):
    serial: int
    sequence: int
    flags: int
    granule: int
    lacing: bytes
    body: bytes


class Packet(NamedTuple):
    serial: int
    number: int
    data: bytes
    end_sample: int | None  # granule position at its end, where it is known


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, first bit first, start 0: the common reflected CRC of
    bit-reversed bytes, itself bit-reversed, without its complements."""
    return int(f"{zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def page_bytes(page: Page) -> bytes:
    head = HEADER.pack(b"OggS", 0, page.flags, page.granule, page.serial, page.sequence, 0, len(page.lacing)) + page.lacing
    data = head + page.body
    return data[:22] + struct.pack("<I", checksum(data)) + data[26:]


def stream_pages(serial: int, packets: list[bytes], samples: list[int]) -> list[bytes]:
    """Pages of one logical stream of at most 255 lacing values each; ``samples``: granule
    position at the end of each packet."""
    segments: list[tuple[int, bytes, int | None]] = []  # lacing value, bytes, granule if it ends a packet
    for data, end in zip(packets, samples, strict=True):
        whole = len(data) // 255
        segments += [(255, data[255 * i : 255 * i + 255], None) for i in range(whole)]
        segments.append((len(data) - 255 * whole, data[255 * whole :], end))
    out, continued = [], False
    cuts = range(0, len(segments), 255)
    for k, at in enumerate(cuts):
        part = segments[at : at + 255]
        granule = next((g for _, _, g in reversed(part) if g is not None), -1)
        flags = CONTINUED * continued | FIRST * (k == 0) | LAST * (at + 255 >= len(segments))
        out.append(page_bytes(Page(serial, k, flags, granule, bytes(v for v, _, _ in part), b"".join(x for _, x, _ in part))))
        continued = part[-1][2] is None
    return out


def write(payload: bytes, frame: int = FRAME, serials: tuple[int, ...] = SERIALS) -> bytes:
    """The payload's frames dealt in turn to the streams; pages of the streams alternate."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    pages = []
    for k, serial in enumerate(serials):
        own = frames[k :: len(serials)]
        if own:
            pages.append(stream_pages(serial, own, np.cumsum([len(x) for x in own]).tolist()))
    first = [p.pop(0) for p in pages]  # the first pages of all streams come first
    rest = [p[i] for i in range(max(map(len, pages), default=0)) for p in pages if i < len(p)]
    return b"".join(first + rest)


def pages(data: bytes) -> tuple[list[Page], int]:
    """Valid pages in order, and the number of capture patterns without a valid page."""
    found, bad, at = [], 0, data.find(b"OggS")
    while at >= 0:
        page, end = None, at + 27
        if end <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
            lacing = data[end : end + n]
            end += n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data) and checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc:
                page = Page(serial, sequence, flags, granule, lacing, data[at + 27 + n : end])
        if page:
            found.append(page)
        else:
            bad, end = bad + 1, at + 4
        at = data.find(b"OggS", end)
    return found, bad


def packets(found: list[Page]) -> list[Packet]:
    """Complete packets of all logical streams, in the order in which they end."""
    held: dict[int, bytearray | None] = {}  # None: the start of the running packet was lost
    expected: dict[int, int] = {}
    numbers: dict[int, int] = {}
    out: list[Packet] = []
    for page in found:
        s = page.serial
        if page.sequence != expected.get(s, page.sequence) or not page.flags & CONTINUED:
            held.pop(s, None)  # pages were lost, or the running packet was given up
        if page.flags & CONTINUED and s not in held:
            held[s] = None
        expected[s] = page.sequence + 1
        at, ends = 0, [i for i, v in enumerate(page.lacing) if v < 255]
        run = held.pop(s, bytearray()) if page.flags & CONTINUED else bytearray()
        for i, v in enumerate(page.lacing):
            if run is not None:
                run += page.body[at : at + v]
            at += v
            if v < 255:
                if run is not None:
                    last = i == ends[-1]
                    out.append(Packet(s, numbers.get(s, 0), bytes(run), page.granule if last and page.granule >= 0 else None))
                    numbers[s] = numbers.get(s, 0) + 1
                run = bytearray()
        if page.lacing and page.lacing[-1] == 255:
            held[s] = run
    return out


def timed(found: list[Packet], bytes_per_sample: int = 1) -> list[Packet]:
    """Packets between known granule positions get theirs from the packet lengths."""
    out = list(found)
    later: dict[int, int] = {}
    for i in range(len(out) - 1, -1, -1):
        p = out[i]
        if p.end_sample is None and p.serial in later:
            p = out[i] = p._replace(end_sample=later[p.serial])
        if p.end_sample is not None:
            later[p.serial] = p.end_sample - len(p.data) // bytes_per_sample
    return out


def payload_of(found: list[Packet]) -> bytes:
    """Frames of all streams, by time stamp, then by stream."""
    frames = sorted((p for p in timed(found) if p.end_sample is not None), key=lambda p: (p.end_sample - len(p.data), p.serial))
    return b"".join(p.data for p in frames)


def features(samples: bytes, n_streams: int, n_packets: int, n_pages: int) -> str:
    """Integer features of unsigned 8-bit samples, so that all machines give the same."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = max(len(x), 1)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"streams={n_streams};packets={n_packets};pages={n_pages};ms={len(x) * 1000 // (RATE * max(n_streams, 1))};mean_milli={int(x.sum()) * 1000 // n};energy={int((x * x).sum()) // n};crossings={crossings};min={int(x.min(initial=127))};max={int(x.max(initial=-128))}"


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of a frame; the number of bytes before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME), len(raw)


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Every text as an Ogg stream, read back from its bytes; ``keep_media`` adds the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, media_column = [], []
            for x in batch.column(1):
                payload, n = padded(x.as_py())
                media = write(payload)
                found, _ = pages(media)
                back = packets(found)
                samples = payload_of(back)
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, len({p.serial for p in back}), len(back), len(found))))
                if keep_media:
                    media_column.append(media)
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(media_column, pa.binary())] if keep_media else [])], names=["doc_id", *(f for f, _ in _FIELDS), *(["media"] if keep_media else [])])

    texts = whole_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, {SCHEMA}" + ", media binary" * keep_media)


def demultiplex(table: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """One row for each packet of each media value: serial, number, data, time stamps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column(0), batch.column(1), strict=True):
                got, bad = pages(x.as_py() or b"")
                rows = [(key.as_py(), p.serial, p.number, p.data, p.end_sample, None if p.end_sample is None else p.end_sample / RATE, bad) for p in timed(packets(got))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type

    source = table.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    types = [to_arrow_type(source.schema["id"].dataType), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int64()]
    names = ["id", "serial", "packet", "data", "end_sample", "end_s", "bad_pages"]
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, serial long, packet long, data binary, end_sample long, end_s double, bad_pages long")
