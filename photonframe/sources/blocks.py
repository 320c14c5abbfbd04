"""Blocks of image files as rows: PNG chunks, JPEG segments, boxes of ISO media files and
attributes of OpenEXR headers, and what is read from them.

A file's blocks are found in Arrow batches, a file at a time, by their own lengths; a file
that is cut off or damaged gives the blocks before the damage. Bodies stay in the file: a
block is a place and a length, and a body is taken from the content where it is wanted."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Block = tuple[str, int, int]  # path, place of the body, its length
HEADER = 1 << 20  # bytes of an OpenEXR header that are read at most
# Boxes that hold boxes, with the bytes before the first.
CONTAINERS = {"meta": 4, "iprp": 0, "ipco": 0, "moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "dinf": 0}
REC709 = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290)


def png_blocks(data: bytes) -> Iterator[Block]:
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        yield data[at + 4 : at + 8].decode("latin-1"), at + 8, size
        at += 12 + size


def jpeg_blocks(data: bytes) -> Iterator[Block]:
    """Segments up to the scan, named by their marker in hex."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA) or size < 2 or at + 2 + size > len(data):
            return
        yield f"{marker:02X}", at + 4, size - 2
        at += 2 + size


def iso_blocks(data: bytes, start: int = 0, end: int | None = None, path: str = "", depth: int = 0) -> Iterator[Block]:
    """Boxes, those inside others after them: path "meta/iprp/ipco/colr"."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        kind = data[at + 4 : at + 8].decode("latin-1")
        yield path + kind, at + head, size - head
        if kind in CONTAINERS and depth < 16:
            yield from iso_blocks(data, at + head + CONTAINERS[kind], at + size, f"{path}{kind}/", depth + 1)
        at += size


def exr_blocks(data: bytes) -> Iterator[Block]:
    """Header attributes by name."""
    at, data = 8, data[:HEADER]
    while (name := data.find(b"\0", at)) > at:
        kind = data.find(b"\0", name + 1)
        if kind < 0 or kind + 5 > len(data):
            return
        size = int.from_bytes(data[kind + 1 : kind + 5], "little", signed=True)
        if size < 0 or kind + 5 + size > len(data):
            return
        yield data[at:name].decode("latin-1"), kind + 5, size
        at = kind + 5 + size


def blocks_of(data: bytes) -> Iterator[Block]:
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return png_blocks(data)
    if data.startswith(b"\xff\xd8\xff"):
        return jpeg_blocks(data)
    if data[4:8] == b"ftyp":
        return iso_blocks(data)
    if data.startswith(b"\x76\x2f\x31\x01"):
        return exr_blocks(data)
    return iter(())


def file_blocks(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id_col, n, block, offset, length): the blocks of each file in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = list(blocks_of(data or b""))
                names, places, sizes = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int32()), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=[id_col, "n", "block", "offset", "length"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, content).mapInArrow(run, f"`{id_col}` {kind}, n int, block string, offset long, length long")


def body(content: Column, offset: Column, length: Column) -> Column:
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


def _unpacked(files: DataFrame, id_col: str, content: str, read, fields: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """Rows of what ``read`` makes of each file's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = list(read(data or b""))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), batch.schema.field(0).type), *(pa.array(c, kinds[n]) for n, c in zip(names, columns, strict=True))], names=[id_col, *names])

    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = {f.split()[0]: types[f.split()[1]] for f in fields.split(", ")}
    names = list(kinds)
    return files.select(id_col, content).mapInArrow(run, f"`{id_col}` {files.schema[id_col].dataType.simpleString()}, {fields}")


def exr_chromaticities(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id_col, rx, ry, gx, gy, bx, by, wx, wy) of OpenEXR files whose primaries are stated,
    plausible and not those that are meant without a statement anyway."""

    def read(data: bytes) -> Iterator[tuple[float, ...]]:
        if data.startswith(b"\x76\x2f\x31\x01"):
            for name, at, size in exr_blocks(data):
                if name == "chromaticities" and size == 32:
                    xy = struct.unpack_from("<8f", data, at)
                    if all(0 < v < 1 for v in xy) and any(abs(a - b) >= 1e-4 for a, b in zip(xy, REC709, strict=True)):
                        yield xy
                    return

    return _unpacked(files, id_col, content, read, ", ".join(f"{c}{a} double" for c in "rgbw" for a in "xy"))


def colour_codes(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id_col, primaries, transfer, matrix, full_range) of the first nclx colour box."""

    def read(data: bytes) -> Iterator[tuple]:
        if data[4:8] == b"ftyp":
            for path, at, size in iso_blocks(data):
                if path.endswith("/colr") and data[at : at + 4] == b"nclx" and size >= 11:
                    yield (*struct.unpack_from(">HHH", data, at + 4), bool(data[at + 10] & 0x80))
                    return

    return _unpacked(files, id_col, content, read, "primaries int, transfer int, matrix int, full_range boolean")


def embedded_pictures(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id_col, n, offset, length) of the pictures that a JPEG's multi-picture index lists, the
    first being the file's own; only those that lie in the file."""

    def read(data: bytes) -> Iterator[tuple[int, int, int]]:
        index = next(((at, size) for name, at, size in jpeg_blocks(data) if name == "E2" and data[at : at + 4] == b"MPF\0"), None) if data.startswith(b"\xff\xd8\xff") else None
        if index is None:
            return
        base, end = index[0] + 4, sum(index)
        order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[base : base + 4])
        if order is None or base + 8 > end:
            return
        at = base + struct.unpack_from(f"{order}I", data, base + 4)[0]
        if at + 2 > end:
            return
        for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > end:
                return
            tag, _, size, place = struct.unpack_from(f"{order}HHII", data, entry)
            if tag == 0xB002:
                for n in range(size // 16):
                    if base + place + 16 * (n + 1) > end:
                        return
                    _, length, offset = struct.unpack_from(f"{order}III", data, base + place + 16 * n)
                    offset = 0 if n == 0 else base + offset
                    if offset + length <= len(data):
                        yield n, offset, length

    return _unpacked(files, id_col, content, read, "n int, offset long, length long")
