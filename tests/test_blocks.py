"""Blocks of files, made here byte by byte."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from photonframe.sources import blocks, formats


def box(kind: bytes, inside: bytes) -> bytes:
    return struct.pack(">I", 8 + len(inside)) + kind + inside


def segment(marker: int, inside: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", 2 + len(inside)) + inside


def attribute(name: bytes, kind: bytes, value: bytes) -> bytes:
    return name + b"\0" + kind + b"\0" + struct.pack("<i", len(value)) + value


P3 = (0.68, 0.32, 0.265, 0.69, 0.15, 0.06, 0.3127, 0.329)
COLR = box(b"colr", b"nclx" + struct.pack(">HHHB", 9, 16, 9, 0x80))
AVIF = box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", box(b"ispe", b"x" * 12) + COLR))) + box(b"mdat", b"colrnclx")
EXR = b"\x76\x2f\x31\x01\x02\0\0\0" + attribute(b"channels", b"chlist", b"abc\0") + attribute(b"chromaticities", b"chromaticities", struct.pack("<8f", *P3)) + b"\0rest"
PLAIN = b"\x76\x2f\x31\x01\x02\0\0\0" + attribute(b"chromaticities", b"chromaticities", struct.pack("<8f", *blocks.REC709)) + b"\0"


def multi_picture() -> bytes:
    def build(sizes: tuple[int, int, int]) -> bytes:
        entries = struct.pack("<IIIHH", 0, sizes[0], 0, 0, 0) + struct.pack("<IIIHH", 0, sizes[1], sizes[2], 0, 0)
        ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0xB000, 7, 4, 0) + struct.pack("<HHII", 0xB002, 7, 32, 8 + 2 + 24 + 4) + b"\0\0\0\0"
        return b"\xff\xd8" + segment(0xE1, b"xmp") + segment(0xE2, b"MPF\0" + b"II*\0" + struct.pack("<I", 8) + ifd + entries) + segment(0xDA, b"") + b"scan\xff\xd9"

    first = len(build((0, 0, 0)))
    base = 2 + 7 + 4 + 4  # start, the other segment, this one's head, its name
    return build((first, 6, first - base)) + b"\xff\xd8gm\xff\xd9"


def files(spark):
    rows = [("a", AVIF), ("e", EXR), ("p", PLAIN), ("j", multi_picture()), ("n", formats.write_png(np.zeros((1, 1, 1), np.uint8))), ("cut", AVIF[:40]), ("none", b""), ("null", None)]
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "path string, content binary")


def test_blocks_of_files(spark):
    got = {}
    for r in blocks.file_blocks(files(spark)).orderBy("path", "n").collect():
        got.setdefault(r.path, []).append((r.block, r.length))
    assert got["a"] == [("ftyp", 8), ("meta", len(COLR) + 20 + 4 + 16), ("meta/iprp", len(COLR) + 28), ("meta/iprp/ipco", len(COLR) + 20), ("meta/iprp/ipco/ispe", 12), ("meta/iprp/ipco/colr", 11), ("mdat", 8)]
    assert got["e"] == [("channels", 4), ("chromaticities", 32)] and [b for b, _ in got["n"]] == ["IHDR", "IDAT", "IEND"]
    assert [b for b, _ in got["j"]] == ["E1", "E2"] and got["cut"] == [("ftyp", 8)] and "none" not in got and "null" not in got
    joined = blocks.file_blocks(files(spark)).join(files(spark), "path").where("block = 'E1'").select(blocks.body(F.col("content"), F.col("offset"), F.col("length")).alias("b")).first()
    assert bytes(joined.b) == b"xmp"


def test_what_blocks_say(spark):
    xy = blocks.exr_chromaticities(files(spark)).collect()
    assert [r.path for r in xy] == ["e"] and np.allclose(list(xy[0])[1:], P3, atol=1e-6)
    assert [tuple(r) for r in blocks.colour_codes(files(spark)).collect()] == [("a", 9, 16, 9, True)]
    data = multi_picture()
    pictures = blocks.embedded_pictures(files(spark)).orderBy("n").collect()
    assert [data[r.offset : r.offset + r.length] for r in pictures] == [data[:-6], b"\xff\xd8gm\xff\xd9"]
