"""OpenEXR made here block by block, and the rarer kinds of PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from photonframe.sources import formats, openexr, pictures
from tests.test_blocks import attribute


def exr(planes: dict[str, np.ndarray], method: int) -> bytes:
    """Channels by name, in alphabetical order, as half or single floats."""
    names = sorted(planes)
    h, w = planes[names[0]].shape
    kinds = {np.dtype("<f2"): 1, np.dtype("<f4"): 2, np.dtype("<u4"): 0}
    listed = b"".join(n.encode() + b"\0" + struct.pack("<iiii", kinds[planes[n].dtype], 0, 1, 1) for n in names) + b"\0"
    head = b"\x76\x2f\x31\x01\x02\0\0\0" + attribute(b"channels", b"chlist", listed) + attribute(b"compression", b"compression", bytes([method])) + attribute(b"dataWindow", b"box2i", struct.pack("<4i", -3, 5, w - 4, h + 4)) + b"\0"
    lines = 16 if method == 3 else 1
    blocks = []
    for y in range(0, h, lines):
        raw = b"".join(planes[n][i].tobytes() for i in range(y, min(h, y + lines)) for n in names)
        halves = np.concatenate([np.frombuffer(raw, np.uint8)[0::2], np.frombuffer(raw, np.uint8)[1::2]]).astype(int)
        packed = np.concatenate([halves[:1], (np.diff(halves) + 128) & 255]).astype(np.uint8).tobytes()
        if method == 1:
            out, at = b"", 0
            while at < len(packed):
                n = 1
                while at + n < len(packed) and n < 128 and packed[at + n] == packed[at]:
                    n += 1
                out, at = (out + bytes([n - 1, packed[at]]), at + n) if n > 2 else (out + b"\xff" + packed[at : at + 1], at + 1)
            packed = out
        elif method in (2, 3):
            packed = zlib.compress(packed)
        blocks.append(struct.pack("<ii", y + 5, 0)[:4] + struct.pack("<i", min(len(packed), len(raw)) if method else len(raw)) + (packed if method and len(packed) < len(raw) else raw))
    at, table = len(head) + 8 * len(blocks), b""
    for b in blocks:
        table += struct.pack("<Q", at)
        at += len(b)
    return head + table + b"".join(blocks)


@pytest.mark.parametrize("method", [0, 1, 2, 3])
@pytest.mark.parametrize("kind", ["<f2", "<f4"])
def test_openexr(method, kind):
    r = np.random.default_rng(method)
    planes = {c: np.round(r.normal(0, 5, (37, 23)) ** 2, 1).astype(kind) for c in "RGBA"}
    planes["R"][5:20] = 3.5  # runs
    data = exr(planes, method)
    got = openexr.decode(data)
    assert got.dtype == np.float32 and (got == np.stack([planes[c].astype(np.float32) for c in "RGB"], axis=2)).all()
    with pytest.raises((ValueError, zlib.error)):
        openexr.decode(data[:-9])
    grey = openexr.decode(exr({"Y": planes["G"]}, method))
    assert (grey == planes["G"].astype(np.float32)[:, :, None]).all()


def test_openexr_refusals(spark, tmp_path):
    data = exr({c: np.ones((4, 4), "<f2") for c in "RGB"}, 0)
    for bad in (data[:5] + b"\x02" + data[6:], data.replace(b"compression\0compression\0\1\0\0\0\0", b"compression\0compression\0\1\0\0\0\4"), exr({"Z": np.ones((2, 2), "<f4")}, 0)):
        with pytest.raises(ValueError):
            openexr.decode(bad)
    (tmp_path / "a.exr").write_bytes(data)
    (tmp_path / "b.exr").write_bytes(data[:60])
    good, cut = sorted(pictures.read(spark, str(tmp_path), "samples").collect(), key=lambda x: x.path)
    assert (np.frombuffer(good.data, "<f4") == 1).all() and (good.rows, good.columns, good.hdr) == (4, 4, True) and cut.error


def png(width: int, height: int, depth: int, kind: int, rows: list[bytes], **chunks: bytes) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return formats.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)) + b"".join(chunk(k.encode(), b) for k, b in chunks.items()) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_palettes_and_few_bits():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255])
    s, _ = formats.read_png(png(5, 2, 2, 3, [bytes([0b00011000, 0b01000000]), bytes([0b10100100, 0])], PLTE=palette))
    assert s.tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 0, 0], [0, 255, 0]], [[0, 0, 255], [0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 0, 0]]]
    s, _ = formats.read_png(png(2, 1, 8, 3, [bytes([2, 0])], PLTE=palette, tRNS=b"\x07"))
    assert s.tolist() == [[[0, 0, 255, 255], [255, 0, 0, 7]]]
    with pytest.raises(ValueError, match="palette"):
        formats.read_png(png(1, 1, 8, 3, [b"\3"], PLTE=palette))
    for depth, row, want in ((1, 0b10100000, [255, 0, 255]), (2, 0b00011100, [0, 85, 255]), (4, 0x3F, [51, 255])):
        s, _ = formats.read_png(png(len(want), 1, depth, 0, [bytes([row])]))
        assert s[0, :, 0].tolist() == want


def test_colour_keys():
    s, _ = formats.read_png(png(2, 1, 8, 2, [bytes([1, 2, 3, 1, 2, 4])], tRNS=struct.pack(">HHH", 1, 2, 3)))
    assert s.tolist() == [[[1, 2, 3, 0], [1, 2, 4, 255]]]
    s, _ = formats.read_png(png(2, 1, 4, 0, [b"\x5a"], tRNS=struct.pack(">H", 5)))
    assert s[0, :, 0].tolist() == [85, 170] and s[0, :, 1].tolist() == [0, 255]
    s, _ = formats.read_png(png(1, 1, 16, 0, [b"\1\2"], tRNS=struct.pack(">H", 258)))
    assert s.tolist() == [[[258, 0]]]
