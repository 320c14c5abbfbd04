"""The picture source and its verified sink."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photonframe.sources import formats, heads, pictures
from photonframe.sources.heads import Ranged
from tests.test_blocks import AVIF, EXR, attribute, box, segment

PICTURES = "name string, height int, width int, channels int, depth int, data binary, cicp binary"


def samples(seed: int, h: int, w: int, c: int = 3, depth: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << depth, (h, w, c)).astype("<u2" if depth == 16 else np.uint8)


def row(name: str, s: np.ndarray, cicp: bytes | None = None) -> tuple:
    return (name, *s.shape, s.dtype.itemsize * 8, bytearray(s.tobytes()), None if cicp is None else bytearray(cicp))


def files_below(folder) -> list[str]:  # type: ignore[no-untyped-def]
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_round_trip(spark, tmp_path):
    own = {"a.png": samples(1, 9, 7), "deep/er/b.png": samples(2, 5, 30, 4, 16), "g.png": samples(3, 1, 1, 1), "é x.png": samples(4, 64, 3, 2, 16)}
    made = spark.createDataFrame([row(n, s, bytes([9, 16, 0, 1]) if n == "a.png" else None) for n, s in own.items()], PICTURES)
    pictures.write(made.repartition(3), str(tmp_path))
    assert files_below(tmp_path) == sorted(own)  # nothing else is left
    got = {os.path.relpath(r.path, tmp_path): r for r in pictures.read(spark, str(tmp_path), "samples").collect()}
    for n, s in own.items():
        assert got[n].error is None and (got[n].rows, got[n].columns, got[n].channels, got[n].depth) == (*s.shape, s.dtype.itemsize * 8)
        assert bytes(got[n].data) == s.tobytes() and got[n].length == os.path.getsize(tmp_path / n)
    assert bytes(got["a.png"].cicp) == bytes([9, 16, 0, 1]) and got["a.png"].hdr and not got["g.png"].hdr
    assert pictures.read(spark, str(tmp_path / "a.png")).count() == 1


def test_heads_and_regions_read_little(spark, tmp_path):
    big = samples(5, 500, 400, 3, 16)
    (tmp_path / "big.png").write_bytes(formats.write_png(big.astype(np.uint16), level=0))
    size = os.path.getsize(tmp_path / "big.png")
    head = pictures.read(spark, str(tmp_path)).first()
    assert (head.width, head.height, head.depth) == (400, 500, 16) and head.bytes_read <= 8192 < size
    region = pictures.read(spark, str(tmp_path), "samples", (40, 111, 30, 77)).first()
    got = np.frombuffer(region.data, "<u2").reshape(region.rows, region.columns, 3)
    assert (got == big[40:70, 111:188]).all() and region.bytes_read < size / 5
    edge = pictures.read(spark, str(tmp_path), "samples", (490, 390, 50, 50)).first()
    assert (edge.rows, edge.columns) == (10, 10) and bytes(edge.data) == big[490:, 390:].tobytes()


def test_filters_are_pushed(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"p{k}.png").write_bytes(formats.write_png(samples(k, 4 + k, 10, 1)))
    (tmp_path / "_hidden.png").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("no picture")
    tall = pictures.read(spark, str(tmp_path), "samples", where=[("height", ">", 6), ("path", "endswith", ".png"), ("format", "in", ["png", "jpeg"])])
    assert sorted(r.height for r in tall.collect()) == [7, 8, 9]
    seen = pictures.read(spark, str(tmp_path))  # one DataFrame, several queries
    assert [seen.where(c).count() for c in ("height > 6", "height < 6", "true", "height = 4")] == [3, 2, 7, 1]
    small = pictures.read(spark, str(tmp_path), "samples", where=[("height", "<=", 4)]).collect()
    assert len(small) == 1 and small[0].rows == 4
    with pytest.raises(Exception, match="has no test"):
        pictures.read(spark, str(tmp_path), where=[("height", "~", 1)]).count()
    assert pictures.read(spark, str(tmp_path)).where("format = 'unknown'").count() == 1
    assert pictures.read(spark, str(tmp_path), runFiles="2", where=[("path", "endswith", ".png")]).rdd.getNumPartitions() == 3
    assert [len(r.files) for r in pictures.runs_of([("a", 10, 0), ("b", 90, 0), ("c", 5, 0), ("d", 200, 0), ("e", 1, 0)], 100, 9)] == [2, 1, 1, 1]


def test_unknown_is_no_pass():
    row = {"path": "a/b.png", "width": 5, "height": None}
    assert not pictures.passes(("height", "=", 3), row) and not pictures.passes(("format", "in", ["png"]), row)
    assert pictures.passes(("path", "contains", "/b"), row) and pictures.passes(("width", ">", 4), row) and not pictures.passes(("width", "<=", 4), row)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    good = [row(f"{k}.png", samples(k, 3, 3)) for k in range(8)]
    bad = ("bad.png", 3, 3, 3, 8, bytearray(b"short"), None)
    with pytest.raises(Exception, match="reshape|buffer"):
        pictures.write(spark.createDataFrame([*good, bad], PICTURES).repartition(4), str(tmp_path / "out"))
    assert files_below(tmp_path) == []
    for _ in range(3):
        with pytest.raises(Exception, match="reshape|buffer"):
            pictures.write(spark.createDataFrame([bad, *good], PICTURES).repartition(9), str(tmp_path / "out"))
    for name in ("../out.png", "/abs.png", "x.webp", None, ""):
        with pytest.raises(Exception, match="no file of the name"):
            pictures.write(spark.createDataFrame([row(name, samples(1, 2, 2))], PICTURES), str(tmp_path / "out"))
    with pytest.raises(Exception, match="given twice"):
        pictures.write(spark.createDataFrame([*good, good[0]], PICTURES).repartition(4), str(tmp_path / "out"))
    assert files_below(tmp_path) == []


def test_existing_files(spark, tmp_path):
    first, other = samples(1, 2, 2), samples(2, 2, 2)
    pictures.write(spark.createDataFrame([row("a.png", first)], PICTURES), str(tmp_path))
    with pytest.raises(Exception, match="exist"):
        pictures.write(spark.createDataFrame([row("b.png", other), row("a.png", other)], PICTURES), str(tmp_path))
    assert files_below(tmp_path) == ["a.png"] and (formats.read_png((tmp_path / "a.png").read_bytes())[0] == first).all()
    pictures.write(spark.createDataFrame([row("a.png", other)], PICTURES), str(tmp_path), overwrite=True)
    assert (formats.read_png((tmp_path / "a.png").read_bytes())[0] == other).all()


@pytest.mark.parametrize("harm", ["flip", "cut", "other"])
def test_a_corrupted_file_aborts(tmp_path, harm):
    """What the store gives back is not what was written."""

    class Harmed(pictures.PictureWriter):
        def _stored(self, store, path):  # type: ignore[no-untyped-def]
            data = bytearray(super()._stored(store, path))
            if harm == "flip":
                data[60] ^= 1
            return bytes(data[:-20]) if harm == "cut" else formats.write_png(samples(9, 4, 4)) if harm == "other" else bytes(data)

    writer = Harmed({"path": str(tmp_path)}, False)
    schema = pa.schema([("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("data", pa.binary()), ("cicp", pa.binary())])
    s = samples(1, 4, 4)
    batch = pa.RecordBatch.from_pylist([{"name": "a.png", "height": 4, "width": 4, "channels": 3, "depth": 8, "data": s.tobytes(), "cicp": None}], schema=schema)
    writer.begin()
    with pytest.raises(pictures.VerificationError):
        writer.write(iter([batch]))
    assert [os.path.basename(f) for f in files_below(tmp_path)] == ["job"]  # the task has cleared up itself
    writer.abort([])
    assert files_below(tmp_path) == []
    with pytest.raises(RuntimeError, match="over"):  # a task that starts late
        writer.write(iter([batch]))
    assert files_below(tmp_path) == []


def ranged(data: bytes) -> Ranged:
    return Ranged(lambda at, n: data[at : at + n], len(data))


def tiff(order: str, tags: dict[int, tuple[int, int]]) -> bytes:
    body = struct.pack(f"{order}H", len(tags))
    for tag, (kind, value) in sorted(tags.items()):
        body += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8) + body + b"\0\0\0\0"


FRAME = segment(0xC0, struct.pack(">BHHB", 8, 30, 40, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
EXIF = segment(0xE1, b"Exif\0\0" + tiff(">", {274: (3, 6)}))


def avif(transfer: int, rotated: bool = False) -> bytes:
    props = box(b"ispe", struct.pack(">III", 0, 640, 480)) + box(b"ispe", struct.pack(">III", 0, 64, 48)) + box(b"colr", b"nclx" + struct.pack(">HHHB", 9, transfer, 9, 0x80)) + box(b"pixi", b"\0\0\0\0\3\12\12\12") + box(b"irot", b"\3")
    owned = struct.pack(">IIHB", 0, 2, 1, 3 + rotated) + bytes([1, 3, 4, 5][: 3 + rotated]) + struct.pack(">HB", 2, 1) + b"\2"
    meta = box(b"pitm", struct.pack(">IH", 0, 1)) + box(b"iprp", box(b"ipco", props) + box(b"ipma", owned))
    return box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"\0\0\0\0" + meta) + box(b"mdat", b"x" * 100_000)


HEADS = {
    "jpeg": (b"\xff\xd8" + EXIF + FRAME + segment(0xDA, b"") + b"\0" * 100_000, ("jpeg", 40, 30, 8, 3, False, 6)),
    "gain map": (b"\xff\xd8" + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x hdrgm:Version='1.0'/>" + b" " * 40) + FRAME + segment(0xDA, b""), ("gain-map", 40, 30, 8, 3, False, 1)),
    "pq": (avif(16), ("avif", 640, 480, 10, 3, True, 1)),
    "srgb": (avif(13, True), ("avif", 640, 480, 10, 3, False, 6)),
    "tiff": (tiff("<", {256: (4, 3000), 257: (3, 2000), 258: (3, 16), 277: (3, 3), 274: (3, 8)}), ("tiff", 3000, 2000, 16, 3, False, 8)),
    "exr": (b"\x76\x2f\x31\x01\x02\0\0\0" + attribute(b"channels", b"chlist", b"".join(c + b"\0" + struct.pack("<iiii", 1, 0, 1, 1) for c in (b"B", b"G", b"R")) + b"\0") + attribute(b"dataWindow", b"box2i", struct.pack("<4i", -10, 0, 89, 49)) + b"\0", ("exr", 100, 50, 16, 3, True, 1)),
    "rgbe": (b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 12 +X 34\n" + b"\0" * 50, ("rgbe", 34, 12, 32, 3, True, 1)),
    "webp": (b"RIFF\0\0\0\0WEBPVP8X\n\0\0\0\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), ("webp", 100, 50, 8, 4, False, 1)),
    "bmp": (b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 5, -6, 1, 24) + b"\0" * 20, ("bmp", 5, 6, 8, 3, False, 1)),
    "gif": (b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 20, ("gif", 3, 4, 8, 1, False, 1)),
    "none": (b"plain text of some length", ("unknown", None, None, None, None, False, 1)),
}


@pytest.mark.parametrize("name", sorted(HEADS))
def test_heads(name):
    data, want = HEADS[name]
    r = ranged(data)
    h = heads.head_of(r)
    assert (h.format, h.width, h.height, h.depth, h.channels, h.hdr, h.orientation) == want and r.read <= 2 * heads.PAGE
    assert h.upright() == ((h.height, h.width) if h.orientation >= 5 else (h.width, h.height))


def test_damaged_heads(spark, tmp_path):
    """Every file cut at every place gives a head or a ValueError, and a row either way."""
    png = formats.write_png(samples(1, 2, 2), {"cICP": bytes([9, 18, 0, 1]), "eXIf": tiff("<", {274: (3, 3)})})
    assert heads.head_of(ranged(png)).orientation == 3 and heads.head_of(ranged(png)).hdr
    for data in (png, AVIF, EXR, *(d[:600] for d, _ in HEADS.values())):
        for n in range(len(data)):
            try:
                heads.head_of(ranged(data[:n]))
            except ValueError:
                pass
    (tmp_path / "cut.png").write_bytes(png[:20])
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "crc.png").write_bytes(png[:-1] + b"x")
    (tmp_path / "photo.jpg").write_bytes(HEADS["jpeg"][0])
    got = {os.path.basename(r.path): r for r in pictures.read(spark, str(tmp_path), "samples").collect()}
    assert len(got) == 4 and all(r.data is None and r.error for n, r in got.items() if n != "empty.png") and got["photo.jpg"].width == 40 and "scan" in got["photo.jpg"].error
    region = {os.path.basename(r.path): r for r in pictures.read(spark, str(tmp_path), "samples", (0, 0, 9, 9)).collect()}
    assert region["crc.png"].error is None and region["cut.png"].error
    assert pictures.read(spark, str(tmp_path / "nothing-here")).count() == 0 if os.makedirs(tmp_path / "nothing-here") is None else False


def test_cut_samples():
    s = samples(3, 40, 10)
    data = formats.write_png(s)
    short = data[:33] + struct.pack(">I", 50) + b"IDAT" + data[41:91] + struct.pack(">I", zlib.crc32(b"IDAT" + data[41:91]))
    with pytest.raises(ValueError):
        pictures.read_rows(ranged(short), 0, 40)


def test_from_pixels(spark, tmp_path):
    px = spark.createDataFrame([(7, y, x, y, x, 9) for y in range(3) for x in range(4) if (y, x) != (1, 1)], "image_id long, y int, x int, r int, g int, b int")
    pictures.write(pictures.from_pixels(px, "concat('i', image_id, '.png')", 16), str(tmp_path))
    back = pictures.read(spark, str(tmp_path), "samples").first()
    got = np.frombuffer(back.data, "<u2").reshape(3, 4, 3)
    assert got[2, 3].tolist() == [2, 3, 9] and got[1, 1].tolist() == [0, 0, 0]
