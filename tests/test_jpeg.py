"""JPEG against the JVM's own codec, gain-map files, Radiance."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.sources import blocks, formats, gainfile, heads, jpeg, pictures, radiance
from tests.test_pictures import files_below, ranged


def photo(h: int, w: int, seed: int = 0) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    flat = np.stack([128 + 100 * np.sin(x / 30 + seed), 128 + 90 * np.cos(y / 25), (x + 2 * y) % 256 * 0.8], axis=2)
    return np.clip(flat + np.random.default_rng(seed).normal(0, 3, flat.shape), 0, 255).astype(np.uint8)


def by_jvm(spark, data: bytes) -> np.ndarray:
    """What javax.imageio makes of a file."""
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    h, w = picture.getHeight(), picture.getWidth()
    if picture.getRaster().getNumBands() == 1:  # whose getRGB goes through a colour space
        grey = np.frombuffer(bytes(picture.getRaster().getDataBuffer().getData()), np.uint8).reshape(h, w, 1)
        return grey.repeat(3, axis=2).astype(int)
    argb = np.array(list(picture.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=2).astype(int)


def jvm_file(spark, samples: np.ndarray, progressive: bool = False) -> bytes:
    jvm = spark._jvm
    h, w, _ = samples.shape
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in samples[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(1)  # by default scans
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    writer.dispose()
    return bytes(out.toByteArray())


@pytest.mark.parametrize(("shape", "quality"), [((40, 56), 95), ((33, 17), 100), ((8, 8), 50), ((1, 1), 95), ((21, 70), 80), ((16, 16), 5)])
def test_encoded_files_are_read_by_others(spark, shape, quality):
    s = photo(*shape)
    data = jpeg.encode(s, quality)
    mine, theirs = jpeg.decode(data).astype(int), by_jvm(spark, data)
    assert mine.shape == s.shape
    if quality >= 90:  # both without interpolation of colour
        assert np.abs(mine - theirs).max() <= 2 and np.abs(mine - s).mean() < (1 if quality == 100 else 3)
    else:
        assert np.abs(mine - theirs).mean() < 3
    grey = jpeg.encode(s[:, :, :1], quality)
    assert np.abs(jpeg.decode(grey)[:, :, 0].astype(int) - by_jvm(spark, grey)[:, :, 0]).max() <= 1


def test_files_of_others(spark):
    s = photo(37, 50)
    data = jvm_file(spark, s)  # colour at a quarter
    assert np.abs(jpeg.decode(data).astype(int) - by_jvm(spark, data)).mean() < 2.5
    flat = np.full((24, 40, 3), (200, 30, 90), np.uint8)
    data = jvm_file(spark, flat)
    assert np.abs(jpeg.decode(data).astype(int) - by_jvm(spark, data)).max() <= 1  # known planes, within a level
    with pytest.raises(ValueError, match="progressive"):
        jpeg.decode(jvm_file(spark, s, progressive=True))


@pytest.mark.parametrize("shrink", [2, 4, 8])
def test_shrunk(shrink):
    s = photo(61, 83)
    got = jpeg.decode(jpeg.encode(s, 98), shrink)
    h, w = -(-61 // shrink), -(-83 // shrink)
    padded = np.pad(s, ((0, -61 % shrink), (0, -83 % shrink), (0, 0)), mode="edge").astype(float)
    assert got.shape == (h, w, 3) and np.abs(got - padded.reshape(h, shrink, w, shrink, 3).mean(axis=(1, 3))).mean() < 2


def test_restart_marks():
    """Intervals are put in by hand: each begins at a whole byte, with predictions of nothing."""
    s = np.repeat(np.repeat(np.random.default_rng(4).integers(0, 255, (2, 5, 1)), 8, axis=0), 8, axis=1).astype(np.uint8)
    parts = [jpeg.encode(s[8 * y : 8 * y + 8, 8 * x : 8 * x + 8], 100) for y in range(2) for x in range(5)]
    # Blocks of one level differ in their first coefficient alone; a table that fits all of them
    lengths = {k: 4 for k in range(12)}
    per = [0, 0, 0, 12] + [0] * 12
    scan = b""
    for k in range(10):
        level = 8 * (int(s[8 * (k // 5), 8 * (k % 5), 0]) - 128)
        n = int(np.ceil(np.log2(abs(level) + 1)))
        bits = format(sorted(lengths).index(n), "04b") + (format(level if level > 0 else level + (1 << n) - 1, f"0{n}b") if n else "") + "0"
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k % 8]) if k < 9 else b"")
    seg = lambda mark, b: b"\xff" + bytes([mark]) + struct.pack(">H", 2 + len(b)) + b
    tables = seg(0xC4, b"\0" + bytes(per) + bytes(range(12)) + b"\x10" + bytes([1] + [0] * 15) + b"\0")
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, struct.pack(">BHHB", 8, 16, 40, 1) + b"\1\x11\0") + tables + seg(0xDD, struct.pack(">H", 1)) + seg(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"
    assert (jpeg.decode(data) == s).all() and len(parts) == 10


def test_damage(spark):
    data = jpeg.encode(photo(24, 24), 90)
    for n in range(0, len(data), 7):
        with pytest.raises(ValueError):
            jpeg.decode(data[:n])
    r = np.random.default_rng(1)
    for _ in range(60):
        harmed = bytearray(data)
        harmed[r.integers(2, len(data))] ^= 1 << int(r.integers(8))
        try:
            assert jpeg.decode(bytes(harmed)).ndim == 3
        except (ValueError, struct.error):
            pass


def test_code_lengths():
    from fractions import Fraction

    for seed in range(20):
        r = np.random.default_rng(seed)
        frequency = {int(s): int(2 ** r.uniform(0, 30)) for s in r.choice(256, r.integers(1, 200), replace=False)}
        lengths = jpeg.code_lengths(frequency)
        assert lengths.keys() == frequency.keys() and max(lengths.values()) <= 16
        assert sum(Fraction(1, 1 << n) for n in lengths.values()) < 1  # the code of all ones is free
        assert all(lengths[a] <= lengths[b] for a in frequency for b in frequency if frequency[a] > frequency[b])


def test_jpeg_through_source_and_sink(spark, tmp_path):
    s = photo(40, 64)
    exif = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    schema = "name string, height int, width int, channels int, depth int, data binary, quality int, exif binary"
    pictures.write(spark.createDataFrame([("a/p.jpg", 40, 64, 3, 8, bytearray(s.tobytes()), 92, bytearray(exif))], schema), str(tmp_path))
    assert files_below(tmp_path) == ["a/p.jpg"]
    got = pictures.read(spark, str(tmp_path), "samples").first()
    assert (got.format, got.width, got.height, got.orientation, got.error) == ("jpeg", 64, 40, 6, None)
    assert np.abs(np.frombuffer(got.data, np.uint8).reshape(40, 64, 3).astype(int) - s).mean() < 3
    small = pictures.read(spark, str(tmp_path), "samples", shrink="4").first()
    assert (small.rows, small.columns) == (10, 16)
    part = pictures.read(spark, str(tmp_path), "samples", (8, 16, 10, 12)).first()
    assert bytes(part.data) == np.frombuffer(got.data, np.uint8).reshape(40, 64, 3)[8:18, 16:28].tobytes()
    noise = np.random.default_rng(1).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    with pytest.raises(Exception, match="other samples"):  # too lossy to pass
        pictures.write(spark.createDataFrame([("n.jpg", 64, 64, 3, 8, bytearray(noise.tobytes()), 1, None)], schema), str(tmp_path / "x"))


def test_gain_map_files(spark, tmp_path):
    s, codes = photo(32, 48), np.random.default_rng(2).integers(0, 256, (8, 12)).astype(np.uint8)
    rows = spark.createDataFrame([("g.jpg", 32, 48, bytearray(s.tobytes()), 8, 12, bytearray(codes.tobytes()), -0.5, 2.25, 2.25)], "name string, height int, width int, data binary, gain_height int, gain_width int, gain_data binary, gain_min double, gain_max double, headroom double")
    made = gainfile.gain_map_files(rows)
    pictures.write(made, str(tmp_path))
    data = (tmp_path / "g.jpg").read_bytes()
    assert heads.head_of(ranged(data)).format == "gain-map" and np.abs(by_jvm(spark, data) - s).mean() < 3
    content = spark.createDataFrame([("g", bytearray(data))], "path string, content binary")
    found = {r.n: (r.offset, r.length) for r in blocks.embedded_pictures(content).collect()}
    assert found[0][1] + found[1][1] == len(data) and found[1][0] == found[0][1]
    second = data[found[1][0] :][: found[1][1]]
    assert np.abs(jpeg.decode(second)[:, :, 0].astype(int) - codes).max() <= 1
    xmp = spark.createDataFrame([(second[2:1500].decode("latin-1"),)], "x string").select(formats.gain_map_metadata(F.col("x")).alias("m")).first().m
    assert (xmp.GainMapMin, xmp.GainMapMax, xmp.HDRCapacityMax, xmp.Gamma) == ([-0.5], [2.25], [2.25], [1.0])
    assert f'Item:Length="{found[1][1]}"'.encode() in data[: found[0][1]]
    three = gainfile.assemble(jpeg.encode(s), jpeg.encode(codes[:, :, None]), {"GainMapMax": (1.0, 2.0, 3.0)})
    own = spark.createDataFrame([(three[three.rindex(b"\xff\xd8") :][:1500].decode("latin-1"),)], "x string").select(formats.gain_map_metadata(F.col("x")).alias("m")).first().m
    assert own.GainMapMax == [1.0, 2.0, 3.0]


def test_radiance(spark, tmp_path):
    r = np.random.default_rng(3)
    want = np.exp(r.normal(0, 2, (5, 40, 3)))
    high = want.max(axis=2)
    power = np.floor(np.log2(high)).astype(int) + 1
    bytes_ = np.concatenate([np.floor(want / (2.0**power)[:, :, None] * 256), (power + 128)[:, :, None]], axis=2).astype(np.uint8)
    bytes_[2, 10:30] = bytes_[2, 10]
    head = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 5 +X 40\n"
    runs = b""
    for row in bytes_:
        runs += b"\2\2\0\x28"
        for plane in row.T:
            x = 0
            while x < 40:
                n = 1
                while x + n < 40 and n < 127 and plane[x + n] == plane[x]:
                    n += 1
                runs += bytes([128 + n, plane[x]]) if n > 2 else bytes([1, plane[x]])
                x += n if n > 2 else 1
    exact = bytes_[:, :, :3] * np.where(bytes_[:, :, 3:] > 0, 2.0 ** (bytes_[:, :, 3:].astype(int) - 136), 0)
    for body in (bytes_.tobytes(), runs):
        got = radiance.decode(head + body)
        assert np.abs(got - exact).max() < 1e-6 * exact.max() and got.dtype == np.float32
        with pytest.raises(ValueError):
            radiance.decode((head + body)[:-3])
    (tmp_path / "a.hdr").write_bytes(head + runs)
    row = pictures.read(spark, str(tmp_path), "samples", (1, 2, 3, 4)).first()
    assert row.hdr and (np.frombuffer(row.data, "<f4").reshape(3, 4, 3) == radiance.decode(head + runs)[1:4, 2:6]).all()
    assert os.path.basename(row.path) == "a.hdr"
