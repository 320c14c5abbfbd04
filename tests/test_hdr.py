"""HDR files through models and back."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from photonframe.operators import networks, resample
from photonframe.plans import hdr
from photonframe.sources import formats, pictures
from tests.test_pictures import files_below


def nits(codes):
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    e = (codes / 65535) ** (1 / m2)
    return 10000 * (np.maximum(e - c1, 0) / (c2 - c3 * e)) ** (1 / m1)


def scene(h, w, seed):
    r = np.random.default_rng(seed)
    light = np.exp(r.normal(3, 2, (h, w, 3))).clip(0.05, 4000)
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = (light / 10000) ** m1
    return np.rint(((c1 + c2 * p) / (1 + c3 * p)) ** m2 * 65535).astype(np.uint16)


def test_a_folder_through_a_model(spark, tmp_path):
    """With a model that changes nothing the values come back, at twice the size."""
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    one, two = scene(24, 31, 1), scene(16, 16, 2)
    (source / "a.png").write_bytes(formats.write_png(one, {"cICP": bytes([9, 16, 0, 1])}))
    (source / "deep" / "b.png").write_bytes(formats.write_png(two, {"cICP": bytes([9, 16, 0, 1])}))
    (source / "sdr.png").write_bytes(formats.write_png(np.zeros((2, 2, 3), np.uint8)))
    left = hdr.run_folder(spark, str(source), str(target), lambda px: resample.nearest(px, 2)).collect()
    assert [(r.path.split("/")[-1], r.reason) for r in left] == [("sdr.png", "no PQ or HLG PNG")] and files_below(target) == ["a.png", "deep/b.png"]
    for name, want in (("a.png", one), ("deep/b.png", two)):
        got, extra = formats.read_png((target / name).read_bytes())
        assert extra["cICP"] == bytes([9, 16, 0, 1]) and got.shape == (2 * want.shape[0], 2 * want.shape[1], 3)
        then, now = nits(want.repeat(2, axis=0).repeat(2, axis=1)), nits(got)
        bright = then > 0.5
        assert np.quantile(np.abs(now - then)[bright] / then[bright], 0.999) < 0.002
        most, mean = struct.unpack(">II", extra["cLLi"])
        assert abs(most / 10000 - now.max()) < 0.01 * now.max() and mean < most
    heads = pictures.read(spark, str(target)).collect()
    assert all(h.hdr and h.depth == 16 for h in heads)


def test_primaries_and_hlg(spark):
    px = spark.createDataFrame([(0, 0, 0, 30000, 30000, 30000), (0, 0, 1, 40000, 10000, 5000)], "image_id long, y int, x int, r int, g int, b int")
    grey = {p: hdr.decode(px, F.lit(16), F.lit(p)).orderBy("x").collect() for p in (1, 9, 12)}
    assert all(abs(rows[0].r - grey[9][0].r) < 1e-6 and abs(rows[0].r - rows[0].b) < 1e-6 for rows in grey.values())  # grey stays grey
    assert grey[1][1].r < grey[12][1].r < grey[9][1].r  # a red of narrower primaries is less of a red
    hlg = hdr.decode(px, F.lit(18), F.lit(9)).orderBy("x").collect()
    assert abs(hlg[0].r - hlg[0].g) < 1e-9 and hlg[0].r != grey[9][0].r


def test_a_network_at_16_bits(spark):
    net = networks.seeded(3, 1, 2)
    s = scene(9, 11, 5).astype(int)
    px = spark.createDataFrame([(0, y, x, *map(int, s[y, x])) for y in range(9) for x in range(11)], "image_id long, y int, x int, r int, g int, b int")
    want = np.floor(np.clip(net(s.transpose(2, 0, 1) / 65535.0) * 65535 + 0.5, 0, 65535)).astype(int)
    for r in networks.upscale(px, 2, net, 4, top=hdr.TOP).collect():
        assert (want[:, r.y, r.x] == (r.r, r.g, r.b)).all()
