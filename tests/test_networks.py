"""Networks in tiles against the whole picture and against loops."""

from __future__ import annotations

import numpy as np
import pytest

from photonframe.operators import networks
from photonframe.plans import pipeline


def picture(h: int, w: int) -> np.ndarray:
    return np.random.default_rng(h).integers(0, 256, (3, h, w))


def frame(spark, p, name=0):
    _, h, w = p.shape
    return spark.createDataFrame([(name, y, x, *(int(v) for v in p[:, y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")


def by_loops(net: networks.Network, p: np.ndarray) -> np.ndarray:
    x = p
    for k, (w, b) in enumerate(zip(net.weights, net.biases, strict=True)):
        _, h, v = x.shape
        out = np.zeros((len(b), h, v))
        for o in range(len(b)):
            for y in range(h):
                for c in range(v):
                    total = b[o]
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            if 0 <= y + dy < h and 0 <= c + dx < v:
                                total += float(w[o, :, dy + 1, dx + 1] @ x[:, y + dy, c + dx])
                    out[o, y, c] = total * (net.slopes[k][o] if k < len(net.slopes) and total < 0 else 1)
        x = out
    s = net.scale
    big = np.zeros((3, s * p.shape[1], s * p.shape[2]))
    for c in range(3):
        for y in range(big.shape[1]):
            for v in range(big.shape[2]):
                big[c, y, v] = x[c * s * s + y % s * s + v % s, y // s, v // s] + p[c, y // s, v // s]
    return big


@pytest.mark.parametrize("scale", [1, 2, 3])
def test_a_network_by_loops(scale):
    net = networks.seeded(4, 2, scale)
    p = picture(6, 7) / 255.0
    assert np.abs(net(p) - by_loops(net, p)).max() < 1e-12


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_tiles_are_as_the_whole(spark, tile):
    net = networks.seeded(5, 3, 2, 0.2)
    a, b = picture(13, 21), picture(9, 8)
    got = networks.upscale(frame(spark, a).unionByName(frame(spark, b, 1)), 2, net, tile).collect()
    for name, p in ((0, a), (1, b)):
        want = np.floor(np.clip(net(p / 255.0) * 255 + 0.5, 0, 255)).astype(int)
        mine = np.full(want.shape, -1)
        for r in got:
            if r.image_id == name:
                mine[:, r.y, r.x] = r.r, r.g, r.b
        assert (mine == want).all() and len(np.unique(want)) > 50
    assert len(got) == 4 * (13 * 21 + 72)


def test_a_tile_that_fails_is_halved():
    net = networks.seeded(4, 2, 2)
    p = picture(40, 31) / 255.0
    sizes = []

    def short(x):
        sizes.append(x.shape[1] * x.shape[2])
        if sizes[-1] > 300:
            raise MemoryError
        return net(x)

    assert np.abs(networks.infer(short, p, net.reach, 2) - net(p)).max() < 1e-12 and max(sizes) == 1240 and min(sizes) <= 300
    assert np.abs(networks.infer(net, p, net.reach, 2, most=200) - net(p)).max() < 1e-12

    def never(x):
        raise MemoryError

    with pytest.raises(MemoryError):
        networks.infer(never, p, net.reach, 2)


def test_weights_by_digest(spark):
    net = networks.seeded(4, 1, 2)
    rows = networks.rows_of("tiny", net)
    table = spark.createDataFrame([*rows, *networks.rows_of("other", networks.seeded(3, 1, 1))], networks.WEIGHTS)
    back = networks.load(table.repartition(3), "tiny", 2, networks.digest(rows))
    assert all((a == b).all() for a, b in zip(net.weights + net.slopes, back.weights + back.slopes, strict=True)) and back.reach == 2
    harmed = [(*rows[0][:4], bytearray(b"\1") + rows[0][4][1:]), *rows[1:]]
    for bad in (spark.createDataFrame(harmed, networks.WEIGHTS), table.where("layer = 0"), table.limit(0)):
        with pytest.raises(networks.DigestError):
            networks.load(bad, "tiny", 2, networks.digest(rows))
    with pytest.raises(ValueError, match="outputs"):
        networks.Network(net.weights, net.biases, net.slopes, 3)
    with pytest.raises(ValueError, match="cannot give"):
        networks.upscale(frame(spark, picture(2, 2)), 4, net)


def test_in_the_builder(spark):
    net = networks.seeded(3, 1, 2)
    networks.register("tiny", net)
    p = picture(4, 6)
    got = pipeline.run(frame(spark, p), pipeline.Options(scale=2), upscaler="tiny")
    assert got.count() == 96 and got.columns == ["image_id", "y", "x", "r", "g", "b"]
