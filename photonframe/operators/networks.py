"""Upscaling by convolutional networks, tile by tile.

A network is a table of weights with a digest. Its layers are 3 x 3 convolutions with a slope
for negative values between them; the last one gives scale^2 values for each channel, which
are laid out as pixels over the repeated picture. A tile takes as many neighbouring pixels as
the network reaches, so tiles give what the whole picture would, to the last bit and at the
edges too. A tile that needs more memory than there is, is halved and tried again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from photonframe.operators.repair import with_halo

MOST_BYTES = 256 << 20  # of weights that are broadcast at most
WEIGHTS = "model string, layer int, name string, shape array<int>, data binary"


class DigestError(ValueError):
    """Weights that are not those that were registered."""


@dataclass(frozen=True)
class Network:
    """weights: (outputs, inputs, 3, 3) of each layer; biases and slopes by output, no slope
    after the last layer."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    slopes: tuple[np.ndarray, ...]
    scale: int

    def __post_init__(self) -> None:
        inputs = 3
        for w, b in zip(self.weights, self.biases, strict=True):
            if w.shape[1:] != (inputs, 3, 3) or b.shape != w.shape[:1]:
                raise ValueError(f"a layer of {w.shape} after {inputs} channels")
            inputs = w.shape[0]
        if inputs != 3 * self.scale**2 or [s.shape for s in self.slopes] != [b.shape for b in self.biases[:-1]]:
            raise ValueError(f"{inputs} outputs for a scale of {self.scale}")

    @property
    def reach(self) -> int:
        """Pixels to each side that a pixel of the result depends on."""
        return len(self.weights)

    def __call__(self, picture: np.ndarray) -> np.ndarray:
        """(3, height, width) of 0..1 to (3, scale * height, scale * width)."""
        x = picture
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            h, v = x.shape[1:]
            p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
            # Nine matrix products over all pixels, one for each place in the kernel
            y = sum(w[:, :, dy, dx] @ p[:, dy : dy + h, dx : dx + v].reshape(p.shape[0], -1) for dy in range(3) for dx in range(3))
            y = (y + b[:, None]).reshape(-1, h, v)
            x = np.where(y < 0, y * self.slopes[k][:, None, None], y) if k < len(self.slopes) else y
        s = self.scale
        laid = x.reshape(3, s, s, *picture.shape[1:]).transpose(0, 3, 1, 4, 2).reshape(3, s * picture.shape[1], s * picture.shape[2])
        return laid + picture.repeat(s, axis=1).repeat(s, axis=2)


def infer(network: Callable[[np.ndarray], np.ndarray], picture: np.ndarray, reach: int, scale: int, most: int = 1 << 20) -> np.ndarray:
    """The network's result. A picture of more than ``most`` pixels, or one that memory does
    not suffice for, is halved along its longer side; each half has its neighbours' pixels."""
    _, h, w = picture.shape
    if h * w <= most:
        try:
            return network(picture)
        except MemoryError:
            if max(h, w) <= 2 * reach + 1:  # halves would be as large
                raise
    axis = 1 if h >= w else 2
    n = picture.shape[axis]
    half = n // 2
    take = lambda a, lo, hi: a[:, lo:hi] if axis == 1 else a[:, :, lo:hi]
    again = partial(infer, network, reach=reach, scale=scale, most=max(most // 2 if h * w <= most else most, 1))
    if half + reach >= n:  # no smaller with its neighbours
        return network(picture)
    first = take(again(take(picture, 0, half + reach)), 0, half * scale)
    start = max(0, half - reach)
    second = take(again(take(picture, start, n)), (half - start) * scale, (n - start) * scale)
    return np.concatenate([first, second], axis=axis)


# ---- weights as a table
def rows_of(model: str, network: Network) -> list[tuple]:
    """Rows of ``WEIGHTS``: little-endian doubles."""
    out = []
    for name in ("weights", "biases", "slopes"):
        for k, a in enumerate(getattr(network, name)):
            out.append((model, k, name, list(a.shape), bytearray(a.astype("<f8").tobytes())))
    return out


def digest(rows: list) -> str:
    """SHA-256 over a model's rows in the order of their names and layers."""
    h = hashlib.sha256()
    for _, layer, name, shape, data in sorted((tuple(r) for r in rows), key=lambda r: (r[2], r[1])):
        h.update(f"{name}:{layer}:{shape}:".encode() + bytes(data))
    return h.hexdigest()


def load(table: DataFrame, model: str, scale: int, registered: str) -> Network:
    """A model of a table of weights, if it is the one that was registered."""
    from pyspark.sql import functions as F

    own = table.where(F.col("model") == model)
    size = own.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of weights are too many to broadcast")
    rows = own.select("model", "layer", "name", "shape", "data").collect()
    if digest(rows) != registered:
        raise DigestError(f"the weights of {model} are not those registered")
    arrays = {(r["name"], r["layer"]): np.frombuffer(r["data"], "<f8").reshape(r["shape"]) for r in rows}
    layers = lambda name: tuple(a for (n, _), a in sorted(arrays.items()) if n == name)
    return Network(layers("weights"), layers("biases"), layers("slopes"), scale)


def upscale(px: DataFrame, factor: int, network: Network, tile: int = 256, top: int = 255) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) of levels 0 to ``top`` at ``factor`` times the size; the
    network's own scale has to be that. A task holds a tile with its neighbours and the network."""
    if factor != network.scale:
        raise ValueError(f"a network of scale {network.scale} cannot give {factor}")
    spark: SparkSession = px.sparkSession
    shared, s = spark.sparkContext.broadcast(network), network.scale

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf.own.any():
            return pd.DataFrame({c: [] for c in ("image_id", "y", "x", "r", "g", "b")})
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        y, x = (pdf.y - y0).to_numpy(), (pdf.x - x0).to_numpy()
        picture = np.zeros((3, y.max() + 1, x.max() + 1))
        picture[:, y, x] = pdf[["r", "g", "b"]].to_numpy().T / float(top)
        net = shared.value
        done = infer(net, picture, net.reach, s)
        levels = np.floor(np.clip(done * top + 0.5, 0, top)).astype(np.int32)
        own = pdf.own.to_numpy()
        dy, dx = np.divmod(np.arange(s * s), s)
        rows, columns = (y[own][:, None] * s + dy).ravel(), (x[own][:, None] * s + dx).ravel()
        r, g, b = levels[:, rows, columns]
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "y": rows + y0 * s, "x": columns + x0 * s, "r": r, "g": g, "b": b})

    tiles = with_halo(px.select("image_id", "y", "x", "r", "g", "b"), tile, network.reach)
    return tiles.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id long, y int, x int, r int, g int, b int")


def register(name: str, network: Network, tile: int = 256) -> None:
    """The network as an upscaler of the plan builder."""
    from photonframe.plans.pipeline import register_upscaler

    register_upscaler(name, partial(_by_name, network=network, tile=tile))


def _by_name(px: DataFrame, factor: int, network: Network, tile: int) -> DataFrame:
    return upscale(px, factor, network, tile)


def seeded(features: int, layers: int, scale: int, size: float = 0.1) -> Network:
    """A small network from a rule, for tests and trials: waves of a rising phase."""
    sides = [3, *[features] * layers, 3 * scale**2]
    wave = lambda n, k: size * np.sin(1.7 * np.arange(1, n + 1) + k)
    weights = tuple(wave(o * i * 9, k).reshape(o, i, 3, 3) for k, (i, o) in enumerate(zip(sides, sides[1:], strict=False)))
    return Network(weights, tuple(wave(o, 10 + k) for k, o in enumerate(sides[1:])), tuple(0.1 + 0.05 * np.cos(np.arange(o)) for o in sides[1:-1]), scale)
