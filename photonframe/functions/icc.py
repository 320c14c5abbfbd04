"""ICC matrix profiles: read on the driver (a profile is a few hundred bytes), evaluated as
Column expressions. Profiles with lookup cubes, CMYK or Lab are refused; callers fall back
to sRGB and say so."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .colour import D65, apply_matrix, rgb_to_xyz
from .pixel import Rgb, clip

D50 = (0.9642, 1.0, 0.8249)  # fixed values: white of the profile connection space
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])  # fixed values
PARAMETERS = (1, 3, 4, 5, 7)  # fixed values: numbers of a parametric curve's parameters by type


class UnsupportedProfile(ValueError):
    """Not a matrix or grey profile."""


@dataclass(frozen=True)
class Curve:
    """Exactly one of: power, table, or parametric (type, parameters)."""

    power: float | None = None
    table: tuple[float, ...] = ()
    kind: int = 0
    parameters: tuple[float, ...] = ()

    def __call__(self, v: Column) -> Column:
        v = clip(v)
        if self.power is not None:
            return F.pow(v, F.lit(self.power))
        if self.table:
            n = len(self.table) - 1
            values = F.array(*map(F.lit, self.table))
            low = F.least(F.floor(v * n), F.lit(n - 1))
            at = lambda i: F.element_at(values, i.cast("int"))
            return at(low + 1) + (v * n - low) * (at(low + 2) - at(low + 1))
        g, *rest = self.parameters
        if not rest:
            return F.pow(v, F.lit(g))
        a, b, c, d, e, f = (*rest, *[0.0] * (6 - len(rest)))
        body = F.pow(F.greatest(a * v + b, F.lit(0.0)), F.lit(g))
        if self.kind in (1, 2):  # constant below -b / a
            return F.when(v >= -b / a, body + c).otherwise(F.lit(c))
        return F.when(v >= d, body + e).otherwise(c * v + f)


@dataclass(frozen=True)
class Profile:
    to_xyz: np.ndarray
    curves: tuple[Curve, Curve, Curve]
    grey: bool = False

    def to_bt2020(self, rgb: Rgb) -> Rgb:
        """Encoded 0..1 channels as linear BT.2020."""
        light = tuple(curve(c) for curve, c in zip(self.curves, rgb, strict=True))
        return apply_matrix(light, np.linalg.inv(rgb_to_xyz("bt2020")) @ self.to_xyz)  # type: ignore[arg-type]


def adaptation(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Bradford adaptation between white points in XYZ."""
    return np.linalg.inv(BRADFORD) @ np.diag((BRADFORD @ target) / (BRADFORD @ source)) @ BRADFORD


def _fixed(data: bytes, at: int, n: int) -> tuple[float, ...]:
    return tuple(v / 65536 for v in struct.unpack_from(f">{n}i", data, at))


def read_curve(tag: bytes) -> Curve:
    kind = tag[:4]
    try:
        if kind == b"curv":
            (n,) = struct.unpack_from(">I", tag, 8)
            values = struct.unpack_from(f">{n}H", tag, 12)
            return Curve(power=1.0) if n == 0 else Curve(power=values[0] / 256) if n == 1 else Curve(table=tuple(v / 65535 for v in values))
        if kind == b"para":
            (f,) = struct.unpack_from(">H", tag, 8)
            return Curve(kind=f, parameters=_fixed(tag, 12, PARAMETERS[f]))
    except (struct.error, IndexError) as e:
        raise UnsupportedProfile(f"damaged curve: {e}") from e
    raise UnsupportedProfile(f"curve {kind!r}")


def read_profile(data: bytes) -> Profile:
    if len(data) < 132:
        raise UnsupportedProfile("cut off")
    (n,) = struct.unpack_from(">I", data, 128)
    tags = {}
    for i in range(min(n, (len(data) - 132) // 12, 200)):
        name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * i)
        if at + size <= len(data):
            tags[name] = data[at : at + size]
    space = data[16:20]
    need = [b"kTRC"] if space == b"GRAY" else [b"rTRC", b"gTRC", b"bTRC", b"rXYZ", b"gXYZ", b"bXYZ"]
    if space not in (b"GRAY", b"RGB ") or any(t not in tags for t in need):
        raise UnsupportedProfile(f"{space!r} without {[t for t in need if t not in tags]}")
    if space == b"GRAY":
        return Profile(rgb_to_xyz("bt709"), (read_curve(tags[b"kTRC"]),) * 3, True)
    primaries = []
    for t in need[3:]:
        if tags[t][:4] != b"XYZ " or len(tags[t]) < 20:
            raise UnsupportedProfile(f"{t!r} is no XYZ value")
        primaries.append(_fixed(tags[t], 8, 3))
    white = np.array([D65[0] / D65[1], 1.0, (1 - sum(D65)) / D65[1]])
    return Profile(adaptation(np.array(D50), white) @ np.array(primaries).T, tuple(read_curve(tags[t]) for t in need[:3]))  # type: ignore[arg-type]
