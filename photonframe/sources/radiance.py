"""Radiance pictures: four bytes a pixel, three mantissas and an exponent that they share."""

from __future__ import annotations

import numpy as np

from photonframe.sources.heads import Ranged, rgbe_start


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) linear 32-bit floats. Rows are plain, or runs of each byte by itself."""
    at, height, width = rgbe_start(Ranged(lambda place, n: data[place : place + n], len(data)))
    rows = np.zeros((height, 4, width), np.uint8)
    for y in range(height):
        head = data[at : at + 4]
        if not (8 <= width < 32768 and head[:2] == b"\2\2" and len(head) == 4 and int.from_bytes(head[2:], "big") == width):
            if at + 4 * width > len(data):
                raise ValueError("the samples are cut off")
            rows[y] = np.frombuffer(data, np.uint8, 4 * width, at).reshape(width, 4).T
            at += 4 * width
            continue
        at += 4
        for plane in rows[y]:
            x = 0
            while x < width:
                if at + 1 >= len(data):
                    raise ValueError("the samples are cut off")
                n, same = (data[at] - 128, True) if data[at] > 128 else (data[at], False)
                taken = 1 if same else n
                if not n or x + n > width or at + 1 + taken > len(data):
                    raise ValueError("a run is too long")
                plane[x : x + n] = data[at + 1] if same else np.frombuffer(data, np.uint8, n, at + 1)
                x, at = x + n, at + 1 + taken
    scale = np.where(rows[:, 3] > 0, np.ldexp(1.0, rows[:, 3].astype(int) - 136), 0.0)
    return (rows[:, :3] * scale[:, None]).transpose(0, 2, 1).astype(np.float32)
