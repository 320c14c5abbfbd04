"""OpenEXR pictures of scan lines: plain, run lengths, and zlib over a predictor."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from photonframe.sources.heads import Ranged, exr_attributes

# Lines to a block by compression (none, RLE, ZIP by line, ZIP by 16 lines), sample types.
LINES = {0: 1, 1: 1, 2: 1, 3: 16}
TYPES = {0: np.dtype("<u4"), 1: np.dtype("<f2"), 2: np.dtype("<f4")}


def _channels(r: Ranged, at: int) -> list[tuple[str, np.dtype]]:
    out = []
    while r.at(at, 1) != b"\0":
        name = b""
        while (c := r.at(at, 1)) != b"\0":
            name, at = name + c, at + 1
        kind, across, down = r.number(at + 1, 4, "little"), r.number(at + 9, 4, "little"), r.number(at + 13, 4, "little")
        if kind not in TYPES or (across, down) != (1, 1):
            raise ValueError(f"channel {name.decode('latin-1')} of type {kind}, sampled {across} x {down}, is not supported")
        out.append((name.decode("latin-1"), TYPES[kind]))
        at += 17
    return out


def _run_lengths(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at] - 256 if data[at] > 127 else data[at]
        if n < 0:  # so many bytes as they are
            out += data[at + 1 : at + 1 - n]
            at += 1 - n
        else:
            out += data[at + 1 : at + 2] * (n + 1)
            at += 2
    return bytes(out)


def _restored(packed: bytes) -> bytes:
    """Differences added up, then the two halves interleaved: even and odd bytes."""
    d = np.frombuffer(packed, np.uint8).astype(np.int64)
    d[1:] -= 128
    flat = (np.cumsum(d) & 255).astype(np.uint8)
    out = np.empty_like(flat)
    half = (len(flat) + 1) // 2
    out[0::2], out[1::2] = flat[:half], flat[half:]
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) 32-bit floats of R, G and B, or of Y three times; other channels are
    passed over."""
    r = Ranged(lambda at, n: data[at : at + n], len(data))
    flags = r.number(4, 4, "little")
    if not data.startswith(b"\x76\x2f\x31\x01") or flags & 0x1A00:
        raise ValueError("tiled, deep and multi-part OpenEXR is not supported" if flags & 0x1A00 else "no OpenEXR")
    window, method, channels, at = None, None, [], 8
    for name, place, n in exr_attributes(r):
        if name == "dataWindow":
            window = struct.unpack("<4i", r.at(place, 16))
        elif name == "compression":
            method = r.at(place, 1)[0]
        elif name == "channels":
            channels = _channels(r, place)
        at = place + n
    at += 1  # the end of the header
    if window is None or method not in LINES or not channels:
        raise ValueError(f"OpenEXR compression {method} is not supported")
    x0, y0, x1, y1 = window
    width, height, lines = x1 - x0 + 1, y1 - y0 + 1, LINES[method]
    if width <= 0 or height <= 0 or width * height > 1_000_000_000:
        raise ValueError(f"{width} x {height} pixels")
    names = [n for n, _ in channels]
    wanted = ["R", "G", "B"] if {"R", "G", "B"} <= set(names) else ["Y"] * 3 if "Y" in names else []
    if not wanted:
        raise ValueError(f"channels {names} give no picture")
    row = sum(t.itemsize for _, t in channels) * width
    starts, place = {}, 0
    for name, kind in channels:
        starts[name] = (place, kind)
        place += kind.itemsize * width
    out = np.zeros((height, width, 3), np.float32)
    for k in range(-(-height // lines)):
        block = r.number(at + 8 * k, 8, "little")
        y, n = struct.unpack("<ii", r.at(block, 8))
        top = y - y0
        if not 0 <= top < height or n < 0:
            raise ValueError("a block lies outside")
        count = min(lines, height - top)
        raw = r.at(block + 8, n)
        if n < count * row:
            raw = _restored(_run_lengths(raw, count * row) if method == 1 else zlib.decompress(raw))
        if len(raw) != count * row:
            raise ValueError("a block is cut off")
        for i in range(count):
            for c, name in enumerate(wanted):
                start, kind = starts[name]
                out[top + i, :, c] = np.frombuffer(raw, kind, width, i * row + start)
    return out
