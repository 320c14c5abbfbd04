"""Baseline JPEG: decoding, also at a half, a quarter and an eighth of the size, and encoding.

Only the chain of codes is walked one by one, as each begins where the one before ends; what a
code stands for is looked up for 16 bits at once. Values, predictions, dequantisation, the
cosine transform and colour are arrays over all blocks of a picture. Progressive and
arithmetic files, 12 bits and four channels raise ValueError."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

# Quantisers of quality 50 for brightness and for colour, in rows.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *(99,) * 32,
)
#: Places of a block in the order of its codes: diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
MOST_PIXELS = 1_000_000_000


def cosines(n: int) -> np.ndarray:
    """The orthonormal cosine transform of n samples, one frequency to a row."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos((2 * x + 1) * k * np.pi / (2 * n))


@dataclass
class Part:
    """A component: sampling factors, tables, and its coefficients by block, natural order."""

    name: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64)))


def codes_of(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) in order, for so many codes of each length from 1."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _table(counts: list[int], symbols: bytes) -> list[int]:
    """For every 16 bits: length << 8 | symbol of the code they begin with, 0 if none."""
    out = np.zeros(1 << 16, np.int64)
    for (code, length), s in zip(codes_of(counts), symbols, strict=True):
        if code >> length:
            raise ValueError("too many codes of a length")
        out[code << 16 - length : (code + 1) << 16 - length] = length << 8 | s
    return out.tolist()


def _walk(data: bytes, plan: list[tuple[list[int], list[int]]], units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block, place in the block, first bit and number of bits of each value of an interval."""
    d, at = data + b"\0" * 8, 0
    block, place, first, size = [], [], [], []
    b = 0
    for _ in range(units):
        for dc, ac in plan:
            i = at >> 3
            v = dc[(d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> 8 - (at & 7) & 0xFFFF]
            if not v or i > len(data):
                raise ValueError("the scan is damaged")
            at += v >> 8
            if n := v & 255:
                block.append(b)
                place.append(0)
                first.append(at)
                size.append(n)
                at += n
            k = 1
            while k < 64:
                i = at >> 3
                if i > len(data):
                    raise ValueError("the scan is cut off")
                v = ac[(d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> 8 - (at & 7) & 0xFFFF]
                if not v:
                    raise ValueError("the scan is damaged")
                at += v >> 8
                n, k = v & 15, k + (v >> 4 & 15)
                if n:
                    if k > 63:
                        raise ValueError("a block is too long")
                    block.append(b)
                    place.append(k)
                    first.append(at)
                    size.append(n)
                    at += n
                elif v & 255 != 0xF0:
                    break
                k += 1
            b += 1
    if at > 8 * len(data):
        raise ValueError("the scan is cut off")
    return tuple(np.array(x, np.int64) for x in (block, place, first, size))  # type: ignore[return-value]


def _values(data: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed numbers at so many bits from these places."""
    d = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.int64)
    i = first >> 3
    window = d[i] << 24 | d[i + 1] << 16 | d[i + 2] << 8 | d[i + 3]
    raw = window >> (32 - (first & 7) - size) & (1 << size) - 1
    return np.where(raw < 1 << size - 1, raw - (1 << size) + 1, raw)


class _File:
    def __init__(self, data: bytes) -> None:
        self.width = self.height = self.interval = 0
        self.parts: list[Part] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], list[int]] = {}
        self.adobe: int | None = None
        at = 2
        while True:
            mark = data[at + 1] if at + 2 <= len(data) and data[at] == 0xFF else 0
            if mark == 0xFF:
                at += 1
                continue
            if mark == 0xD9:
                return
            if not mark or at + 4 > len(data):
                raise ValueError("a segment is missing")
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if n < 2 or len(body) != n - 2:
                raise ValueError("a segment is cut off")
            at += 2 + n
            if mark == 0xDB:
                self._quantisers(body)
            elif mark == 0xC4:
                self._codes(body)
            elif mark in (0xC0, 0xC1):
                self._frame(body)
            elif 0xC2 <= mark <= 0xCF and mark != 0xCC:
                raise ValueError("progressive and lossless JPEG are not supported" if mark != 0xC9 else "arithmetic JPEG is not supported")
            elif mark == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif mark == 0xDA:
                at = self._scan(body, data, at)

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide, k = body[0] >> 4, body[0] & 15
            n = 1 + 64 * (1 + wide)
            if len(body) < n:
                raise ValueError("a quantiser is cut off")
            table = np.zeros(64)
            table[ZIGZAG] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8)
            self.quantisers[k] = table
            body = body[n:]

    def _codes(self, body: bytes) -> None:
        while body:
            counts = list(body[1:17])
            n = 17 + sum(counts)
            if len(body) < n or len(counts) < 16:
                raise ValueError("a table of codes is cut off")
            self.tables[body[0] >> 4, body[0] & 15] = _table(counts, body[17:n])
            body = body[n:]

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3) or len(body) < 6 + 3 * n or not self.width or not self.height:
            raise ValueError(f"JPEG of {depth} bits and {n} components, {self.width} x {self.height}, is not supported")
        if self.width * self.height > MOST_PIXELS:
            raise ValueError(f"{self.width} x {self.height} pixels are too many")
        self.parts = [Part(a, b >> 4, b & 15, q) for a, b, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        if not all(1 <= p.across <= 4 and 1 <= p.down <= 4 for p in self.parts):
            raise ValueError("sampling factors are out of range")
        if n == 1:
            self.parts[0].across = self.parts[0].down = 1
        self.across, self.down = max(p.across for p in self.parts), max(p.down for p in self.parts)
        self.units = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for p in self.parts:
            p.blocks = np.zeros((self.units[1] * p.down, self.units[0] * p.across, 64))

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        """Takes up the coefficients of a scan; the place of the next segment."""
        own = []
        for k in range(body[0] if body else 0):
            name, tables = body[1 + 2 * k], body[2 + 2 * k]
            part = next((p for p in self.parts if p.name == name), None)
            if part is None:
                raise ValueError("a scan of no component")
            part.dc, part.ac = tables >> 4, tables & 15
            own.append(part)
        if not own:
            raise ValueError("a scan of no component")
        pieces, start = [], at
        while True:  # intervals end at restart marks, the scan at any other
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("the scan has no end")
            mark = data[at + 1]
            if mark == 0 or mark == 0xFF:
                at += 2 if mark == 0 else 1
                continue
            pieces.append(data[start:at].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= mark <= 0xD7:
                break
            at = start = at + 2
        # Units and the places of their blocks: one component goes by its own rows of blocks
        if len(own) == 1:
            p = own[0]
            wide, tall = -(-(-(-self.width * p.across // self.across)) // 8), -(-(-(-self.height * p.down // self.down)) // 8)
            shape = [(p, 1, 1)]
        else:
            (wide, tall), shape = self.units, [(p, p.across, p.down) for p in own]
        try:
            plan = [(self.tables[0, p.dc], self.tables[1, p.ac]) for p, h, v in shape for _ in range(h * v)]
        except KeyError as e:
            raise ValueError("a table of codes is missing") from e
        which = np.array([k for k, (_, h, v) in enumerate(shape) for _ in range(h * v)])
        dx = np.array([x for _, h, v in shape for y in range(v) for x in range(h)])
        dy = np.array([y for _, h, v in shape for y in range(v) for x in range(h)])
        every = self.interval or wide * tall
        if len(pieces) < -(-wide * tall // every):
            raise ValueError("intervals are missing")
        for k, start in enumerate(range(0, wide * tall, every)):
            units = min(every, wide * tall - start)
            block, place, first, size = _walk(pieces[k], plan, units)
            value = _values(pieces[k], first, size)
            unit, slot = np.divmod(np.arange(units * len(plan)), len(plan))
            row, column = np.divmod(start + unit, wide)
            for c, (p, h, v) in enumerate(shape):
                mine = which[slot] == c
                y, x = (row * v + dy[slot])[mine], (column * h + dx[slot])[mine]
                number = np.full(len(slot), -1)
                number[mine] = np.arange(len(y))
                here = mine[block]
                own_blocks = np.zeros((len(y), 64))
                own_blocks[number[block[here]], ZIGZAG[place[here]]] = value[here]
                own_blocks[:, 0] = np.cumsum(own_blocks[:, 0])
                p.blocks[y, x] = own_blocks
        return at


def decode(data: bytes, shrink: int = 1) -> np.ndarray:
    """(height, width, 1 or 3) samples of 8 bits; ``shrink`` of 2, 4 or 8 takes only the lowest
    frequencies of each block, and gives sides of so many parts, rounded up."""
    if not data.startswith(b"\xff\xd8") or shrink not in (1, 2, 4, 8):
        raise ValueError("no JPEG" if shrink in (1, 2, 4, 8) else f"no size of 1 / {shrink}")
    f = _File(data)
    if not f.parts:
        raise ValueError("a JPEG without a frame")
    n = 8 // shrink
    basis = cosines(n)
    height, width = -(-f.height // shrink), -(-f.width // shrink)
    planes = []
    for p in f.parts:
        if p.quantiser not in f.quantisers:
            raise ValueError("a quantiser is missing")
        rows, columns, _ = p.blocks.shape
        low = (p.blocks * f.quantisers[p.quantiser]).reshape(rows, columns, 8, 8)[:, :, :n, :n] * (n / 8)
        plane = (basis.T @ low @ basis).transpose(0, 2, 1, 3).reshape(rows * n, columns * n) + 128
        plane = np.clip(np.rint(plane), 0, 255)
        planes.append(plane.repeat(f.down // p.down, axis=0).repeat(f.across // p.across, axis=1)[:height, :width])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[:, :, None]
    y, cb, cr = planes
    if f.adobe == 0 or (f.adobe is None and [p.name for p in f.parts] == [82, 71, 66]):
        return np.stack(planes, axis=2).astype(np.uint8)
    cb, cr = cb - 128, cr - 128
    rgb = (y + 1.402 * cr, y - (0.114 * 1.772 * cb + 0.299 * 1.402 * cr) / 0.587, y + 1.772 * cb)
    return np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255).astype(np.uint8)


# ---- encoding
def quantiser(base: tuple[int, ...], quality: int) -> np.ndarray:
    """A table at a quality of 1 to 100: half as fine at 25 as at 50, all ones at 100."""
    quality = min(100, max(1, quality))
    share = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * share + 50) // 100, 1, 255)


def code_lengths(frequency: dict[int, int], most: int = 16) -> dict[int, int]:
    """Lengths of the best code in which none is longer than ``most`` and none is all ones:
    coins of each length are paired and merged, the cheapest first."""
    items = sorted((n, s) for s, n in frequency.items())
    coins = [(n, (s,)) for n, s in [(0, -1), *items]]  # the cheapest, longest code stays unused
    if len(coins) == 2:
        return {items[0][1]: 1}
    level = list(coins)
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = list(heapq.merge(coins, pairs, key=lambda c: c[0]))
    out: dict[int, int] = {}
    for _, symbols in level[: 2 * (len(coins) - 1)]:
        for s in symbols:
            out[s] = out.get(s, 0) + 1
    out.pop(-1)
    return out


def _bits(code: np.ndarray, length: np.ndarray) -> bytes:
    """Codes one after the other, filled up with ones."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    which = np.repeat(np.arange(len(code)), length)
    place = np.arange(total) - np.repeat(ends - length, length)
    bits = code[which] >> (length[which] - 1 - place) & 1
    return np.packbits(np.concatenate([bits, np.ones(-total % 8, np.int64)]).astype(np.uint8)).tobytes()


def _size_of(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks in code order with differences at their first places: block, symbol, extra
    bits and their number, in the order of the stream; runs of 16 zeros and ends included."""
    order, symbol, extra, size = [], [], [], []

    def put(b: np.ndarray, place: np.ndarray, s: np.ndarray, v: np.ndarray, n: np.ndarray) -> None:
        order.append(b * 256 + place)
        symbol.append(s)
        extra.append(np.where(v < 0, v + (1 << n) - 1, v))
        size.append(n)

    all_ = np.arange(len(blocks))
    dc = blocks[:, 0]
    put(all_, np.zeros_like(all_), _size_of(dc), dc, _size_of(dc))
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    before = np.where(np.append(True, b[1:] != b[:-1])[: len(b)], 0, np.append(0, k[:-1])[: len(k)])
    run = k - before - 1
    v = blocks[b, k]
    put(b, 4 * k + 3, (run & 15) << 4 | _size_of(v), v, _size_of(v))
    for times in (1, 2, 3):  # 16, 32 or 48 zeros before a value
        at = run >> 4 >= times
        put(b[at], 4 * k[at] + times - 1, np.full(at.sum(), 0xF0), np.zeros(at.sum(), np.int64), np.zeros(at.sum(), np.int64))
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, b, k)
    at = all_[last < 63]
    put(at, np.full(len(at), 255), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
    columns = [np.concatenate(x) for x in (order, symbol, extra, size)]
    rank = np.argsort(columns[0], kind="stable")
    return columns[0][rank] // 256, columns[1][rank] | np.where(columns[0][rank] % 256 == 0, 1 << 8, 0), columns[2][rank], columns[3][rank]


def encode(samples: np.ndarray, quality: int = 95, segments: bytes = b"", full_colour: bool | None = None) -> bytes:
    """JPEG of (height, width, 1 or 3) samples of 8 bits. Colour has every pixel from quality 90
    up, or as told; below, every fourth. Codes are the best ones for the picture. ``segments``
    (EXIF, profiles, XMP) stand before the tables, as they are."""
    height, width, channels = samples.shape
    if channels not in (1, 3) or not 0 < height < 65536 or not 0 < width < 65536 or samples.dtype != np.uint8:
        raise ValueError(f"no JPEG of {width} x {height} x {channels} samples")
    step = 1 if channels == 1 or (quality >= 90 if full_colour is None else full_colour) else 2
    side = 8 * step
    padded = np.pad(samples, ((0, -height % side), (0, -width % side), (0, 0)), mode="edge").astype(float)
    planes = [padded[:, :, 0]]
    if channels == 3:
        r, g, b = (padded[:, :, k] for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        small = lambda p: p.reshape(p.shape[0] // step, step, p.shape[1] // step, step).mean(axis=(1, 3))
        planes = [y, small((b - y) / 1.772 + 128), small((r - y) / 1.402 + 128)]
    tables = [quantiser(BRIGHTNESS, quality), quantiser(COLOUR, quality)]
    basis, parts = cosines(8), []
    for k, plane in enumerate(planes):
        rows, columns = plane.shape[0] // 8, plane.shape[1] // 8
        tiles = plane.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3) - 128
        found = np.rint((basis @ tiles @ basis.T).reshape(rows, columns, 64) / tables[min(k, 1)]).astype(np.int64)[:, :, ZIGZAG]
        h = step if k == 0 and channels == 3 else 1  # blocks of a unit to a side
        units = found.reshape(rows // h, h, columns // h, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, h * h, 64)
        flat = units.reshape(-1, 64).copy()
        flat[1:, 0] -= flat[:-1, 0].copy()
        parts.append(flat.reshape(units.shape))
    counts = [p.shape[1] for p in parts]
    blocks = np.concatenate(parts, axis=1).reshape(-1, 64)
    kind = np.tile(np.repeat([0, *[1] * (len(parts) - 1)], counts), len(parts[0]))
    block, symbol, extra, size = _symbols(blocks)
    code, length, told = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    for k in range(min(2, len(parts))):
        for dc in (1, 0):
            mine = (kind[block] == k) & (symbol >> 8 == dc)
            used, n = np.unique(symbol[mine] & 255, return_counts=True)
            lengths = code_lengths(dict(zip(used.tolist(), n.tolist(), strict=True)) or {0: 1})
            ordered = sorted(lengths, key=lambda s: (lengths[s], s))
            per = [sum(1 for v in lengths.values() if v == x) for x in range(1, 17)]
            given = np.zeros((256, 2), np.int64)
            given[ordered] = codes_of(per)
            code[mine], length[mine] = given[symbol[mine] & 255, 0], given[symbol[mine] & 255, 1]
            told += bytes([(1 - dc) << 4 | k]) + bytes(per) + bytes(ordered)
    body = _bits(code << size | extra, length + size).replace(b"\xff", b"\xff\0")
    segment = lambda mark, b: b"\xff" + bytes([mark]) + struct.pack(">H", 2 + len(b)) + b
    ids = range(1, channels + 1)
    out = [b"\xff\xd8", segments or segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xDB, b"".join(bytes([k]) + bytes(tables[k].ravel()[ZIGZAG].tolist()) for k in range(min(2, channels))))]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([i, (step << 4 | step) if i == 1 and channels == 3 else 0x11, min(i - 1, 1)]) for i in ids)))
    out += [segment(0xC4, told), segment(0xDA, bytes([channels]) + b"".join(bytes([i, 0x11 * min(i - 1, 1)]) for i in ids) + b"\0\x3f\0"), body, b"\xff\xd9"]
    return b"".join(out)
