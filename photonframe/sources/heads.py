"""What picture files say of themselves before their samples, read by ranges.

A head is walked block by block through ``Ranged``, which fetches pages of a few kilobytes and
remembers them, so a file costs what its head takes, wherever its blocks lie."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

PAGE = 4096
# The transfer codes of PQ and HLG.
HDR_TRANSFER = (16, 18)


class CutOff(ValueError):
    """A file ends before what its head announces."""


class Ranged:
    """Bytes of a file by place. ``fetch`` (place, length) reads them; pages are fetched once
    and counted in ``read``."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int) -> None:
        self.fetch, self.size, self.read = fetch, size, 0
        self.pages: dict[int, bytes] = {}

    def _page(self, k: int) -> bytes:
        if k not in self.pages:
            if len(self.pages) >= 64:  # what has been walked past is not needed again
                self.pages.pop(next(iter(self.pages)))
            self.pages[k] = self.fetch(k * PAGE, min(PAGE, self.size - k * PAGE))
            self.read += len(self.pages[k])
        return self.pages[k]

    def at(self, place: int, n: int) -> bytes:
        if place < 0 or place + n > self.size:
            raise CutOff(f"{n} bytes at {place} of {self.size}")
        if n > PAGE:  # long bodies are not kept
            self.read += n
            return self.fetch(place, n)
        first, last = place // PAGE, (place + n - 1) // PAGE
        both = b"".join(self._page(k) for k in range(first, last + 1))
        return both[place - first * PAGE :][:n]

    def number(self, place: int, n: int, order: str = "big", signed: bool = False) -> int:
        return int.from_bytes(self.at(place, n), order, signed=signed)  # type: ignore[arg-type]


@dataclass
class Head:
    """Sides as stored; ``orientation`` is the EXIF one (1 where there is none)."""

    format: str
    width: int | None = None
    height: int | None = None
    depth: int | None = None
    channels: int | None = None
    hdr: bool = False
    orientation: int = 1

    def upright(self) -> tuple[int | None, int | None]:
        """(width, height) as seen."""
        return (self.height, self.width) if self.orientation >= 5 else (self.width, self.height)


def _directory(r: Ranged, base: int) -> dict[int, int]:
    """First values of the tags of a TIFF structure's first directory: its short and long ones."""
    order = {b"II": "little", b"MM": "big"}.get(r.at(base, 2))
    if order is None:
        return {}
    start = base + r.number(base + 4, 4, order)
    out = {}
    for k in range(r.number(start, 2, order)):
        entry = start + 2 + 12 * k
        tag, kind, n = r.number(entry, 2, order), r.number(entry + 2, 2, order), r.number(entry + 4, 4, order)
        size = {3: 2, 4: 4}.get(kind)
        if size:
            place = entry + 8 if size * n <= 4 else base + r.number(entry + 8, 4, order)
            out[tag] = r.number(place, size, order)
    return out


def _orientation(r: Ranged, base: int) -> int:
    try:
        value = _directory(r, base).get(274, 1)
    except CutOff:
        return 1
    return value if 1 <= value <= 8 else 1


def png_chunks(r: Ranged) -> Iterator[tuple[bytes, int, int]]:
    """(kind, place of the body, its length) of each chunk."""
    at = 8
    while at + 12 <= r.size:
        n = r.number(at, 4)
        yield r.at(at + 4, 4), at + 8, n
        at += 12 + n


def _png(r: Ranged) -> Head:
    width, height, depth, kind = struct.unpack(">IIBB", r.at(16, 10))
    head = Head("png", width, height, depth, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind))
    for name, place, n in png_chunks(r):
        if name in (b"IDAT", b"IEND"):
            break
        if name == b"cICP" and n >= 2:
            head.hdr = r.at(place + 1, 1)[0] in HDR_TRANSFER
        elif name == b"eXIf" and n > 8:
            head.orientation = _orientation(r, place)
    return head


def _jpeg(r: Ranged) -> Head:
    head, at = Head("jpeg"), 2
    while True:
        mark = r.at(at, 2)
        if mark[0] != 0xFF:
            raise ValueError("a segment is missing")
        if mark[1] == 0xFF:  # a fill byte
            at += 1
            continue
        if mark[1] in (0xD9, 0xDA):
            return head
        n = r.number(at + 2, 2)
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            head.depth, head.height, head.width, head.channels = struct.unpack(">BHHB", r.at(at + 4, 6))
        elif mark[1] == 0xE1 and n > 14 and r.at(at + 4, 6) == b"Exif\0\0":
            head.orientation = _orientation(r, at + 10)
        elif mark[1] == 0xE1 and n > 40 and r.at(at + 4, 28) == b"http://ns.adobe.com/xap/1.0/" and b"hdrgm:" in r.at(at + 4, n - 2):
            head.format = "gain-map"
        at += 2 + n


def _webp(r: Ranged) -> Head:
    kind = r.at(12, 4)
    if kind == b"VP8X":
        return Head("webp", r.number(24, 3, "little") + 1, r.number(27, 3, "little") + 1, 8, 4 if r.at(20, 1)[0] & 16 else 3)
    if kind == b"VP8L":
        bits = r.number(21, 4, "little")
        return Head("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 8, 4 if bits >> 28 & 1 else 3)
    return Head("webp", r.number(26, 2, "little") & 0x3FFF, r.number(28, 2, "little") & 0x3FFF, 8, 3)


def _tiff(r: Ranged) -> Head:
    tags = _directory(r, 0)
    return Head("tiff", tags.get(256), tags.get(257), tags.get(258, 1), tags.get(277, 1), orientation=tags.get(274, 1) if 1 <= tags.get(274, 1) <= 8 else 1)


def exr_attributes(r: Ranged) -> Iterator[tuple[str, int, int]]:
    """(name, place of the value, its length) of the header's attributes."""

    def text(at: int) -> tuple[bytes, int]:
        out = b""
        while (b := r.at(at, 1)) != b"\0":
            out, at = out + b, at + 1
            if len(out) > 255:
                raise ValueError("a name is too long")
        return out, at + 1

    at = 8
    while True:
        name, at = text(at)
        if not name:
            return
        _, at = text(at)
        n = r.number(at, 4, "little")
        yield name.decode("latin-1"), at + 4, n
        at += 4 + n


def _exr(r: Ranged) -> Head:
    head = Head("exr", hdr=True)
    for name, place, n in exr_attributes(r):
        if name == "dataWindow":
            x0, y0, x1, y1 = struct.unpack("<4i", r.at(place, 16))
            head.width, head.height = x1 - x0 + 1, y1 - y0 + 1
        elif name == "channels":
            listed, at = 0, place
            while r.at(at, 1) != b"\0":
                while r.at(at, 1) != b"\0":
                    at += 1
                head.depth = {0: 32, 1: 16, 2: 32}.get(r.number(at + 1, 4, "little"))
                listed, at = listed + 1, at + 17
            head.channels = listed
    return head


def rgbe_start(r: Ranged) -> tuple[int, int, int]:
    """(place of the samples, height, width) of a Radiance picture of the usual orientation."""
    at, line = 0, b""
    blank = False
    while True:
        b = r.at(at, 1)
        at += 1
        if b != b"\n":
            line += b
            if len(line) > 1 << 16:
                raise ValueError("a line of the head is too long")
            continue
        if blank:
            parts = line.split()
            if len(parts) != 4 or parts[0] != b"-Y" or parts[2] != b"+X":
                raise ValueError(f"resolution {line[:40]!r} is not supported")
            return at, int(parts[1]), int(parts[3])
        blank, line = line == b"", b""


def _rgbe(r: Ranged) -> Head:
    _, height, width = rgbe_start(r)
    return Head("rgbe", width, height, 32, 3, True)


def iso_boxes(r: Ranged, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, place of the body, place of its end) of the boxes between two places."""
    at = start
    while at + 8 <= end:
        n, head = r.number(at, 4), 8
        if n == 1:
            n, head = r.number(at + 8, 8), 16
        elif n == 0:
            n = end - at
        if n < head:
            raise ValueError("a box is shorter than its head")
        yield r.at(at + 4, 4), at + head, min(at + n, end)
        at += n


def _avif(r: Ranged) -> Head:
    """Sides, depth and colour of the primary item, by its properties."""
    head = Head("avif", depth=8, channels=3)
    meta = next(((a, b) for kind, a, b in iso_boxes(r, 0, r.size) if kind == b"meta"), None)
    if meta is None:
        return head
    primary, properties, owned = None, [], []
    for kind, a, b in iso_boxes(r, meta[0] + 4, meta[1]):
        if kind == b"pitm":
            primary = r.number(a + 4, 2 if r.at(a, 1)[0] == 0 else 4)
        elif kind == b"iprp":
            for inner, c, d in iso_boxes(r, a, b):
                if inner == b"ipco":
                    properties = list(iso_boxes(r, c, d))
                elif inner == b"ipma":
                    version, flags = r.at(c, 1)[0], r.number(c + 1, 3)
                    at, wide, long = c + 8, 2 if version == 0 else 4, 2 if flags & 1 else 1
                    for _ in range(r.number(c + 4, 4)):
                        item, n = r.number(at, wide), r.at(at + wide, 1)[0]
                        found = [r.number(at + wide + 1 + long * k, long) & (0x7FFF if long == 2 else 0x7F) for k in range(n)]
                        owned.append((item, found))
                        at += wide + 1 + long * n
    mine = next((found for item, found in owned if item == primary), None)
    own = [properties[k - 1] for k in mine if 0 < k <= len(properties)] if mine else properties
    for kind, a, b in own:
        if kind == b"ispe":
            head.width, head.height = r.number(a + 4, 4), r.number(a + 8, 4)
        elif kind == b"pixi":
            head.channels, head.depth = r.at(a + 4, 1)[0], r.at(a + 5, 1)[0]
        elif kind == b"colr" and b - a >= 11 and r.at(a, 4) == b"nclx":
            head.hdr = r.number(a + 6, 2) in HDR_TRANSFER
        elif kind == b"irot" and r.at(a, 1)[0] & 1:
            head.orientation = 6 if r.at(a, 1)[0] & 3 == 3 else 8
    return head


def head_of(r: Ranged) -> Head:
    """The head of a file, told by its first bytes; ``unknown`` where no format fits. Raises
    ValueError where the head is damaged or cut off."""
    first = r.at(0, min(r.size, 16))
    if first.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(r)
    if first.startswith(b"\xff\xd8\xff"):
        return _jpeg(r)
    if first[4:12] in (b"ftypavif", b"ftypavis"):
        return _avif(r)
    if first.startswith(b"\x76\x2f\x31\x01"):
        return _exr(r)
    if first.startswith((b"#?RADIANCE", b"#?RGBE")):
        return _rgbe(r)
    if first.startswith(b"RIFF") and first[8:12] == b"WEBP":
        return _webp(r)
    if first.startswith((b"II*\0", b"MM\0*")):
        return _tiff(r)
    if first.startswith(b"BM"):
        return Head("bmp", r.number(18, 4, "little", True), abs(r.number(22, 4, "little", True)), min(8, r.number(28, 2, "little")), 4 if r.number(28, 2, "little") == 32 else 3)
    if first.startswith(b"GIF8"):
        return Head("gif", r.number(6, 2, "little"), r.number(8, 2, "little"), 8, 1)
    return Head("unknown")
