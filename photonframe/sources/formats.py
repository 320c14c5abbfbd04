"""Byte formats in binary columns: recognition, PNG, gain-map metadata.

Recognition and metadata are Column functions. PNG is parsed and written in Arrow batches,
a picture at a time; a bad file gives a row with an error, it never fails the job. Formats
without a public decoder here (WebP, AVIF, EXR) are recognised and reported, not decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of a folder: path, modificationTime, length, content (read only if used)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def _number(content: Column, at: Column, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes from place ``at`` (from 0); null beyond the end."""
    part = F.substring(content, at + 1, F.lit(size))
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.when(F.octet_length(part) == size, F.conv(digits, 16, 10).cast("long"))


MOST_BLOCKS = 4096  # blocks of a file's head that recognition goes through


def _walk(content: Column, start: int, block) -> Column:  # type: ignore[no-untyped-def]
    """Folds over the blocks of a file's head: ``block`` gives (next place, found, is last).
    struct (at, found): found is the first value that is not null. Places, not bytes, are
    carried, so the payload is never searched."""
    begin = F.struct(F.lit(start).cast("long").alias("at"), F.lit(None).cast("string").alias("found"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        following, found, last = block(state["at"])
        new = F.struct(following.alias("at"), F.coalesce(state["found"], found).alias("found"), (last | following.isNull()).alias("done"))
        return F.when(state["done"], state).otherwise(new)

    steps = F.least(F.octet_length(content) / 4, F.lit(MOST_BLOCKS)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), begin, step)


def _png_head(content: Column) -> Column:
    """The walk over PNG chunks up to the samples; found: "hdr" at a cICP chunk."""

    def block(at: Column) -> tuple[Column, Column, Column]:
        kind = F.substring(content, at + 5, F.lit(4))
        return at + 12 + _number(content, at, 4), F.when(kind == F.lit(b"cICP"), "hdr"), kind.isin(F.lit(b"IDAT"), F.lit(b"IEND"))

    return _walk(content, 8, block)


def _jpeg_head(content: Column, mark: bytes) -> Column:
    """The walk over JPEG segments up to the scan; found: "mark" in an application segment,
    or a frame's place in decimal digits otherwise."""

    def block(at: Column) -> tuple[Column, Column, Column]:
        marker, length = _number(content, at, 2), _number(content, at + 2, 2)
        segment = F.substring(content, at + 5, length.cast("int") - 2)
        frame = marker.between(0xFFC0, 0xFFCF) & ~marker.isin(0xFFC4, 0xFFC8, 0xFFCC)
        if mark:
            found = F.when((marker == 0xFFE1) & F.contains(segment, F.lit(mark)), "mark")
        else:
            found = F.when(frame, at.cast("string"))
        return at + 2 + length, found, ~marker.between(0xFFC0, 0xFFFE) | (marker == 0xFFDA) | (marker == 0xFFD9)

    return _walk(content, 2, block)


def sniff(content: Column) -> Column:
    """Format by content: png, png-hdr, jpeg, gain-map, avif, exr, rgbe, webp, tiff, bmp, gif
    or unknown. What follows the head is told by walking its blocks, not by searching."""
    starts = lambda *b: F.substring(content, 1, len(b[0])).isin(*(F.lit(x) for x in b))
    at = lambda n, b: F.substring(content, n + 1, len(b)) == F.lit(b)
    return (
        F.when(starts(SIGNATURE), F.when(_png_head(content)["found"] == "hdr", "png-hdr").otherwise("png"))
        .when(starts(b"\xff\xd8\xff"), F.when(_jpeg_head(content, b"hdrgm:")["found"] == "mark", "gain-map").otherwise("jpeg"))
        .when(at(4, b"ftypavif") | at(4, b"ftypavis"), "avif").when(starts(b"\x76\x2f\x31\x01"), "exr")
        .when(starts(b"#?RADIANCE") | starts(b"#?RGBE"), "rgbe").when(starts(b"RIFF") & at(8, b"WEBP"), "webp")
        .when(starts(b"II*\0", b"MM\0*"), "tiff").when(starts(b"BM"), "bmp").when(starts(b"GIF8"), "gif").otherwise("unknown")
    )


def probe(content: Column) -> Column:
    """struct (format, width, height) from the head alone; sizes of PNG, JPEG, GIF, BMP and
    WebP (extended, lossless or lossy), null where the head is cut off or of another format."""
    kind = sniff(content)
    frame = _jpeg_head(content, b"")["found"].cast("long")
    lossless = _number(content, F.lit(21), 4, little=True)
    sub = F.substring(content, 13, 4)
    n = lambda at, size, little=False: _number(content, F.lit(at), size, little)
    webp = {
        b"VP8X": (n(24, 3, True) + 1, n(27, 3, True) + 1),
        b"VP8L": (lossless.bitwiseAND(0x3FFF) + 1, F.shiftright(lossless, 14).bitwiseAND(0x3FFF) + 1),
        b"VP8 ": (n(26, 2, True).bitwiseAND(0x3FFF), n(28, 2, True).bitwiseAND(0x3FFF)),
    }
    sides = []
    for i in (0, 1):
        size = F.when(kind.isin("png", "png-hdr"), n(16 + 4 * i, 4)).when(kind == "gif", n(6 + 2 * i, 2, True)).when(kind == "bmp", n(18 + 4 * i, 4, True))
        size = size.when(kind.isin("jpeg", "gain-map"), _number(content, frame + 7 - 2 * i, 2))
        for name, pair in webp.items():
            size = size.when((kind == "webp") & (sub == F.lit(name)), pair[i])
        sides.append(size)
    return F.struct(kind.alias("format"), sides[0].alias("width"), sides[1].alias("height"))


def preview_fits(pixels: Column, memory: float) -> Column:
    """Whether a preview, eight bytes a pixel, takes at most half of the memory."""
    return pixels * 8 <= memory / 2


def is_hdr_source(kind: Column, gain_maps: bool, transfer: Column | None = None) -> Column:
    """HDR by format; a JPEG with a gain map counts only on request, and AVIF only where its
    colour box says PQ or HLG (``transfer``, as ``blocks.colour_codes`` finds it)."""
    code = F.lit(None).cast("int") if transfer is None else transfer
    return kind.isin("png-hdr", "exr", "rgbe") | ((kind == "avif") & F.coalesce(code.isin(16, 18), F.lit(False))) | ((kind == "gain-map") & F.lit(gain_maps))


def png_chunks(data: bytes) -> list[tuple[str, bytes, bool]]:
    """(kind, body, checksum is right) of each chunk; stops at a cut-off one."""
    out, at = [], 8
    while data.startswith(SIGNATURE) and at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            break
        body = data[at + 8 : at + 8 + n]
        out.append((kind.decode("latin-1"), body, zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + n)[0]))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # colour type to channels


def unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG with their filters undone."""
    if len(raw) != height * (stride + 1):
        raise ValueError(f"{len(raw)} bytes of rows, {height * (stride + 1)} expected")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    kinds = rows[:, 0]
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"filter {kinds.max()}")
    width = stride // step
    lines = rows[:, 1:].reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)  # a border of zeros above and to the left
    for d in range(height + width - 1):  # a pixel needs those of the two diagonals before its own
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        best = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        out[y + 1, x + 1] = (lines[y, x] + np.choose(kinds[y][:, None], [np.zeros_like(a), a, b, (a + b) // 2, best])) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, stride)


def _levels(rows: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, one to a byte."""
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, :width]


def _with_alpha(samples: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One colour of the picture is transparent."""
    top = np.iinfo(samples.dtype).max
    alpha = np.where((samples == key).all(axis=2), 0, top).astype(samples.dtype)
    return np.concatenate([samples, alpha[:, :, None]], axis=2)


def read_png(data: bytes) -> tuple[np.ndarray, dict[str, bytes]]:
    """(height, width, channels) samples of 8 or 16 bits, and the other chunks. Fewer bits are
    stretched to 8, palettes become colours, with alpha where they or a colour key have it."""
    chunks = png_chunks(data)
    if not chunks or chunks[0][0] != "IHDR" or not all(ok for _, _, ok in chunks) or chunks[-1][0] != "IEND":
        raise ValueError("not a whole PNG")
    width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    small = depth in (1, 2, 4) and kind in (0, 3)
    if not (small or depth == 8 or (depth == 16 and kind != 3)) or kind not in (*CHANNELS, 3) or interlace:
        raise ValueError(f"PNG of depth {depth}, type {kind}, interlace {interlace} is not supported")
    bits = CHANNELS.get(kind, 1) * depth
    rows = unfilter(zlib.decompress(b"".join(b for k, b, _ in chunks if k == "IDAT")), height, -(-width * bits // 8), max(1, bits // 8))
    extra = {k: b for k, b, _ in chunks if k not in ("IHDR", "IDAT", "IEND")}
    if small:
        samples = _levels(rows, width, depth)[:, :, None]
    else:
        samples = rows.reshape(height, width, -1) if depth == 8 else rows.view(">u2").reshape(height, width, -1).astype(np.uint16)
    clear = extra.get("tRNS")
    if kind == 3:
        palette = np.frombuffer(extra.get("PLTE", b""), np.uint8).reshape(-1, 3)
        if samples.size and samples.max() >= len(palette):
            raise ValueError("a colour is not in the palette")
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear[: len(palette)], np.uint8)
            palette = np.column_stack([palette, alpha])
        return palette[samples[:, :, 0]], extra
    if clear is not None and kind in (0, 2):
        samples = _with_alpha(samples, np.frombuffer(clear, ">u2").astype(samples.dtype))
    if small:
        samples[:, :, 0] *= 255 // ((1 << depth) - 1)
    return samples, extra


def write_png(samples: np.ndarray, extra: dict[str, bytes] | None = None, level: int = 6) -> bytes:
    """PNG of (height, width, 1 to 4) samples of 8 or 16 bits, Paeth-filtered; ``extra``
    chunks (cICP, cLLi, pHYs, eXIf) before the samples."""
    height, width, channels = samples.shape
    depth = samples.dtype.itemsize * 8
    rows = (samples if depth == 8 else samples.astype(">u2")).reshape(height, -1).view(np.uint8).astype(np.int16)
    step = channels * depth // 8
    left, up = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]], np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(rows, ((1, 0), (step, 0)))[:-1, : rows.shape[1]]
    pa_, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    best = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
    body = np.concatenate([np.full((height, 1), 4, np.uint8), ((rows - best) & 255).astype(np.uint8)], axis=1).tobytes()
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    kind = {c: k for k, c in CHANNELS.items()}[channels]
    out = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0))]
    out += [chunk(k.encode(), b) for k, b in (extra or {}).items()]
    return b"".join([*out, chunk(b"IDAT", zlib.compress(body, level)), chunk(b"IEND", b"")])


def decode_png(files: DataFrame, id_col: str = "image_id", content: str = "content") -> DataFrame:
    """(image_id, height, width, channels, depth, data, cicp, error): samples as little-endian
    bytes; pictures that cannot be read have an error and no data."""
    names = ["image_id", "height", "width", "channels", "depth", "data", "cicp", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    s, extra = read_png(data.as_py() or b"")
                    rows.append((key, *s.shape, s.dtype.itemsize * 8, s.astype(s.dtype.newbyteorder("<")).tobytes(), extra.get("cICP"), None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((key, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, [pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary(), pa.string()], strict=True)], names=names)

    return files.select(F.col(id_col).cast("long").alias("image_id"), content).mapInArrow(run, "image_id long, height int, width int, channels int, depth int, data binary, cicp binary, error string")


def explode_pixels(pictures: DataFrame) -> DataFrame:
    """Pixel rows (image_id, y, x, r, g, b) of decoded pictures, grey repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h, w, c, depth, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                s = np.frombuffer(data, "<u2" if depth == 16 else np.uint8).reshape(h, w, c).astype(np.int32)
                rgb = s[..., :3] if c >= 3 else np.repeat(s[..., :1], 3, axis=2)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, key)), pa.array(y), pa.array(x), *(pa.array(rgb[..., k].ravel()) for k in range(3))], names=["image_id", "y", "x", "r", "g", "b"])

    return pictures.where("data is not null").select("image_id", "height", "width", "channels", "depth", "data").mapInArrow(run, "image_id long, y int, x int, r int, g int, b int")


# Fields of gain-map metadata and their defaults.
GAIN_FIELDS = {"GainMapMin": 0.0, "GainMapMax": 1.0, "Gamma": 1.0, "OffsetSDR": 1 / 64, "OffsetHDR": 1 / 64, "HDRCapacityMin": 0.0, "HDRCapacityMax": 1.0}


def gain_map_metadata(xmp: Column) -> Column:
    """Struct of arrays (one or three values) from XMP attributes or elements; null where a
    required field is missing or a value is implausible."""

    def field(name: str) -> Column:
        attribute = F.regexp_extract(xmp, f'hdrgm:{name}="([^"]*)"', 1)
        element = F.regexp_extract(xmp, f"(?s)<hdrgm:{name}>(.*?)</hdrgm:{name}>", 1)
        items = F.regexp_extract_all(element, F.lit(r"<rdf:li>([^<]*)</rdf:li>"), F.lit(1))
        texts = F.when(attribute != "", F.array(attribute)).when(F.size(items) > 0, items).when(element != "", F.array(F.trim(element)))
        return F.coalesce(F.transform(texts, lambda t: t.try_cast("double")), F.array(F.lit(GAIN_FIELDS[name])))

    meta = F.struct(*(field(n).alias(n) for n in GAIN_FIELDS))
    present = (F.instr(xmp, "hdrgm:GainMapMax") > 0) & (F.instr(xmp, "hdrgm:HDRCapacityMax") > 0)
    fine = F.forall(F.flatten(F.array(*(meta[n] for n in GAIN_FIELDS))), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e9))
    sane = F.forall(meta["Gamma"], lambda v: v > 0) & F.forall(F.concat(meta["GainMapMin"], meta["GainMapMax"]), lambda v: F.abs(v) <= 32)
    at = lambda a, k: F.coalesce(F.get(a, F.lit(k)), F.get(a, F.lit(0)))
    ordered = at(meta["GainMapMax"], 0) >= at(meta["GainMapMin"], 0)
    for k in (1, 2):
        ordered = ordered & (at(meta["GainMapMax"], k) >= at(meta["GainMapMin"], k))
    return F.when(present & F.coalesce(fine & sane & ordered, F.lit(False)), meta)
