"""JPEG files that carry a gain map: a standard picture, its map, and what says how to use it.

The map is a JPEG of its own behind the picture. The picture's XMP names the map's length, and
its multi-picture index the places of both; the index counts from its own place, and its size
is fixed, so all lengths are known once the map and the XMP are made."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from photonframe.sources import jpeg
from photonframe.sources.formats import GAIN_FIELDS

# Names that such files use.
XMP = b"http://ns.adobe.com/xap/1.0/\0"
SPACES = 'xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/"'
CONTAINER = 'xmlns:Container="http://ns.google.com/photos/1.0/container/" xmlns:Item="http://ns.google.com/photos/1.0/container/item/"'


def _segment(mark: int, body: bytes) -> bytes:
    if len(body) > 65_533:
        raise ValueError(f"{len(body)} bytes do not fit one segment")
    return b"\xff" + bytes([mark]) + struct.pack(">H", 2 + len(body)) + body


def _xmp(inside: str, attributes: str) -> bytes:
    rdf = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
    return _segment(0xE1, XMP + f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {rdf}><rdf:Description rdf:about="" {SPACES} {attributes}{"/>" if not inside else ">" + inside + "</rdf:Description>"}</rdf:RDF></x:xmpmeta>'.encode())


def metadata_xmp(meta: dict[str, float | tuple[float, ...]]) -> bytes:
    """The segment that a map carries: each field once, or a list of three."""
    given = {n: meta.get(n, default) for n, default in GAIN_FIELDS.items()}
    one = " ".join(f'hdrgm:{n}="{v:.9g}"' for n, v in given.items() if not isinstance(v, tuple))
    three = "".join(f"<hdrgm:{n}><rdf:Seq>{''.join(f'<rdf:li>{x:.9g}</rdf:li>' for x in v)}</rdf:Seq></hdrgm:{n}>" for n, v in given.items() if isinstance(v, tuple))
    return _xmp(three, f'hdrgm:Version="1.0" {one} hdrgm:BaseRenditionIsHDR="False"')


def assemble(picture: bytes, gain: bytes, meta: dict[str, float | tuple[float, ...]], exif: bytes = b"") -> bytes:
    """One file of two JPEGs and the metadata of the map; ``exif`` is EXIF without its name."""
    if not (picture.startswith(b"\xff\xd8") and gain.startswith(b"\xff\xd8")):
        raise ValueError("two JPEGs are needed")
    second = gain[:2] + metadata_xmp(meta) + gain[2:]
    items = "".join(f'<rdf:li rdf:parseType="Resource"><Container:Item Item:Semantic="{what}" Item:Mime="image/jpeg"{length}/></rdf:li>' for what, length in (("Primary", ""), ("GainMap", f' Item:Length="{len(second)}"')))
    head = picture[:2] + (_segment(0xE1, b"Exif\0\0" + exif) if exif else b"")
    head += _xmp(f"<Container:Directory><rdf:Seq>{items}</rdf:Seq></Container:Directory>", f'{CONTAINER} hdrgm:Version="1.0"')

    def index(whole: int, offset: int) -> bytes:
        entries = struct.pack(">IIIHH", 0x030000, whole, 0, 0, 0) + struct.pack(">IIIHH", 0, len(second), offset, 0, 0)
        directory = struct.pack(">H", 3) + struct.pack(">HHI4s", 0xB000, 7, 4, b"0100") + struct.pack(">HHII", 0xB001, 4, 1, 2) + struct.pack(">HHII", 0xB002, 7, 32, 8 + 2 + 36 + 4) + b"\0\0\0\0"
        return _segment(0xE2, b"MPF\0MM\0*" + struct.pack(">I", 8) + directory + entries)

    whole = len(head) + len(index(0, 0)) + len(picture) - 2
    base = len(head) + 8  # behind the segment's own head and name
    return head + index(whole, whole - base) + picture[2:] + second


def gain_map_files(rows: DataFrame, quality: int = 95) -> DataFrame:
    """(name, content): files of rows (name, height, width, data, gain_height, gain_width,
    gain_data, gain_min, gain_max, headroom). data: 8-bit colour; gain_data: 8-bit codes of one
    channel; gain_min and gain_max in stops; headroom is the display's, in stops. A picture is
    made in one task, a row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                plane = lambda data, h, w, c: np.frombuffer(data, np.uint8).reshape(h, w, c)
                picture = jpeg.encode(plane(r["data"], r["height"], r["width"], 3), quality)
                gain = jpeg.encode(plane(r["gain_data"], r["gain_height"], r["gain_width"], 1), 100)
                meta = {"GainMapMin": r["gain_min"], "GainMapMax": r["gain_max"], "HDRCapacityMax": max(r["headroom"], 1e-6)}
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([assemble(picture, gain, meta)], pa.binary())], names=["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")
