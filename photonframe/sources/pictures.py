"""Picture files as a Spark data source, ``spark.read.format("pictures")``, and as a verified
sink, ``df.write.format("pictures")``.

Reading. A partition is a run of files, so many small files share a task. ``what`` = "head"
(the default) reads heads by ranges and no samples; "samples" decodes PNG, JPEG, Radiance and
OpenEXR besides (the last two to 32-bit floats). ``shrink`` of 2, 4 or 8 decodes JPEG at that
part of its size. ``region`` = "top,left,height,width" decodes a PNG no further than its last
row, and reads the file no further either. ``where``, a list of tests (column, name, value) as
JSON, leaves files out: by path and length before they are opened, by what a head says before
samples are read. It is an option and no pushed filter, since Spark 4.1 keeps what it has pushed
into a Python source with the DataFrame, where the next query on it would meet it. A file that
cannot be read is a row with an error.

Writing. Rows (name, height, width, channels, depth, data[, cicp, clli, exif, quality]) become
PNG or JPEG files by their names; rows (name, content) files of just these bytes. Each task
writes into a folder of its own below a staging folder, reads every file back and compares it
with the samples, and hands in a list of names. The driver moves the files to their names when
all tasks are done; if anything fails, the staging folder goes and nothing else has changed. A
name that two rows have, and one that exists where ``overwrite`` is not set, fail the write
before any file is moved.

Paths are those of pyarrow's file systems (local and mounted folders, S3, GCS, HDFS)."""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from photonframe.sources import formats, heads, jpeg, openexr, radiance
from photonframe.sources.heads import Ranged

HEAD = [
    ("path", "string"), ("length", "long"), ("modified", "timestamp"), ("format", "string"), ("hdr", "boolean"), ("width", "int"), ("height", "int"),
    ("depth", "int"), ("channels", "int"), ("orientation", "int"), ("bytes_read", "long"), ("error", "string"),
]
SAMPLES = [("top", "int"), ("left", "int"), ("rows", "int"), ("columns", "int"), ("data", "binary"), ("cicp", "binary")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC")}
MOST_PIXELS = 1_000_000_000  # fixed value: pictures beyond are not decoded
LISTED, TOLD = {"path", "length"}, {"format", "hdr", "width", "height", "depth", "channels", "orientation"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else posixpath.abspath(path))


#: Tests that a reader makes by itself, by name; an unknown value passes none.
TESTS: dict[str, Callable] = {
    "=": lambda v, x: v == x, "in": lambda v, x: v in x, ">": lambda v, x: v > x, ">=": lambda v, x: v >= x, "<": lambda v, x: v < x, "<=": lambda v, x: v <= x,
    "startswith": lambda v, x: v.startswith(x), "endswith": lambda v, x: v.endswith(x), "contains": lambda v, x: x in v,
}


def passes(test: tuple[str, str, object], row: dict) -> bool:
    """Whether a row passes a test (column, name, value) as in SQL: an unknown outcome is no pass."""
    column, name, value = test
    return row.get(column) is not None and TESTS[name](row[column], value)


@dataclass
class Run(InputPartition):
    """Files of one task: (path, length, time of change in microseconds)."""

    files: list[tuple[str, int, int]]


def runs_of(files: list[tuple[str, int, int]], most_bytes: int, most_files: int) -> list[Run]:
    """Neighbouring files up to so many bytes or files; a larger file is a run of its own."""
    out: list[Run] = []
    held = 0
    for f in files:
        if not out or held + f[1] > most_bytes or len(out[-1].files) >= most_files:
            out.append(Run([]))
            held = 0
        out[-1].files.append(f)
        held += f[1]
    return out


def read_rows(r: Ranged, top: int, height: int) -> tuple[np.ndarray, int, bytes | None]:
    """Rows of a PNG from the first up to ``top + height``, cut to those asked for; the height
    that there is, and the cICP chunk. Reads the file up to the last row it needs."""
    width, full, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", r.at(16, 13))
    if depth not in (8, 16) or kind not in formats.CHANNELS or interlace:
        raise ValueError(f"PNG of depth {depth}, type {kind}, interlace {interlace} is not supported")
    step = formats.CHANNELS[kind] * depth // 8
    stride, last = width * step, min(full, top + height)
    need, raw, inflate, cicp = last * (stride + 1), bytearray(), zlib.decompressobj(), None
    for name, place, n in heads.png_chunks(r):
        if name == b"cICP":
            cicp = r.at(place, n)
        if name != b"IDAT":
            continue
        for at in range(place, place + n, 1 << 16):
            raw += inflate.decompress(r.at(at, min(1 << 16, place + n - at)), max(0, need - len(raw)))
            if len(raw) >= need:
                break
        if len(raw) >= need:
            break
    if len(raw) < need:
        raise heads.CutOff(f"{len(raw)} bytes of rows, {need} needed")
    rows = formats.unfilter(bytes(raw[:need]), last, stride, step)[top:last]
    samples = rows.reshape(len(rows), width, -1) if depth == 8 else rows.view(">u2").reshape(len(rows), width, -1).astype(np.uint16)
    return samples, full, cicp


class PictureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.samples = options["path"], options.get("what", "head") == "samples"
        self.region = tuple(int(v) for v in options["region"].split(",")) if options.get("region") else None
        self.shrink = int(options.get("shrink", 1))
        self.most_bytes, self.most_files = int(options.get("runbytes", 128 << 20)), int(options.get("runfiles", 4096))
        self.tests = [tuple(t) for t in json.loads(options.get("where", "[]"))]
        for column, name, _ in self.tests:
            if column not in LISTED | TOLD or name not in TESTS:
                raise ValueError(f"a reader has no test {name!r} of {column!r}")

    def _all(self, names: set[str], row: dict) -> bool:
        return all(passes(t, row) for t in self.tests if t[0] in names)

    def partitions(self) -> list[Run]:
        store, path = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        hidden = lambda p: any(x.startswith(("_", ".")) for x in posixpath.relpath(p, path).split("/") if x != ".")
        files = [(i.path, i.size, (i.mtime_ns or 0) // 1000) for i in found if i.type == fs.FileType.File and not hidden(i.path)]
        return runs_of(sorted(f for f in files if self._all(LISTED, {"path": f[0], "length": f[1]})), self.most_bytes if self.samples else 1 << 62, self.most_files) or [Run([])]

    def _row(self, store: fs.FileSystem, path: str, length: int, modified: int) -> dict | None:
        row = {"path": path, "length": length, "modified": modified}
        with store.open_input_file(path) as file:
            r = Ranged(lambda at, n: file.read_at(n, at), length)
            try:
                head = heads.head_of(r)
                row |= {k: getattr(head, k) for k in ("format", "hdr", "width", "height", "depth", "channels", "orientation")}
                if not self._all(TOLD, row):
                    return None
                if self.samples:
                    row |= self._decoded(r, head)
            except (ValueError, zlib.error, struct.error) as e:
                row["error"] = str(e) or type(e).__name__
                if not self._all(TOLD, row):
                    return None
            return row | {"bytes_read": r.read}

    def _decoded(self, r: Ranged, head: heads.Head) -> dict:
        if (head.width or 0) * (head.height or 0) > MOST_PIXELS:
            raise ValueError(f"{head.width} x {head.height} pixels are too many")
        top, left, height, width = self.region or (0, 0, 1 << 31, 1 << 31)
        cicp = None
        if head.format == "png" and self.region is not None:
            samples, _, cicp = read_rows(r, top, height)
        elif head.format == "png":
            samples, extra = formats.read_png(r.at(0, r.size))  # checks every chunk
            cicp = extra.get("cICP")
        elif head.format in ("jpeg", "gain-map"):
            samples = jpeg.decode(r.at(0, r.size), self.shrink)[top : top + height]
        elif head.format in ("rgbe", "exr"):
            samples = (radiance if head.format == "rgbe" else openexr).decode(r.at(0, r.size))[top : top + height]
        else:
            raise ValueError(f"{head.format} is recognised, not decoded")
        part = np.ascontiguousarray(samples[:, left : left + width])
        return {"top": top, "left": left, "rows": part.shape[0], "columns": part.shape[1], "data": part.astype(part.dtype.newbyteorder("<")).tobytes(), "cicp": cicp}

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        columns = HEAD + (SAMPLES if self.samples else [])
        schema = pa.schema([(n, _ARROW[t]) for n, t in columns])
        held: list[dict] = []
        for k, f in enumerate(partition.files):
            row = self._row(store, *f)
            if row is not None:
                held.append(row)
            if held and (self.samples or len(held) >= 1000 or k == len(partition.files) - 1):
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed its files, and how many they are."""

    listed: str
    count: int


class VerificationError(RuntimeError):
    """A file that was read back is not what was written."""


# How far lossy files may be off on average, in levels, and lean to one side.
MOST_ERROR, MOST_BIAS = 8.0, 1.0


def encode(row: dict) -> tuple[bytes, Callable[[bytes], bool]]:
    """A row's file, and whether bytes that were read back are what was written: the very bytes
    of a given content, the very samples of a PNG, nearly those of a JPEG."""
    if row.get("content") is not None:
        content = row["content"]
        return content, lambda back: back == content
    shape = (row["height"], row["width"], row["channels"])
    samples = np.frombuffer(row["data"], "<u2" if row["depth"] == 16 else np.uint8).reshape(shape)
    if row["depth"] == 16:
        samples = samples.astype(np.uint16)
    if row["name"].lower().endswith(".png"):
        extra = {chunk: row[name] for name, chunk in (("cicp", "cICP"), ("clli", "cLLi"), ("exif", "eXIf")) if row.get(name)}

        def same(back: bytes) -> bool:
            found, _ = formats.read_png(back)
            return found.shape == samples.shape and found.dtype == samples.dtype and bool((found == samples).all())

        return formats.write_png(samples, extra), same
    exif = row.get("exif") or b""
    segments = b"\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif if 0 < len(exif) <= 65_527 else b""

    def near(back: bytes) -> bool:
        off = jpeg.decode(back).astype(float) - samples
        return bool(np.abs(off).mean() <= MOST_ERROR and abs(off.mean()) <= MOST_BIAS)

    return jpeg.encode(samples, row.get("quality") or 95, segments), near


class PictureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.store_path, self.overwrite = options["path"], overwrite or options.get("overwrite", "false").lower() == "true"
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def begin(self) -> None:
        """The staging folder, with a mark that stands as long as the job does. When a job fails,
        Spark clears up while other tasks still run; without the mark they leave nothing behind."""
        store, folder = store_of(self.store_path)
        store.create_dir(f"{folder}/{self.staging}", recursive=True)
        self._put(store, f"{folder}/{self.staging}/job", b"")

    def _stands(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.staging}/job").type == fs.FileType.NotFound:
            raise RuntimeError("the job that this task belongs to is over")

    def _put(self, store: fs.FileSystem, path: str, data: bytes) -> None:
        with store.open_output_stream(path) as out:
            out.write(data)

    def _stored(self, store: fs.FileSystem, path: str) -> bytes:
        with store.open_input_stream(path) as file:
            return file.read()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.store_path)
        own = f"{folder}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt alone
        self._stands(store, folder)
        store.create_dir(own, recursive=False)
        names: list[tuple[str, str]] = []
        try:
            for batch in iterator:
                for k in range(batch.num_rows):  # one picture in memory at a time
                    row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                    name = row["name"]
                    if not name or name.startswith("/") or ".." in name.split("/") or not name.lower().endswith((".png", ".jpg", ".jpeg")):
                        raise ValueError(f"no file of the name {name!r} can be written")
                    data, as_written = encode(row)
                    temporary = f"{own}/{len(names)}.part"
                    self._put(store, temporary, data)
                    try:
                        same = as_written(self._stored(store, temporary))
                    except (ValueError, zlib.error, struct.error) as e:
                        raise VerificationError(f"{name} cannot be read back: {e}") from e
                    if not same:
                        raise VerificationError(f"{name} has other samples when read back")
                    names.append((temporary, name))
            listed = f"{own}/files.json"
            self._put(store, listed, json.dumps(names).encode())
            self._stands(store, folder)
        except BaseException:
            if store.get_file_info(own).type == fs.FileType.Directory:
                store.delete_dir(own)
            raise
        return Written(listed, len(names))

    def commit(self, messages: list[Written | None]) -> None:  # type: ignore[override]
        store, folder = store_of(self.store_path)
        moves = [(a, f"{folder}/{b}") for m in messages if m is not None for a, b in json.loads(self._stored(store, m.listed))]
        targets = [b for _, b in moves]
        if len(set(targets)) < len(targets):
            twice = sorted(b for b in set(targets) if targets.count(b) > 1)[:3] if len(targets) < 10_000 else "some"
            raise ValueError(f"names given twice: {twice}")
        with ThreadPoolExecutor(16) as pool:  # renames wait for the store
            if not self.overwrite:
                there = [b for b, found in zip(targets, pool.map(lambda b: store.get_file_info(b).type != fs.FileType.NotFound, targets), strict=True) if found]
                if there:
                    raise FileExistsError(f"{len(there)} files exist, such as {there[0]}")
            for parent in {posixpath.dirname(b) for b in targets}:
                store.create_dir(parent, recursive=True)
            list(pool.map(lambda m: store.move(*m), moves))
        store.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:  # type: ignore[override]
        store, folder = store_of(self.store_path)
        if store.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.staging}")


class PictureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in HEAD + (SAMPLES if self.options.get("what", "head") == "samples" else []))

    def reader(self, schema) -> PictureReader:  # type: ignore[no-untyped-def]
        return PictureReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> PictureWriter:  # type: ignore[no-untyped-def]
        made = PictureWriter({k.lower(): v for k, v in self.options.items()}, overwrite)
        made.begin()
        return made


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(PictureSource)


def read(spark: SparkSession, folder: str, what: str = "head", region: tuple[int, int, int, int] | None = None, where: list[tuple[str, str, object]] | None = None, **options: str) -> DataFrame:
    """Heads or samples of the files of a folder that pass all tests (column, name of ``TESTS``,
    value); region is (top, left, height, width)."""
    register(spark)
    reader = spark.read.format("pictures").options(path=folder, what=what, where=json.dumps(where or []), **options)
    return (reader.option("region", ",".join(map(str, region))) if region else reader).load()


def write(pictures: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Verified files of pictures (name, height, width, channels, depth, data[, cicp, exif])."""
    register(pictures.sparkSession)
    pictures.write.format("pictures").mode("append").options(path=folder, overwrite=str(overwrite).lower()).save()


def from_pixels(px: DataFrame, name: str, depth: int = 8) -> DataFrame:
    """Pictures of pixels (image_id, y, x, r, g, b): the sides are the largest places, pixels
    that are not there are black. ``name`` is SQL for the file's name. A picture is put together
    in one task, as a file has to be."""

    def build(pdf):  # type: ignore[no-untyped-def]
        import pandas as pd

        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        s = np.zeros((h, w, 3), np.uint8 if depth == 8 else np.dtype("<u2"))
        s[pdf.y, pdf.x] = pdf[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "height": [h], "width": [w], "channels": [3], "depth": [depth], "data": [s.tobytes()]})

    made = px.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInPandas(build, "image_id long, height int, width int, channels int, depth int, data binary")
    return made.select(F.expr(name).alias("name"), "height", "width", "channels", "depth", "data")
