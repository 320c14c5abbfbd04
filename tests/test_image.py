"""Image operators: every query against its DuckDB SQL, published values, invariants."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.functions import colour, pixel
from photonframe.functions.pixel import cols
from photonframe.operators import gainmap, joins, lighting, resample, stencil
from photonframe.plans.oracles import ORACLES
from photonframe.plans.queries import QUERIES
from photonframe.sources import formats
from photonframe.sources.relations import test_pattern as pattern
from photonframe.streaming import events as ev

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    fix = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = canonical(got.select(*names).collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == names
        assert rows == canonical(duck.sql(f"select {', '.join(f'"{n}"' for n in names)} from ({ORACLES[name]})").fetchall())
    else:
        assert rows


def one(spark, **exprs):
    return spark.range(1).select(*(e.alias(n) for n, e in exprs.items())).first()


def test_published_colour_values(spark):
    got = one(spark, a=colour.pq_encode(F.lit(203.0)), b=colour.pq_encode(F.lit(1000.0)) * 1023, c=colour.pq_encode(F.lit(100.0)) * 1023, d=colour.srgb_eotf(F.lit(0.5)), e=colour.srgb_eotf(F.lit(0.04045)), f=colour.pq_decode(colour.pq_encode(F.lit(4000.0))))
    assert abs(got.a - 0.58) < 2e-3 and round(got.b) == 769 and round(got.c) == 520
    assert abs(got.d - 0.2140411) < 1e-6 and abs(got.e - 0.0031308) < 1e-6 and abs(got.f - 4000) < 1e-6
    grey = colour.hlg_decode((F.lit(0.75),) * 3)
    white = colour.hlg_decode((F.lit(1.0),) * 3)
    got = one(spark, g=grey[0], w=white[0], back=colour.hlg_encode(grey)[1])
    assert abs(got.g - 203) < 4.1 and abs(got.w - 1000) < 1e-3 and abs(got.back - 0.75) < 1e-6
    assert np.allclose(colour.conversion_matrix("bt709", "bt2020").sum(1), 1) and abs(colour.conversion_matrix("bt709", "bt2020")[0, 0] - 0.6274) < 1e-4


def test_grey_stays_grey_and_ramps_stay_monotone(spark):
    ramp = spark.range(256).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), *(F.col("id").cast("int").alias(c) for c in "rgb"))
    for name, adj in lighting.PROFILES.items():
        if adj.temperature or adj.tint:
            continue
        rows = [(r.r, r.g, r.b) for r in lighting.apply_profile(ramp, name).orderBy("x").collect()]
        assert all(max(v) - min(v) <= 1 for v in rows), name
        assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:], strict=False)), name


def test_zero_intensity_changes_nothing(spark):
    px = pattern(spark.range(1).selectExpr("id as image_id", "8 as size"))
    assert lighting.apply_profile(px, "vivid", 0) is px
    assert lighting.apply_look(px, lighting.LOOKS["sony-vivid"].scaled(0)) is px


def test_proxy_is_invertible(spark):
    px = spark.range(1, 200).select((F.col("id") / 20.0).alias("m"), F.lit(9.95).alias("peak"))
    px = px.withColumn("p", F.col("m") * colour.proxy_ratio(F.col("m"), F.col("peak")))
    worst = px.select(F.max(F.abs(F.col("p") * colour.proxy_inverse_ratio(F.col("p"), F.col("peak")) - F.col("m"))), F.max("p")).first()
    assert worst[0] < 1e-9 and worst[1] <= 1


def test_hash_as_unsigned_arithmetic(spark):
    def numpy_hash(ix, iy, seed):
        with np.errstate(over="ignore"):
            h = np.uint32(ix) * np.uint32(0x8DA6B343) ^ np.uint32(iy) * np.uint32(0xD8163841) ^ np.uint32(seed & 0xFFFFFFFF)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x5BD1E995)
            return int(h ^ (h >> np.uint32(15)))

    got = spark.range(300).select("id", pixel.hash32(F.col("id") * 7, F.col("id") * 13, 0x5EED1F7 * 7 + 1).alias("h")).collect()
    assert all(r.h == numpy_hash(r.id * 7, r.id * 13, 0x5EED1F7 * 7 + 1) for r in got)


def test_constant_pictures_survive_every_filter(spark):
    px = spark.range(36).select(F.lit(0).cast("long").alias("image_id"), F.expr("cast(id div 6 as int)").alias("y"), F.expr("cast(id % 6 as int)").alias("x"), F.lit(100.0).alias("l"))
    out = stencil.gaussian(stencil.box_replicate(stencil.box_clip(px, "l", 2), "l", 3), "l", 4.0)
    assert out.select(F.max(F.abs(F.col("l") - 100))).first()[0] < 1e-9
    assert stencil.guided(px, "l", {"o": "l"}, 2, 0.01).select(F.max(F.abs(F.col("o") - 100))).first()[0] < 1e-9


def test_resize_weights_add_up():
    for kind in ("box", "bilinear", "bicubic", "lanczos"):
        for n, size in ((8, 3), (3, 8), (7, 7)):
            sums = {}
            for _, o, w in resample.filter_weights(kind, n, size):
                sums[o] = sums.get(o, 0) + w
            assert len(sums) == size and all(abs(s - 1) < 1e-12 for s in sums.values())


def test_identity_warp(spark):
    px = pattern(spark.range(1).selectExpr("id as image_id", "6 as size"))
    out = resample.warp(px, ["r"], (1, 0, 0, 0, 1, 0), 6, 6)
    assert out.join(px.select("y", "x", F.col("r").alias("q")), ["y", "x"]).where("abs(r - q) > 1e-9 or coverage <> 1").count() == 0 and out.count() == 36


def test_suppression_keeps_the_best(spark):
    boxes = [(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 1, 1, 11, 11, 0.8), (1, 2, 50, 50, 60, 60, 0.7), (2, 3, 0, 0, 10, 10, 0.1)]
    frame = spark.createDataFrame([tuple(map(float, b[2:])) + (b[0], b[1]) for b in boxes], "x0 double, y0 double, x1 double, y1 double, score double, image_id long, box_id long")
    assert sorted(r.box_id for r in joins.suppress(frame).collect()) == [0, 2, 3]


def test_a_baked_look_is_nearly_the_look(spark):
    px = pattern(spark.range(1).selectExpr("id as image_id", "64 as size"))
    look = lighting.LOOKS["fujifilm-velvia"]
    plain = replace(look, clarity=0.0)
    want = lighting.apply_look(px, plain)
    got = lighting.look_up(px, lighting.bake(spark, plain))
    both = got.join(want.select("y", "x", *(F.col(c).alias(f"w{c}") for c in "rgb")), ["y", "x"])
    worst = both.select(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"w{c}")) for c in "rgb"))), F.count("*")).first()
    assert worst[0] <= 4 and worst[1] == px.count()


def test_sdr_in_hdr(spark):
    px = spark.createDataFrame([(0, 0, 0, 255, 255, 255), (0, 0, 1, 0, 0, 0)], "image_id long, y int, x int, r int, g int, b int")
    white, black = gainmap.place_sdr(px, 203.0, 1000.0, True).orderBy("x").collect()
    assert abs(white.r - 4.926) < 0.01 and black.r == 0
    assert abs(gainmap.place_sdr(px, 406.0, 1000.0, False).orderBy("x").first().g - 2.0) < 1e-3
    assert [r[0] for r in px.select(pixel.alpha16(F.col("r"), True)).collect()] == [65535, 0]


# ---- formats
def filtered_png(samples: np.ndarray, kinds) -> bytes:
    """PNG of 8-bit samples whose rows use these filters (an encoder of its own)."""
    h, w, c = samples.shape
    out = bytearray()
    up = [0] * (w * c)
    for y in range(h):
        row, kind = samples[y].reshape(-1).tolist(), kinds[y % len(kinds)]
        out.append(kind)
        for i, v in enumerate(row):
            a, b, d = row[i - c] if i >= c else 0, up[i], up[i - c] if i >= c else 0
            p = a + b - d
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
            out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        up = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return formats.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters(channels):
    s = np.random.default_rng(3).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    assert (formats.read_png(filtered_png(s, [0, 1, 2, 3, 4]))[0] == s).all()


def test_png_16_and_damage(spark):
    s = np.random.default_rng(4).integers(0, 65536, (37, 53, 3), dtype=np.uint16)
    s[:5] = 65535
    data = formats.write_png(s, {"cICP": bytes([9, 16, 0, 1])})
    back, extra = formats.read_png(data)
    assert (back == s).all() and extra["cICP"] == bytes([9, 16, 0, 1])
    broken = bytearray(data)
    broken[60] ^= 1
    rows = spark.createDataFrame([(1, bytearray(data)), (2, broken), (3, bytearray(data[:100])), (4, None)], "image_id long, content binary")
    got = {r.image_id: r for r in formats.decode_png(rows).collect()}
    assert got[1].error is None and got[1].depth == 16 and all(got[i].error and got[i].data is None for i in (2, 3, 4))
    assert formats.explode_pixels(formats.decode_png(rows)).count() == 37 * 53


def test_recognition_reads_blocks_only(spark):
    s = np.zeros((2, 3, 3), np.uint8)
    heads = {
        "png": formats.write_png(s, {"tEXt": b"k\0cICP hdrgm: \x06\x34\x94\x35\x0f"}),
        "png-hdr": formats.write_png(s, {"gAMA": b"\0\0\0\1", "cICP": bytes([9, 16, 0, 1])}),
        "jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x11\x08\x00\x21\x01\x02" + bytes(10) + b"\xff\xda\x00\x04xx hdrgm: in the scan",
        "webp": b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0\x0f\x01\0\x07\0\0",
        "gif": b"GIF89a\x05\0\x06\0",
        "unknown": b"",
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "k string, c binary").select("k", formats.probe(F.col("c")).alias("p"))
    got = {r.k: tuple(r.p) for r in rows.collect()}
    assert got == {"png": ("png", 3, 2), "png-hdr": ("png-hdr", 3, 2), "jpeg": ("jpeg", 258, 33), "webp": ("webp", 272, 8), "gif": ("gif", 5, 6), "unknown": ("unknown", None, None)}


def test_hdr_sources_and_previews(spark):
    rows = spark.createDataFrame([("gain-map", 10), ("avif", 1000), ("jpeg", 0)], "k string, n long")
    got = [tuple(r) for r in rows.select(formats.is_hdr_source(F.col("k"), False), formats.is_hdr_source(F.col("k"), True), formats.preview_fits(F.col("n"), 1600.0)).collect()]
    assert got == [(False, True, True), (False, False, False), (False, False, True)]
    codes = spark.createDataFrame([("avif", 16), ("avif", 18), ("avif", 1), ("avif", None), ("jpeg", 16), ("exr", None)], "k string, t int")
    assert [r.h for r in codes.select(formats.is_hdr_source(F.col("k"), False, F.col("t")).alias("h")).collect()] == [True, True, False, False, False, True]


def test_sniff(spark):
    heads = {"png": formats.SIGNATURE, "jpeg": b"\xff\xd8\xff\xe0", "gain-map": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x14 xmp hdrgm:Version", "avif": b"\0\0\0\x1cftypavif", "exr": b"\x76\x2f\x31\x01", "rgbe": b"#?RADIANCE\n", "webp": b"RIFF\0\0\0\0WEBP", "tiff": b"II*\0", "bmp": b"BM", "gif": b"GIF89a", "unknown": b"hello"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "k string, c binary").select("k", formats.sniff(F.col("c")).alias("f")).collect()
    assert all(r.k == r.f for r in rows)


def test_gain_map_metadata(spark):
    good = '<x hdrgm:GainMapMax="2.5" hdrgm:HDRCapacityMax="3"><hdrgm:GainMapMin><rdf:Seq><rdf:li>0.1</rdf:li><rdf:li>0.2</rdf:li><rdf:li>0.3</rdf:li></rdf:Seq></hdrgm:GainMapMin></x>'
    texts = [good, good.replace("2.5", "0.15"), good.replace("hdrgm:GainMapMax", "x"), good.replace("2.5", "nonsense")]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(formats.gain_map_metadata(F.col("t")).alias("m")).collect()]
    assert got[0].GainMapMax == [2.5] and got[0].GainMapMin == [0.1, 0.2, 0.3] and got[0].Gamma == [1.0] and got[1:] == [None] * 3


# ---- streams
def test_status_stream(spark, tmp_path):
    rows = [("a", 1, "queued"), ("a", 2, "processing"), ("a", 3, "done"), ("b", 2, "queued")]
    spark.createDataFrame(rows, "item string, at int, status string").select("item", F.timestamp_seconds("at").alias("at"), "status").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("item string, at timestamp, status string").parquet(f"{tmp_path}/in")
    run = ev.status_stream(stream, "item", "at", "status").writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["item"]: r["status"] for r in spark.table("states").collect()} == {"a": "done", "b": "queued"}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_eetf_keeps_what_is_below_the_knee(spark):
    rows = spark.range(1, 100).select((F.col("id") / 25.0).alias("m")).withColumn("k", colour.eetf_ratio(F.col("m"), 812.0, 203.0)).collect()
    assert all(abs(r.k - 1) < 1e-9 for r in rows if r.m < 0.05) and max(r.m * r.k for r in rows) <= 1 + 1e-6
    values = [r.m * r.k for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(values, values[1:], strict=False)) and not math.isnan(sum(values))
    assert cols()[0] is not None
