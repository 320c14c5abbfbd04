"""HDR pictures through SDR models: decode, proxy, model, back, encode.

Pixels are 16-bit codes in, 16-bit codes out. In between they are linear BT.2020 with 1.0 at
203 cd/m2; a model sees an invertible proxy, whose largest channel is in 0..1, sRGB-encoded at
16 bits, so a model that changes nothing gives the picture back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.functions import colour
from photonframe.functions.pixel import cols
from photonframe.operators import stats
from photonframe.sources import formats, pictures

Model = Callable[[DataFrame], DataFrame]
TOP = 65_535
# Code points of primaries and transfers.
PRIMARIES = {1: "bt709", 9: "bt2020", 12: "p3"}
PQ, HLG = 16, 18


def decode(px: DataFrame, transfer: Column, primaries: Column) -> DataFrame:
    """16-bit codes (r, g, b) as linear BT.2020 by their pictures' code points; light beyond
    PQ's range and outside the gamut is fitted in. Unknown primaries count as BT.2020."""
    px = px.withColumns({c: F.col(c) / float(TOP) for c in "rgb"})
    hlg = colour.hlg_decode(cols())
    px = px.withColumns({c: F.when(transfer == HLG, h).otherwise(colour.pq_decode(F.col(c))) / colour.WHITE for c, h in zip("rgb", hlg, strict=True)})
    moved = {code: colour.apply_matrix(cols(), colour.conversion_matrix(name, "bt2020")) for code, name in PRIMARIES.items() if name != "bt2020"}
    out = {}
    for i, c in enumerate("rgb"):
        value = F.col(c)
        for code, rgb in moved.items():
            value = F.when(primaries == code, rgb[i]).otherwise(value)
        out[c] = value
    px = px.withColumns(out)
    px = px.withColumns(dict(zip("rgb", colour.fit_gamut(cols(), colour.BT2020), strict=True)))
    return px.withColumns({c: F.least(F.col(c), F.lit(colour.PQ_MAX / colour.WHITE)) for c in "rgb"})


def through(lin: DataFrame, model: Model) -> DataFrame:
    """Linear pictures through a model on 16-bit codes (image_id, y, x, r, g, b): its result,
    linear. The largest channel is bent so that the picture's peak becomes one, the others
    keep their ratios to it."""
    peaks = stats.peak(lin)
    px = lin.join(peaks, "image_id").withColumn("_m", F.greatest(*cols(), F.lit(0.0)))
    px = px.withColumn("_k", colour.proxy_ratio(F.col("_m"), F.col("peak")))
    codes = px.select("image_id", "y", "x", *(F.rint(colour.srgb_oetf(F.col(c) * F.col("_k")) * TOP).cast("int").alias(c) for c in "rgb"))
    back = model(codes).withColumns({c: colour.srgb_eotf(F.col(c) / float(TOP)) for c in "rgb"}).join(peaks, "image_id")
    back = back.withColumn("_m", F.greatest(*cols())).withColumn("_k", colour.proxy_inverse_ratio(F.col("_m"), F.col("peak")))
    return back.select("image_id", "y", "x", *(F.greatest(F.col(c) * F.col("_k"), F.lit(0.0)).alias(c) for c in "rgb"))


def encode(lin: DataFrame) -> DataFrame:
    """Linear pictures as 16-bit PQ codes."""
    return lin.select("image_id", "y", "x", *(F.rint(colour.pq_encode(F.col(c) * colour.WHITE) * TOP).cast("int").alias(c) for c in "rgb"))


def light_box(lin: DataFrame) -> DataFrame:
    """(image_id, clli): the body of a PNG's chunk of light levels, in ten-thousandths of cd/m2."""
    levels = stats.light_level(lin)
    part = lambda c: F.lpad(F.hex(F.rint(F.col(c) * 10_000).cast("long")), 8, "0")
    return levels.select("image_id", F.unhex(F.concat(part("max_cll"), part("max_fall"))).alias("clli"))


def run_folder(spark: SparkSession, source: str, target: str, model: Model, overwrite: bool = False) -> DataFrame:
    """PQ and HLG PNG files of a folder through a model to PQ PNG files of the same names in
    another; the heads of all other files come back, with why they were left out."""
    seen = pictures.read(spark, source, "samples")
    fit = F.col("hdr") & (F.col("format") == "png") & (F.col("depth") == 16) & F.col("error").isNull() & F.col("data").isNotNull()
    code = lambda place: F.conv(F.hex(F.substring("cicp", place, F.lit(1))), 16, 10).cast("int")
    base = source.rstrip("/").split("://")[-1]
    own = seen.where(fit).select(F.xxhash64("path").alias("image_id"), F.regexp_replace("path", f"^.*{base}/", "").alias("name"), F.col("rows").alias("height"), F.col("columns").alias("width"), "channels", "depth", "data", code(1).alias("primaries"), code(2).alias("transfer"))
    facts = own.select("image_id", "name", "primaries", "transfer")
    px = formats.explode_pixels(own.select("image_id", "height", "width", "channels", "depth", "data")).join(facts, "image_id")
    lin = through(decode(px, F.col("transfer"), F.col("primaries")), model)
    made = pictures.from_pixels(encode(lin), "image_id", 16).withColumnRenamed("name", "image_id")
    chunks = light_box(lin).withColumn("cicp", F.lit(bytes([9, PQ, 0, 1])))
    pictures.write(made.join(chunks, "image_id").join(facts.select("image_id", "name"), "image_id").drop("image_id"), target, overwrite)
    return seen.where(~F.coalesce(fit, F.lit(False))).select("path", "format", "width", "height", F.coalesce("error", F.lit("no PQ or HLG PNG")).alias("reason"))
