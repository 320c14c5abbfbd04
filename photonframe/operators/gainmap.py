"""Gain maps: HDR from an SDR picture and a small picture of log2 gains, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonframe.functions import colour
from photonframe.functions.pixel import BT2020, clip, cols
from photonframe.operators.resample import bilinear_grid, block_reduce

OFFSET = 1 / 64


def gains(sdr: DataFrame, hdr: DataFrame, block: int = 4) -> DataFrame:
    """(image_id, y, x, gain, low, high): log2 ratio of the largest components, meant over
    blocks, and each picture's least and greatest."""
    other = hdr.select("image_id", "y", "x", F.greatest(*cols()).alias("_h"))
    rows = sdr.select("image_id", "y", "x", F.greatest(*cols()).alias("_s")).join(other, ["image_id", "y", "x"])
    rows = rows.withColumn("gain", F.log2((F.greatest(F.col("_h"), F.lit(0.0)) + OFFSET) / (F.greatest(F.col("_s"), F.lit(0.0)) + OFFSET)))
    small = block_reduce(rows, block, ["gain"])
    ends = small.groupBy("image_id").agg(F.min("gain").alias("low"), F.max("gain").alias("high"))
    return small.join(ends, "image_id")


def encode(small: DataFrame) -> DataFrame:
    """Gains as 8-bit codes between the picture's ends."""
    share = (F.col("gain") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    return small.withColumn("code", F.floor(clip(share) * 255 + 0.5).cast("int"))


def apply(sdr: DataFrame, codes: DataFrame, height: int, width: int, block: int = 4, gamma: float = 1.0, weight: float = 1.0) -> DataFrame:
    """Linear SDR pixels lifted by a gain map of height/block x width/block codes."""
    wide = bilinear_grid(codes.select("image_id", "y", "x", (F.col("code") / 255.0).alias("_g")), ["_g"], -(-height // block), -(-width // block), height, width)
    ends = codes.groupBy("image_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sdr.join(wide, ["image_id", "y", "x"]).join(ends, "image_id")
    g = F.pow(clip(F.col("_g")), F.lit(1 / gamma))
    rows = rows.withColumn("_k", F.pow(F.lit(2.0), weight * (F.col("low") * (1 - g) + F.col("high") * g)))
    lifted: list[Column] = [F.greatest((F.col(c) + OFFSET) * F.col("_k") - OFFSET, F.lit(0.0)).alias(c) for c in "rgb"]
    return rows.select("image_id", "y", "x", *lifted)


def place_sdr(px: DataFrame, sdr_white: float, peak: float, expand: bool, matrix: list[list[float]] | None = None, largest: float = 4.926) -> DataFrame:
    """8-bit sRGB pixels as linear light of BT.2020 in units of reference white: white at
    ``sdr_white`` nits, highlights stretched towards ``peak`` nits where ``expand``."""
    matrix = matrix or colour.conversion_matrix("bt709", "bt2020")
    px = px.withColumns({c: colour.srgb_eotf(F.col(c) / 255.0) for c in "rgb"})
    px = px.withColumns(dict(zip("rgb", colour.apply_matrix(cols(), matrix), strict=True)))
    px = px.withColumns(dict(zip("rgb", colour.fit_gamut(cols(), BT2020), strict=True)))
    headroom = min(largest, peak / sdr_white) if expand else 1.0
    if headroom > 1:
        px = px.withColumn("_k", colour.expand_ratio(F.greatest(*cols()), headroom, 0.5)).withColumns({c: F.col(c) * F.col("_k") for c in "rgb"}).drop("_k")
    return px.withColumns({c: F.col(c) * (sdr_white / colour.WHITE) for c in "rgb"})
