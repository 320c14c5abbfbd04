"""Sample depths on the way in, and options on the way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST_EXIF = 65_533  # fixed value: bytes in one segment


def to_8_bits(px: DataFrame, col: str, kind: str) -> DataFrame:
    """Samples of kind I;16, I or F as 8-bit levels: 16 bits lose their low byte, integers do
    so only in pictures that exceed 255, floats are scaled from 1 or from 255."""
    v, top = F.col(col), F.col("_top")
    if kind in ("I", "F"):  # the picture's largest sample decides
        px = px.join(px.groupBy("image_id").agg(F.max(col).alias("_top")), "image_id")
    if kind == "I;16":
        out = F.shiftright(v.cast("int"), 8)
    elif kind == "I":
        out = F.when(top > 255, F.shiftright(v.cast("int"), 8)).otherwise(v.cast("int"))
    elif kind == "F":
        out = F.floor(v / F.when(top <= 1, 1.0).otherwise(255.0) * 255)
    else:
        raise ValueError(f"unknown sample kind {kind}")
    return px.withColumn(col, F.least(F.greatest(out, F.lit(0)), F.lit(255)).cast("int")).drop("_top")


def save_options(fmt: Column, quality: Column, mode: Column, exif: Column, icc: Column, dpi: Column, scale: Column) -> Column:
    """Map of encoder options: full chroma from quality 90 up, EXIF where it fits, a colour
    profile only for its own colour space, density times the scale."""
    text = lambda c: c.cast("string")
    jpeg = fmt == "JPEG"
    space = F.decode(F.substring(icc, 17, 4), "US-ASCII")
    fits = F.when(mode.isin("L", "LA", "1"), space == "GRAY").when(mode.isin("RGB", "RGBA"), space == "RGB ").otherwise(F.lit(False))
    entries = {
        "quality": F.when(fmt.isin("JPEG", "WEBP"), text(quality)),
        "subsampling": F.when(jpeg, F.when(quality >= 90, "0").otherwise("2")),
        "method": F.when(fmt == "WEBP", "4"),
        "compress_level": F.when(fmt == "PNG", "6"),
        "exif": F.when((F.length(exif) > 0) & ~(jpeg & (F.length(exif) > LARGEST_EXIF)), F.hex(exif)),
        "icc_profile": F.when(fits, F.hex(icc)),
        "dpi": F.when(fmt.isin("JPEG", "PNG"), text(dpi * scale)),
    }
    return F.map_filter(F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def public_metadata(tags: Column, location: tuple[str, ...] = ("GPSInfo", "GPSLatitude", "GPSLongitude", "GPSAltitude")) -> Column:
    """EXIF tags without the place, with the orientation that decoding has applied."""
    kept = F.map_filter(tags, lambda k, _: ~k.isin(*location) & (k != "Orientation"))
    return F.map_concat(kept, F.create_map(F.lit("Orientation"), F.lit("1")))
