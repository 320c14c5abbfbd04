"""Resampling as joins with weight tables, tiles and affine maps."""

from __future__ import annotations

from math import ceil, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_reduce(px: DataFrame, factor: int, columns: list[str]) -> DataFrame:
    """Means of factor x factor blocks."""
    return px.groupBy("image_id", F.expr(f"cast(y div {factor} as int)").alias("y"), F.expr(f"cast(x div {factor} as int)").alias("x")).agg(*(F.avg(c).alias(c) for c in columns))


def nearest(px: DataFrame, scale: int) -> DataFrame:
    """Every pixel scale x scale times: what a model's stand-in does."""
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    return px.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).withColumns({"y": F.col("y") * scale + F.col("_dy"), "x": F.col("x") * scale + F.col("_dx")}).drop("_dy", "_dx")


def bilinear_grid(grid: DataFrame, columns: list[str], rows: int, cols: int, height: int, width: int) -> DataFrame:
    """Samples a (rows, cols) grid at the centres of height x width pixels: each cell is sent
    to the pixels it contributes to, with its weight, and these are summed."""
    out = grid
    for axis, n, size in (("y", rows, height), ("x", cols, width)):
        weights = _linear_weights(out.sparkSession, n, size)
        others = [c for c in ("image_id", "y", "x") if c != axis]
        out = out.join(F.broadcast(weights.withColumnRenamed("i", axis)), axis).groupBy(*others, "o").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in columns)).withColumnRenamed("o", axis)
    return out


def _linear_weights(spark, n: int, size: int) -> DataFrame:  # type: ignore[no-untyped-def]
    """(i, o, w) of linear interpolation of n cells at size pixel centres."""
    pos = F.least(F.greatest((F.col("id") + 0.5) / size * n - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
    base = spark.range(size).select(F.col("id").cast("int").alias("o"), pos.alias("p")).withColumn("lo", F.floor("p").cast("int"))
    part = F.array(F.struct(F.col("lo").alias("i"), (1 - (F.col("p") - F.col("lo"))).alias("w")), F.struct(F.least(F.col("lo") + 1, F.lit(n - 1)).alias("i"), (F.col("p") - F.col("lo")).alias("w")))
    return base.select("o", F.explode(part).alias("q")).select("q.i", "o", "q.w")


def filter_weights(kind: str, n: int, size: int) -> list[tuple[int, int, float]]:
    """(in, out, weight) of an antialiased filter from n to size samples, each output's
    weights adding up to one. kind: box, bilinear, bicubic or lanczos."""
    half = {"box": 0.5, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}[kind]

    def f(t: float) -> float:
        t = abs(t)
        if t >= half and not (kind == "box" and t == 0.5):
            return 0.0
        if kind == "box":
            return 1.0
        if kind == "bilinear":
            return 1 - t
        if kind == "bicubic":  # a = -0.5
            return (1.5 * t - 2.5) * t * t + 1 if t < 1 else ((-0.5 * t + 2.5) * t - 4) * t + 2
        return 1.0 if t == 0 else sin(pi * t) / (pi * t) * sin(pi * t / 3) / (pi * t / 3)

    ratio = n / size
    stretch = max(ratio, 1.0)
    out = []
    for o in range(size):
        centre = (o + 0.5) * ratio
        low, high = max(0, int(centre - half * stretch + 0.5)), min(n, ceil(centre + half * stretch + 0.5))
        own = [(i, f((i + 0.5 - centre) / stretch)) for i in range(low, high)]
        total = sum(w for _, w in own) or 1.0
        out += [(i, o, w / total) for i, w in own if w]
    return out


def resize(px: DataFrame, columns: list[str], height: int, width: int, out_height: int, out_width: int, kind: str = "lanczos") -> DataFrame:
    """Separable resampling of pictures of one size: rows, then columns, each a join with
    its weight table (a few weights for each output line) and a sum."""
    out = px
    for axis, n, size in (("x", width, out_width), ("y", height, out_height)):
        weights = out.sparkSession.createDataFrame(filter_weights(kind, n, size), f"{axis} int, o int, w double")
        others = [c for c in ("image_id", "y", "x") if c != axis]
        out = out.join(F.broadcast(weights), axis).groupBy(*others, "o").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in columns)).withColumnRenamed("o", axis)
    return out.select("image_id", "y", "x", *columns)


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Array of evenly spaced starts that cover a length with at least this overlap."""
    overlap = min(overlap, tile // 2)
    count = F.greatest(F.ceil((length - overlap) / F.lit(float(tile - overlap))), F.lit(2))
    step = (length - tile) / (count - 1)
    many = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.rint(i * step).cast("int"))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(many)


def plan_tiles(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(image_id, ty, tx, y0, y1, x0, x1, overlap_top, overlap_left) for images with width
    and height."""
    planned = images.select("image_id", "height", "width", tile_starts(F.col("height"), tile, overlap).alias("ys"), tile_starts(F.col("width"), tile, overlap).alias("xs"))
    out = planned.select("*", F.posexplode("ys").alias("ty", "y0")).select("*", F.posexplode("xs").alias("tx", "x0"))
    before = lambda starts, at, own, size: F.when(at > 0, F.greatest(F.least(F.get(starts, at - 1) + tile, size) - own, F.lit(0))).otherwise(0)
    return out.select("image_id", "ty", "tx", "y0", F.least(F.col("y0") + tile, F.col("height")).alias("y1"), "x0", F.least(F.col("x0") + tile, F.col("width")).alias("x1"), before(F.col("ys"), F.col("ty"), F.col("y0"), F.col("height")).alias("overlap_top"), before(F.col("xs"), F.col("tx"), F.col("x0"), F.col("width")).alias("overlap_left"))


def paste(tiles: DataFrame, columns: list[str]) -> DataFrame:
    """Tile pixels (image_id, ty, tx, y0, x0, overlap_top, overlap_left, y, x, columns) to
    pictures: where tiles overlap, later ones are faded in over the overlap, in raster order.
    A pixel is in four tiles at most, so its group is bounded."""
    oy, ox = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    wy = F.when(oy < F.col("overlap_top"), (oy + 0.5) / F.col("overlap_top")).otherwise(F.lit(1.0))
    wx = F.when(ox < F.col("overlap_left"), (ox + 0.5) / F.col("overlap_left")).otherwise(F.lit(1.0))
    parts = tiles.groupBy("image_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("ty", "tx", (wy * wx).alias("w"), *(F.col(c).cast("double").alias(c) for c in columns)))).alias("parts"))

    def fold(c: str) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, p: F.when(p["w"] >= 1, p[c]).otherwise(F.floor(acc * (1 - p["w"]) + p[c] * p["w"] + 0.5).cast("double"))).cast("int").alias(c)

    return parts.select("image_id", "y", "x", *(fold(c) for c in columns))


# Tile sides to choose from.
TILE_CHOICES = (1024, 768, 512, 384, 256, 192, 128, 64)


def tile_size(height: Column, width: Column, bytes_per_pixel: float, budget: float, cap: int = 1024) -> Column:
    """The largest side whose pixels fit the budget, the smallest one if none does."""
    longest = F.greatest(height, width)
    out = None
    for side in (s for s in TILE_CHOICES if s <= cap):
        used = F.least(F.lit(side), longest)
        fits = used.cast("double") * used * bytes_per_pixel <= budget
        out = F.when(fits, side) if out is None else out.when(fits, side)
    return out.otherwise(TILE_CHOICES[-1])  # type: ignore[union-attr]


BROADCAST_PIXELS = 300_000  # a warped picture's pixels, four samples each, that are broadcast at most


def warp(px: DataFrame, columns: list[str], matrix: tuple[float, float, float, float, float, float], height: int, width: int) -> DataFrame:
    """Affine bilinear warp: output pixel (y, x) samples source (x', y') = matrix (a, b, c, d,
    e, f) as (ax + by + c, dx + ey + f); with coverage, the weight that was inside. Pixels
    without any coverage have no row."""
    a, b, c, d, e, f = matrix
    spark = px.sparkSession
    out = spark.range(height * width).select(F.expr(f"cast(id div {width} as int)").alias("y"), F.expr(f"cast(id % {width} as int)").alias("x"))
    out = out.withColumns({"_sx": a * F.col("x") + b * F.col("y") + c, "_sy": d * F.col("x") + e * F.col("y") + f})
    fx, fy = F.col("_sx") - F.floor("_sx"), F.col("_sy") - F.floor("_sy")
    corner = lambda dy, dx: F.struct((F.floor("_sy") + dy).cast("int").alias("sy"), (F.floor("_sx") + dx).cast("int").alias("sx"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    need = out.select("y", "x", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("q")).select("y", "x", "q.*").where("w > 0")
    if height * width <= BROADCAST_PIXELS:  # else both sides are dealt by place
        need = F.broadcast(need)
    source = px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *columns)
    sums = need.join(source, ["sy", "sx"]).groupBy("image_id", "y", "x").agg(F.sum("w").alias("coverage"), *(F.sum(F.col(k) * F.col("w")).alias(k) for k in columns))
    return sums.select("image_id", "y", "x", "coverage", *((F.col(k) / F.col("coverage")).alias(k) for k in columns))
