"""Lines at any angle as window keys, and regions that grow along them.

At an angle, the pixels of a picture fall into digital lines that cover it once: the place
along a line is the coordinate that advances faster, the line's key is the other coordinate
with the slope taken out. A window over (picture, key) in that order then walks the line, so
everything that windows can do is done along lines: running extremes, openings and closings,
and differences across. Only what is inside the picture counts. Pictures are whole."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.functions.stored import stored

ANGLES = (0.0, 22.5, 45.0, 67.5, 90.0, 112.5, 135.0, 157.5)  # fixed values, degrees
SHORT = 12  # steps to a side up to which a frame is cheaper than running extremes


def coordinates(angle: float) -> tuple[Column, Column]:
    """(key of the line, place along it) of a pixel; lines rise to the right for angles from 0
    to 90 degrees."""
    across, up = cos(radians(angle)), sin(radians(angle))
    y, x = F.col("y"), F.col("x")
    if abs(across) >= abs(up):
        return y + F.floor(x * F.lit(round(up / across, 12)) + 0.5).cast("int"), x
    return x + F.floor(y * F.lit(round(across / up, 12)) + 0.5).cast("int"), y


def steps(length: float, angle: float) -> int:
    """Pixels that a stretch of this length takes along its lines."""
    return round(length * max(abs(cos(radians(angle))), abs(sin(radians(angle)))))


def on_lines(df: DataFrame, angle: float) -> DataFrame:
    """With _key and _pos; what follows in windows over (image_id, _key) needs one exchange."""
    key, place = coordinates(angle)
    return df.withColumns({"_key": key, "_pos": place})


def running(df: DataFrame, columns: dict[str, tuple[str, bool]], m: int) -> DataFrame:
    """Extremes (name to source and whether the largest) over m pixels to each side on the
    lines of ``on_lines``. Long stretches cost what short ones do: lines are cut into blocks of
    2m + 1; every stretch is the rest of one block and the beginning of the next, whose running
    extremes are at hand. Near an end of the line the running extremes of the line serve."""
    line = Window.partitionBy("image_id", "_key")
    ahead, back = line.orderBy("_pos"), line.orderBy(F.desc("_pos"))
    f = lambda largest: F.max if largest else F.min
    if m <= SHORT:
        return df.withColumns({out: f(largest)(source).over(ahead.rowsBetween(-m, m)) for out, (source, largest) in columns.items()})
    block = Window.partitionBy("image_id", "_key", "_block")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_block": F.floor(F.col("_pos") / (2 * m + 1)), "_i": F.row_number().over(ahead), "_n": F.count("*").over(line)})
    orders = {"first": ahead, "last": back, "begin": block.orderBy("_pos"), "rest": block.orderBy(F.desc("_pos"))}
    df = df.withColumns({f"_{name}_{out}": f(largest)(source).over(so_far(w)) for name, w in orders.items() for out, (source, largest) in columns.items()})
    low, high = F.col("_i") > m, F.col("_i") + m <= F.col("_n")
    found = {}
    for out, (source, largest) in columns.items():
        both = F.greatest if largest else F.least
        rest, begin = F.lag(f"_rest_{out}", m).over(ahead), F.lead(f"_begin_{out}", m).over(ahead)
        found[out] = F.when(low & high, both(rest, begin)).when(high, F.lead(f"_first_{out}", m).over(ahead)).when(low, F.lag(f"_last_{out}", m).over(ahead)).otherwise(f(largest)(source).over(line))
    return df.withColumns(found).drop("_block", "_i", "_n", *(f"_{name}_{out}" for name in orders for out in columns))


def opened_and_closed(df: DataFrame, col: str, length: int, angle: float, opened: str, closed: str) -> DataFrame:
    """Opening and closing with lines of a length: what is brighter, or darker, survives where
    such a line fits into it. Both need the lines once."""
    m = steps(length // 2, angle)
    df = running(on_lines(df, angle), {"_low": (col, False), "_high": (col, True)}, m)
    return running(df, {opened: ("_low", True), closed: ("_high", False)}, m).drop("_low", "_high", "_key", "_pos")


def across(df: DataFrame, col: str, distance: int, angle: float, out: str) -> DataFrame:
    """How much the two sides of a line at this angle differ, at a distance from it: along the
    lines that cross it, ends repeated."""
    way = (angle + 90) % 180
    df = on_lines(df, way)
    line = Window.partitionBy("image_id", "_key").orderBy("_pos")
    m = steps(distance, way)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.coalesce(F.lag(col, m).over(line), F.first(col).over(whole)), F.coalesce(F.lead(col, m).over(line), F.last(col).over(whole))
    return df.withColumn(out, F.abs(after - before)).drop("_key", "_pos")


FAR = 1 << 30


def grow(region: DataFrame, most: int, seed: str = "seed") -> DataFrame:
    """Of the pixels of a region (image_id, y, x, seed), those that lie within ``most`` steps of
    a seed, going through the region by neighbours of all eight directions: (image_id, y, x, far).

    Distances spread along rows, columns and both diagonals: in an unbroken run of a line, a
    pixel is as far as the nearest known one of the run and the steps to it. A sweep takes all
    four directions; sweeps go on until no distance changes, which takes as many as the way has
    bends. A region is small against its picture, so all exchanges are."""
    now = region.select("image_id", "y", "x", F.when(F.col(seed), 0).otherwise(FAR).alias("far"))
    now, before = stored(now, "region"), None
    for _ in range(most + 1):
        mark = now.agg(F.sum("far")).first()[0]
        if mark == before:
            break
        before = mark
        for angle in (0.0, 90.0, 45.0, 135.0):
            now = on_lines(now, angle)
            line = Window.partitionBy("image_id", "_key").orderBy("_pos")
            now = now.withColumn("_run", F.col("_pos") - F.row_number().over(line))
            run = Window.partitionBy("image_id", "_key", "_run")
            so_far = lambda way: run.orderBy(way).rowsBetween(Window.unboundedPreceding, 0)  # noqa: B023,E731
            ahead, back = F.min(F.col("far") - F.col("_pos")).over(so_far("_pos")) + F.col("_pos"), F.min(F.col("far") + F.col("_pos")).over(so_far(F.desc("_pos"))) - F.col("_pos")
            near = F.least("far", ahead, back)
            now = now.withColumn("far", F.when(near <= most, near).otherwise(FAR).cast("int")).drop("_key", "_pos", "_run")
        now = stored(now, "region")
    return now.where(F.col("far") <= most)
