"""Filling of damaged pixels from a pyramid of means.

Each level holds the means of the undamaged pixels of blocks twice as wide as the level
before, and how far each is to be trusted: fully from a quarter of undamaged pixels up. From
the top down, a block takes its own mean as far as that, and for the rest what the four nearest
blocks above it give, weighed by nearness. Damaged pixels take what the blocks of the first level give them. A hole of any
size is filled by the level at which something undamaged is in sight, there are no tiles and
no seams, and a level is one join of damaged places with the level above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonframe.functions.pixel import noise
from photonframe.functions.stored import stored

CELL = ["image_id", "y", "x"]


def _parents() -> Column:
    """The four nearest blocks of the next level and their weights: array of (y, x, weight)."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    beside = lambda c: half(c) + F.when(F.col(c) % 2 == 0, -1).otherwise(1)
    return F.array(*(F.struct(a.alias("y"), b.alias("x"), F.lit(w).alias("weight")) for a, b, w in ((half("y"), half("x"), 9.0), (half("y"), beside("x"), 3.0), (beside("y"), half("x"), 3.0), (beside("y"), beside("x"), 1.0))))


def _from_above(places: DataFrame, above: DataFrame, columns: list[str]) -> DataFrame:
    """For places (image_id, y, x) the weighted means of the blocks above that have a value."""
    asked = places.select(*CELL, F.explode(_parents()).alias("_p")).select(F.col("y").alias("_y"), F.col("x").alias("_x"), "image_id", F.col("_p.y").alias("y"), F.col("_p.x").alias("x"), F.col("_p.weight").alias("_w"))
    means = {f"_up_{c}": F.sum(F.col("_w") * F.col(c)) / F.sum("_w") for c in columns}
    return asked.join(above, CELL).groupBy("image_id", "_y", "_x").agg(*(e.alias(n) for n, e in means.items())).withColumnsRenamed({"_y": "y", "_x": "x"})


def fill(px: DataFrame, mask: str, columns: list[str], grain: float = 0.0, side: int | None = None) -> DataFrame:
    """px with its columns filled where mask is not 0; ``grain`` adds noise of that deviation,
    the same on all columns, so that a filling is no smooth patch. ``side``: the longest side
    of the pictures, found by itself if not given. A picture without any undamaged pixel stays
    as it is; a null mask counts as undamaged, null values are not taken for undamaged ones."""
    good = F.coalesce(F.col(mask), F.lit(0)) == 0
    for c in columns:
        good = good & F.col(c).isNotNull()
    own = px.withColumn("_good", good)
    if side is None:
        side = (px.agg(F.max(F.greatest("y", "x"))).first()[0] or 0) + 1
    top = max(1, (side - 1).bit_length())
    half = lambda c, n: F.floor(F.col(c) / n).cast("int").alias(c)
    sums = [F.sum(F.when(F.col("_good"), F.col(c).cast("double")).otherwise(0.0)).alias(c) for c in columns]
    first = own.groupBy("image_id", half("y", 2), half("x", 2)).agg(F.count("*").alias("_all"), F.count_if("_good").alias("_n"), *sums)
    first = stored(first, "pyramid")
    levels = first.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(top))))
    scale = F.expr("shiftleft(1, _level - 1)")
    all_ = levels.groupBy("image_id", "_level", F.floor(F.col("y") / scale).cast("int").alias("y"), F.floor(F.col("x") / scale).cast("int").alias("x")).agg(*(F.sum(c).alias(c) for c in ("_all", "_n", *columns)))
    all_ = all_.select(*CELL, "_level", F.least(F.lit(1.0), 4 * F.col("_n") / F.col("_all")).alias("_share"), *(F.try_divide(c, F.col("_n")).alias(c) for c in columns))
    all_ = stored(all_, "pyramid")
    filled = all_.where((F.col("_level") == top) & (F.col("_share") > 0)).select(*CELL, *columns)
    for level in range(top - 1, 0, -1):
        cells = all_.where(F.col("_level") == level)
        up = _from_above(cells.where("_share < 1").select(*CELL), filled, columns)
        mixed = [F.coalesce(F.col("_share") * F.col(c) + (1 - F.col("_share")) * F.col(f"_up_{c}"), F.col(c), F.col(f"_up_{c}")).alias(c) for c in columns]
        filled = cells.join(up, CELL, "left").select(*CELL, *mixed).where(F.col(columns[0]).isNotNull())
    up = _from_above(own.where("not _good").select(*CELL), filled, columns)
    extra = noise(F.col("x"), F.col("y")) * grain if grain else F.lit(0.0)
    fixed = {c: F.when(F.col("_good"), F.col(c)).otherwise(F.coalesce(F.col(f"_up_{c}") + extra, F.col(c))) for c in columns}
    return own.join(up, CELL, "left").withColumns(fixed).select(*px.columns)
