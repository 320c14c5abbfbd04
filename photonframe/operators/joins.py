"""Interpolation joins: a value between the entries of a table, and greedy suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.functions.stored import stored


def bracket(table: DataFrame, key: str, value: str, wrap: float | None = None) -> DataFrame:
    """Intervals (lo, hi, v_lo, v_hi) between neighbouring entries of a small lookup table;
    with ``wrap`` the last leads to the first one period later. The table is a dimension
    (a curve or a wheel), so its one window is small."""
    rows = table.select(F.col(key).cast("double").alias("lo"), F.col(value).cast("double").alias("v_lo"))
    first = table.agg(F.min(F.struct(F.col(key).cast("double").alias("k"), F.col(value).cast("double").alias("v"))).alias("f"))
    out = rows.withColumns({"hi": F.lead("lo").over(Window.orderBy("lo")), "v_hi": F.lead("v_lo").over(Window.orderBy("lo"))})
    if wrap is None:
        return out.where("hi is not null")
    return out.crossJoin(F.broadcast(first)).withColumns({"hi": F.coalesce("hi", F.col("f.k") + wrap), "v_hi": F.coalesce("v_hi", "f.v")}).drop("f")


def interpolate(rows: DataFrame, at: str, intervals: DataFrame, out: str) -> DataFrame:
    """Range join of rows with a dimension of intervals, linear inside the interval."""
    part = F.col("v_lo") + (F.col(at) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))
    found = rows.join(F.broadcast(intervals), (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")), "left")
    return found.withColumn(out, part).drop("lo", "hi", "v_lo", "v_hi")


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, value: str, out: str) -> DataFrame:
    """Last ``value`` of ``right`` at or before each row of ``left``: one window over both
    sides, no range join."""
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(by, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


NAMES = ("box_id", "x0", "y0", "x1", "y1", "score")


def _area(p: str) -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def _dealt(boxes: DataFrame) -> DataFrame:
    """Boxes once for each cell (cx, cy) of a grid that they touch, cells as large as the
    picture's largest box, so that a box touches four at most; n_cells: how many it touches."""
    side = boxes.groupBy("image_id").agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("_side"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / F.col("_cell")), F.floor(F.col(b) / F.col("_cell")))
    dealt = boxes.join(side, "image_id").withColumn("_cell", F.greatest("_side", F.lit(1e-6)))
    dealt = dealt.withColumns({"_xs": span("x0", "x1"), "_ys": span("y0", "y1")}).withColumn("n_cells", F.size("_xs") * F.size("_ys"))
    return dealt.withColumn("cx", F.explode("_xs")).withColumn("cy", F.explode("_ys")).select("image_id", "cx", "cy", "n_cells", *NAMES)


def _met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (image_id, better, worse) of dealt boxes, the better one from ``left``; only boxes of a cell meet."""
    a = left.select("image_id", "cx", "cy", *(F.col(n).alias(f"a_{n}") for n in NAMES))
    b = right.select("image_id", "cx", "cy", *(F.col(n).alias(f"b_{n}") for n in NAMES))
    better = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_box_id") < F.col("b_box_id")))
    width = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    height = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    both = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    union = F.greatest(_area("a_") + _area("b_") - both, F.lit(1e-6))
    met = a.join(b, ["image_id", "cx", "cy"]).where(better & (both / union > threshold))
    return met.select("image_id", F.col("a_box_id").alias("better"), F.col("b_box_id").alias("worse"))


def overlapping(boxes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (image_id, better, worse) of boxes whose intersection is more than ``threshold``
    of their union; better by score, then by the smaller box_id."""
    dealt = _dealt(boxes)
    return _met(dealt, dealt, threshold).distinct()


def suppress(boxes: DataFrame, threshold: float = 0.4, top: int = 256) -> DataFrame:
    """Greedy non-maximum suppression of (image_id, box_id, x0, y0, x1, y1, score): a box goes
    if a better one that stays covers it by more than ``threshold`` (intersection over union).

    Of boxes with the same place and size only the best can stay, and the others change
    nothing. The rest go in rounds over the ``top`` best boxes that each cell of the grid has
    left: one that is among them in all its cells has met every better box that is left there,
    so it is settled as soon as these are. Boxes that stay put out all that they overlap, in
    this round's best and beyond; what is left comes in the next round. A box meets ``top``
    others a cell and round, and those that stay, of which a place has few however many boxes
    crowd it; the best box left of a picture always stays, so rounds end. A box_id is once in
    a picture; a box with a null overlaps none."""
    key = ["image_id", "box_id"]
    place = ["image_id", "x0", "y0", "x1", "y1"]
    known = boxes.select("image_id", *NAMES).where(" and ".join(f"{n} is not null" for n in ("image_id", *NAMES)))
    # A box too small to overlap itself has no copies
    single = F.when(_area("") / F.greatest(_area(""), F.lit(1e-6)) > threshold, F.lit(None)).otherwise(F.col("box_id"))
    best = known.withColumn("_single", single).groupBy(*place, "_single", "score").agg(F.min("box_id").alias("box_id"))
    best = best.groupBy(*place, "_single").agg(F.max(F.struct("score", "box_id")).alias("_best")).select(*place, "_best.*")
    rest = stored(_dealt(best), "boxes")
    order = Window.partitionBy("image_id", "cx", "cy").orderBy(F.desc("score"), "box_id")
    kept = known.select(*key).limit(0)
    while True:
        tops = stored(rest.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top), "tops")
        if not tops.head(1):
            break
        stay = _settled(_met(tops, tops, threshold).distinct(), tops.groupBy(*key, "n_cells").count().where("count = n_cells").select(*key))
        kept = kept.unionByName(stay)
        out = _met(tops.join(stay, key, "left_semi"), rest, threshold).select("image_id", F.col("worse").alias("box_id"))
        rest = stored(rest.join(stay.unionByName(out).distinct(), key, "left_anti"), "boxes")
    gone = known.select(*key).join(kept, key, "left_anti")
    return boxes.join(gone, key, "left_anti")


def _settled(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Of the boxes ``whole``, all whose better ones are among the pairs, those that stay for
    sure: boxes that no better one overlaps stay, those that they overlap go, and both leave
    the pairs; as many rounds as the longest chain of boxes each of which would put out the next."""
    pairs, whole = stored(pairs, "pairs"), stored(whole, "whole")
    while True:
        stay = whole.join(pairs.select("image_id", F.col("worse").alias("box_id")), ["image_id", "box_id"], "left_anti")
        out = stored(pairs.join(stay.withColumnRenamed("box_id", "better"), ["image_id", "better"], "left_semi").select("image_id", F.col("worse").alias("box_id")).distinct(), "out")
        if not out.head(1):
            return stored(stay, "stay")
        for end in ("better", "worse"):
            pairs = pairs.join(out.withColumnRenamed("box_id", end), ["image_id", end], "left_anti")
        pairs, whole = stored(pairs, "pairs"), stored(whole.join(out, ["image_id", "box_id"], "left_anti"), "whole")
