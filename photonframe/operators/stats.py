"""Statistics of pictures as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonframe.functions.pixel import BT601, cols, luma

from .stencil import AXES, box_means, line


def luma_bins(px: DataFrame, bins: int = 32) -> DataFrame:
    """(image_id, bin, n, mean_cb, mean_cr): pixels and mean chroma for each luma bin."""
    y = luma(cols(), BT601)
    b = F.least(F.greatest((y / 256 * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    return px.select("image_id", b.alias("bin"), (F.col("b") - y).alias("cb"), (F.col("r") - y).alias("cr")).groupBy("image_id", "bin").agg(F.count("*").alias("n"), F.avg("cb").alias("mean_cb"), F.avg("cr").alias("mean_cr"))


BINS = 4096


def trimmed_mean(rows: DataFrame, key: str, value: str, share: float, out: str) -> DataFrame:
    """Mean of the lowest floor(share * n) values of each key, at least one; nulls are none.

    Values are counted and added up by bin, which merges in any order. The running count of a
    key's bins finds the one in which the share ends; the bins before count whole, and of that
    one bin alone the values are ranked, equal ones as one row. No window meets a picture."""
    v = rows.select(F.col(key), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = v.groupBy(key).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("*").alias("_all"))
    ends = ends.withColumn("_take", F.greatest(F.floor(F.col("_all") * share), F.lit(1)))
    place = F.floor((F.col("_v") - F.col("_least")) / (F.col("_most") - F.col("_least")) * BINS)
    v = v.join(ends, key).withColumn("_bin", F.when(F.col("_most") > F.col("_least"), F.least(place, F.lit(BINS - 1))).otherwise(0).cast("int"))
    bins = v.groupBy(key, "_bin").agg(F.first("_take").alias("_take"), F.count("*").alias("_n"), F.sum("_v").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_below": F.coalesce(F.sum("_sum").over(before), F.lit(0.0))})
    last = bins.where((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") >= F.col("_take"))).select(key, "_bin", "_before", "_below")
    inside = v.join(last, [key, "_bin"]).groupBy(key, "_v").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("_take", "_before", "_below")))
    ranked = inside.withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    some = F.greatest(F.least(F.col("_n"), F.col("_take") - F.col("_so_far")), F.lit(0))
    return ranked.groupBy(key).agg(((F.first("_below") + F.sum(F.col("_v") * some)) / F.first("_take")).alias(out))


def monochrome(px: DataFrame, threshold: float = 3.5) -> DataFrame:
    """(image_id, colorfulness, tint, monochrome, toned): chroma that brightness does not
    explain, after smoothing, without its most colourful hundredth."""
    y = luma(cols(), BT601)
    rows = px.select("image_id", "y", "x", y.alias("_l"), (F.col("b") - y).alias("cb"), (F.col("r") - y).alias("cr"))
    rows = box_means(rows, {"cb": "cb", "cr": "cr"}, 2, replicate=True)
    b = F.least(F.greatest((F.col("_l") / 256 * 32).cast("int"), F.lit(0)), F.lit(31))
    rows = rows.withColumn("bin", b)
    means = rows.groupBy("image_id", "bin").agg(F.avg("cb").alias("_cb"), F.avg("cr").alias("_cr"))
    rows = rows.join(means, ["image_id", "bin"]).withColumns({"residual": F.hypot(F.col("cb") - F.col("_cb"), F.col("cr") - F.col("_cr")), "size": F.hypot("cb", "cr")})
    colour = trimmed_mean(rows, "image_id", "residual", 0.99, "colorfulness")
    out = colour.join(rows.groupBy("image_id").agg(F.avg("size").alias("tint")), "image_id")
    mono = F.col("colorfulness") < threshold
    return out.withColumns({"monochrome": mono, "toned": mono & (F.col("tint") > 2.0)})


def noise_level(px: DataFrame, col: str) -> DataFrame:
    """(image_id, noise): from the absolute Laplacian of 0..1 values inside the border, its
    flattest nine tenths."""
    across, down = line(AXES[0]), line(AXES[1])
    second = lambda c, w: F.lag(c).over(w) - 2 * F.col(c) + F.lead(c).over(w)
    rows = px.withColumn("_v", F.col(col).cast("double")).withColumn("_h", second("_v", across)).withColumn("_lap", F.abs(second("_h", down))).where(F.col("_lap").isNotNull())
    return trimmed_mean(rows, "image_id", "_lap", 0.9, "m").select("image_id", (F.col("m") * (3.141592653589793 / 2) ** 0.5 / 6).alias("noise"))


def levels(px: DataFrame, cut: float = 0.4) -> DataFrame:
    """(image_id, low_*, high_*, mid_*, shadows_clipped, highlights_clipped) of 0..1 values:
    exact percentiles, and medians of the midtones after stretching (of all where there are
    32 or fewer)."""
    v = px.select("image_id", *((F.col(c) / 255.0).alias(c) for c in "rgb"))
    ends = v.groupBy("image_id").agg(*(F.percentile(c, F.array(F.lit(cut / 100), F.lit(1 - cut / 100))).alias(f"p_{c}") for c in "rgb"), F.avg((luma(cols(), BT601) < 0.02).cast("double")).alias("shadows_clipped"), F.avg((luma(cols(), BT601) > 0.98).cast("double")).alias("highlights_clipped"))
    s = v.join(ends, "image_id").withColumns({f"s_{c}": F.least(F.greatest((F.col(c) - F.col(f"p_{c}")[0]) / F.greatest(F.col(f"p_{c}")[1] - F.col(f"p_{c}")[0], F.lit(1e-3)), F.lit(0.0)), F.lit(1.0)) for c in "rgb"})
    y = luma(cols("s_"), BT601)
    s = s.withColumn("_mid", (y > 0.2) & (y < 0.8))
    mids = s.groupBy("image_id").agg(F.count_if("_mid").alias("n"), *(F.median(F.when(F.col("_mid"), F.col(f"s_{c}"))).alias(f"m_{c}") for c in "rgb"), *(F.median(f"s_{c}").alias(f"a_{c}") for c in "rgb"))
    out = ends.join(mids, "image_id")
    return out.select("image_id", *(F.col(f"p_{c}")[0].alias(f"low_{c}") for c in "rgb"), *(F.col(f"p_{c}")[1].alias(f"high_{c}") for c in "rgb"), *(F.when(F.col("n") > 32, F.col(f"m_{c}")).otherwise(F.col(f"a_{c}")).alias(f"mid_{c}") for c in "rgb"), "shadows_clipped", "highlights_clipped")


def ageing_evidence(level_rows: DataFrame) -> DataFrame:
    """Adds evidence: 0 for a good photo, 1 for a clearly faded or yellowed one."""
    low = F.greatest(*(F.col(f"low_{c}") for c in "rgb"))
    spread = F.greatest(*(F.col(f"high_{c}") for c in "rgb")) - F.least(*(F.col(f"high_{c}") for c in "rgb"))
    return level_rows.withColumn("evidence", F.least(F.greatest((low - 0.03) / 0.10, (spread - 0.10) / 0.15, F.lit(0.0)), F.lit(1.0)))


def light_level(lin: DataFrame) -> DataFrame:
    """(image_id, max_cll, max_fall) in cd/m2 of linear pixels."""
    high = F.greatest(*cols(), F.lit(0.0)) * 203.0
    return lin.groupBy("image_id").agg(F.max(high).alias("max_cll"), F.avg(high).alias("max_fall"))


def peak(lin: DataFrame) -> DataFrame:
    return lin.groupBy("image_id").agg(F.greatest(F.max(F.greatest(*cols())), F.lit(0.0)).alias("peak"))


def neutrality(px: DataFrame, tolerance: int = 1) -> DataFrame:
    """(image_id, spread, neutral): whether channels differ by at most ``tolerance``."""
    spread = F.max(F.greatest(*cols()) - F.least(*cols()))
    return px.groupBy("image_id").agg(spread.alias("spread")).withColumn("neutral", F.col("spread") <= tolerance)


def error_and_bias(a: DataFrame, b: DataFrame, col: str, most: int | None = None) -> DataFrame:
    """(image_id, error, bias) of two versions of pictures, from all pixels; ``most`` takes a
    grid of rows and columns instead in pictures of more than four times as many pixels."""
    own = a.select("image_id", "y", "x", F.col(col).alias("_a"))
    if most is not None:
        step = own.groupBy("image_id").agg(F.greatest(F.floor(F.sqrt(F.count("*") / float(most))), F.lit(1)).alias("_step"))
        own = own.join(step, "image_id").where("y % _step = 0 and x % _step = 0")
    rows = own.join(b.select("image_id", "y", "x", F.col(col).alias("_b")), ["image_id", "y", "x"])
    return rows.groupBy("image_id").agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("error"), F.abs(F.avg("_a") - F.avg("_b")).alias("bias"))


def masked_correlation(rows: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(image_id, correlation) weighted by a mask; one pass of sums."""
    w, x, y = F.col(weight), F.col(a), F.col(b)
    s = rows.groupBy("image_id").agg(*(F.sum(e).alias(n) for n, e in (("w", w), ("x", w * x), ("y", w * y), ("xx", w * x * x), ("yy", w * y * y), ("xy", w * x * y))))
    mx, my = F.col("x") / F.col("w"), F.col("y") / F.col("w")
    cov, vx, vy = F.col("xy") / F.col("w") - mx * my, F.col("xx") / F.col("w") - mx * mx, F.col("yy") / F.col("w") - my * my
    return s.select("image_id", (cov / F.sqrt(F.greatest(vx * vy, F.lit(1e-12)))).alias("correlation"))


def recovery_adjustments(level_rows: DataFrame, fading: int, auto_colour: bool) -> DataFrame:
    """Adds the gentle adjustments (contrast, shadows, highlights, saturation) that follow the
    stretched levels of a faded photo; ends that were clipped get more. monochrome: a column."""
    t = min(100, max(0, fading)) / 100
    clipped = lambda c: F.col(c) > 0.02
    return level_rows.withColumns({
        "contrast": F.lit(6 * t), "shadows": F.when(clipped("shadows_clipped"), 14 * t).otherwise(6 * t),
        "highlights": F.when(clipped("highlights_clipped"), -16 * t).otherwise(-6 * t),
        "saturation": F.when(F.col("monochrome") | F.lit(not auto_colour), 0.0).otherwise(18 * t),
    })
