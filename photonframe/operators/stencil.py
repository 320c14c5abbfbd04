"""Neighbourhood operators on pixel relations as window frames.

Every separable operator is two windows, along rows and along columns, partitioned by
picture and line, so a task holds lines, never pictures. Borders: "clip" averages over what
is inside, "replicate" repeats the edge."""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.functions.pixel import clip, cols, luma, luma8

AXES = (("y", "x"), ("x", "y"))  # line, place in it


def line(axis: tuple[str, str]):  # type: ignore[no-untyped-def]
    return Window.partitionBy("image_id", axis[0]).orderBy(axis[1])


WHOLE = 1 << 18  # pixels of a picture up to which a task takes all of it
TASK = 1 << 16  # pixels that a task gets, or a picture more


def by_picture(px: DataFrame, growth: int = 1) -> DataFrame:
    """Pixels dealt by picture, so that windows along lines at any angle find their lines where
    they are: one exchange for all of them, and tasks of the same size however many pictures
    there are. Where a picture has more than ``WHOLE`` pixels they stay where they are, and each
    window deals lines. ``growth``: how many pixels will come of each before the windows."""
    each = px.groupBy("image_id").agg(F.count("*").alias("n"))
    most, total, pictures = each.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    if not total or most * growth > WHOLE:
        return px
    tasks = max(ceil(total * growth / TASK), px.sparkSession.sparkContext.defaultParallelism)
    return px.repartition(min(tasks, pictures), "image_id")


def box_means(df: DataFrame, columns: dict[str, str], radius: int, replicate: bool = False) -> DataFrame:
    """Means of several columns (name to source) over the (2r+1)^2 window, all along one axis
    and then all along the other, so that the pixels are dealt twice however many columns
    there are. Only the part inside the picture counts; with ``replicate`` edges are repeated:
    the frame's sum, and the first and last value of the line for what the frame lacks."""
    sums = {out: F.col(source) for out, source in columns.items()}
    if not replicate:
        df = df.withColumn("_n", F.lit(1))
        for axis in AXES:  # sums and counts, not means of means: exact for integers
            frame = line(axis).rowsBetween(-radius, radius)
            df = df.withColumns({**{out: F.sum(c).over(frame) for out, c in sums.items()}, "_n": F.sum("_n").over(frame)})
            sums = {out: F.col(out) for out in columns}
        return df.withColumns({out: F.col(out) / F.col("_n") for out in columns}).drop("_n")
    for axis in AXES:
        ordered = line(axis)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({"_at": F.row_number().over(ordered) - 1, "_n": F.count("*").over(whole)})
        low, high = F.greatest(radius - F.col("_at"), F.lit(0)), F.greatest(F.col("_at") + radius - (F.col("_n") - 1), F.lit(0))
        total = {out: F.sum(c).over(ordered.rowsBetween(-radius, radius)) + low * F.first(c).over(whole) + high * F.last(c).over(whole) for out, c in sums.items()}
        df = df.withColumns(total).drop("_at", "_n")
        sums = {out: F.col(out) for out in columns}
    return df.withColumns({out: F.col(out) / float((2 * radius + 1) ** 2) for out in columns})


def box_clip(df: DataFrame, col: str, radius: int, out: str | None = None) -> DataFrame:
    """Mean over the part of the (2r+1)^2 window that is inside the picture."""
    return box_means(df, {out or col: col}, radius)


def box_replicate(df: DataFrame, col: str, radius: int, out: str | None = None) -> DataFrame:
    """Mean over the window with edges repeated."""
    return box_means(df, {out or col: col}, radius, replicate=True)


def extreme(df: DataFrame, col: str, size: tuple[int, int], largest: bool, out: str | None = None) -> DataFrame:
    """Dilation (largest) or erosion with a rectangle of odd (height, width)."""
    out = out or col
    for axis, n in zip(AXES, (size[1], size[0]), strict=True):
        f = F.max if largest else F.min
        df = df.withColumn(out, f(col if axis is AXES[0] else out).over(line(axis).rowsBetween(-(n // 2), n // 2)))
    return df


def opening(df: DataFrame, col: str, size: tuple[int, int], out: str) -> DataFrame:
    return extreme(extreme(df, col, size, False, out), out, size, True)


def closing(df: DataFrame, col: str, size: tuple[int, int], out: str) -> DataFrame:
    return extreme(extreme(df, col, size, True, out), out, size, False)


def kernel(sigma: float) -> list[float]:
    r = max(1, ceil(3 * sigma))
    k = [exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(k) for v in k]


def gaussian(df: DataFrame, col: str, sigma: float, out: str | None = None) -> DataFrame:
    """Separable Gaussian of three sigma, edges reflected (repeated in lines that are too
    short for it). The frame of a pixel holds all it needs, reflected values too, so a pixel
    carries 2r + 1 values, never its line."""
    out = out or col
    k = kernel(sigma)
    r = len(k) // 2
    for axis in AXES:
        source = col if axis is AXES[0] else out
        w = line(axis)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({"_v": F.collect_list(source).over(w.rowsBetween(-r, r)), "_n": F.count("*").over(whole), "_at": F.row_number().over(w) - 1})
        n, at = F.col("_n"), F.col("_at")

        def value(i: int) -> Column:
            j = at + i
            reflected = F.when(j < 0, -j).when(j > n - 1, 2 * (n - 1) - j).otherwise(j)
            repeated = F.least(F.greatest(j, F.lit(0)), n - 1)
            place = F.when(n > r, reflected).otherwise(repeated) - F.greatest(at - r, F.lit(0))
            return F.element_at("_v", (place + 1).cast("int"))

        total = value(-r) * k[0]
        for i in range(-r + 1, r + 1):
            total = total + value(i) * k[i + r]
        df = df.withColumn(out, total).drop("_v", "_n", "_at")
    return df


def guided(df: DataFrame, guide: str, sources: dict[str, str], radius: int, eps: float, replicate: bool = False, at: str | None = None) -> DataFrame:
    """Guided filter: local linear models of several columns (name to source) in ``guide``,
    evaluated there or at another column. All of them together deal the pixels four times."""
    g = F.col(guide).cast("double")
    df = df.withColumns({"_i": g, "_ii": g * g, **{f"_p_{o}": F.col(s).cast("double") for o, s in sources.items()}, **{f"_q_{o}": g * F.col(s).cast("double") for o, s in sources.items()}})
    df = box_means(df, {c: c for c in ("_i", "_ii", *(f"_{k}_{o}" for k in "pq" for o in sources))}, radius, replicate)
    spread = F.greatest(F.col("_ii") - F.col("_i") * F.col("_i"), F.lit(0.0)) + eps
    df = df.withColumns({f"_q_{o}": (F.col(f"_q_{o}") - F.col("_i") * F.col(f"_p_{o}")) / spread for o in sources})
    df = df.withColumns({f"_p_{o}": F.col(f"_p_{o}") - F.col(f"_q_{o}") * F.col("_i") for o in sources})
    df = box_means(df, {c: c for c in (f"_{k}_{o}" for k in "pq" for o in sources)}, radius, replicate)
    return df.withColumns({o: F.col(f"_q_{o}") * F.col(at or guide) + F.col(f"_p_{o}") for o in sources}).drop("_i", "_ii", *(f"_{k}_{o}" for k in "pq" for o in sources))


def paeth(df: DataFrame, col: str, out: str) -> DataFrame:
    """PNG's Paeth residue of 8-bit samples: value minus the best of left, up, up-left."""
    across, down = line(AXES[0]), line(AXES[1])
    df = df.withColumn("_up", F.coalesce(F.lag(col).over(down), F.lit(0)))
    df = df.withColumns({"_left": F.coalesce(F.lag(col).over(across), F.lit(0)), "_corner": F.coalesce(F.lag("_up").over(across), F.lit(0))})
    a, b, c = F.col("_left"), F.col("_up"), F.col("_corner")
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    best = F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)
    return df.withColumn(out, F.pmod(F.col(col) - best, F.lit(256))).drop("_up", "_left", "_corner")


def noise_aware_sharpen(df: DataFrame, amount: float, sigma: float, floor: float, margin: float = 0.03) -> DataFrame:
    """Unsharp mask on luma of 0..1 channels: small detail stays, no halo beyond the local
    range."""
    df = df.withColumn("_y", luma(cols(), (0.299, 0.587, 0.114)))
    df = gaussian(df, "_y", sigma, "_blur")
    df = extreme(extreme(df, "_y", (3, 3), False, "_low"), "_y", (3, 3), True, "_high")
    detail = F.col("_y") - F.col("_blur")
    sharp = F.col("_y") + amount * F.signum(detail) * F.greatest(F.abs(detail) - floor, F.lit(0.0))
    sharp = F.least(F.greatest(sharp, F.col("_low") - margin), F.col("_high") + margin)
    return df.withColumn("_d", sharp - F.col("_y")).withColumns({c: F.col(c) + F.col("_d") for c in "rgb"}).drop("_y", "_blur", "_low", "_high", "_d")


def clarity(df: DataFrame, amount: float, sigma: float) -> DataFrame:
    """Midtone contrast of 0..1 channels against a wide blur."""
    df = gaussian(df.withColumn("_y", luma(cols(), (0.299, 0.587, 0.114))), "_y", sigma, "_blur")
    y = F.col("_y")
    df = df.withColumn("_d", amount * 4 * y * (1 - y) * (y - F.col("_blur")))
    return df.withColumns({c: F.col(c) + F.col("_d") for c in "rgb"}).drop("_y", "_blur", "_d")


def denoise(df: DataFrame, strength: float, noise: float) -> DataFrame:
    """Edge-preserving smoothing of luma and, wider, of chroma (0..1 channels)."""
    t = min(1.0, max(0.0, strength / 100))
    radius = max(1, round(1 + 2 * t))
    eps = ((1.2 + 1.8 * t) * max(noise, 0.004)) ** 2
    df = df.withColumn("_y", luma(cols(), (0.299, 0.587, 0.114)))
    df = guided(df, "_y", {"_smooth": "_y"}, radius, eps)
    df = df.withColumns({f"_c{c}": F.col(c) - F.col("_y") for c in "rgb"})
    df = guided(df, "_y", {f"_s{c}": f"_c{c}" for c in "rgb"}, 2 * radius, 0.03**2)
    new = F.col("_y") + 0.85 * t * (F.col("_smooth") - F.col("_y"))
    out = {c: new + F.col(f"_c{c}") + t * (F.col(f"_s{c}") - F.col(f"_c{c}")) for c in "rgb"}
    return df.withColumns(out).drop("_y", "_smooth", *(f"_{k}{c}" for k in "cs" for c in "rgb"))


def _bounded_gain(gain: Column, room: Column) -> Column:
    """A gain that follows the wish while it is small and never reaches the room there is:
    the two in the fourth-power mean."""
    share = gain / F.greatest(room, F.lit(1e-6))
    return gain / F.sqrt(F.sqrt(1 + F.pow(share, F.lit(4.0))))


def hdr_tone(df: DataFrame, shadows: float, highlights: float, local: float, detail: float, colour: float, vibrance: float, radius: int, side: int) -> DataFrame:
    """Local tone mapping of 8-bit pixels of pictures whose longer side is ``side``.

    Luminance is split into a guided base, what a fine blur leaves above it (middle) and what
    the blur takes (fine). The base takes the tone curve; middle and fine are added back,
    strengthened beyond the noise floor, the middle less where it is an edge. The change stays
    inside the room to black or white, colour follows the luminance, and a dither hides steps."""
    from photonframe.functions.pixel import BT709, dither

    floor, knee = 1.5 / 255, 0.08
    strong = lambda d: F.signum(d) * F.greatest(F.abs(d) - floor, F.lit(0.0))
    split = df.withColumn("_l8", luma8(cols()) / 255.0)
    split = gaussian(split, "_l8", max(1.0, 0.0008 * side), "_blur")
    split = split.withColumn("_blur", F.floor(F.col("_blur") * 255 + 0.5) / 255.0)  # in whole levels
    split = guided(split, "_l8", {"_base": "_l8"}, radius, 0.012, replicate=True, at="_blur")
    split = split.withColumns({f"_{c}": F.col(c) / 255.0 for c in "rgb"})
    split = split.withColumns({"_v": luma(cols("_"), BT709), "_base": clip(F.col("_base"))})
    base, v = F.col("_base"), F.col("_v")
    layers = split.withColumns({"_toned": base + shadows * base * (1 - base) ** 2 - highlights * base**2 * (1 - base), "_mid": F.col("_blur") - base, "_fine": v - F.col("_blur")})
    toned, mid, fine = (F.col(c) for c in ("_toned", "_mid", "_fine"))
    lifted = mid + 4 * toned * (1 - toned) * local / (1 + (mid / knee) ** 2) * strong(mid) + fine + detail * strong(fine)
    wish = layers.withColumn("_wish", toned + lifted - v)
    bounded = wish.withColumn("_new", v + F.when(F.col("_wish") > 0, _bounded_gain(F.col("_wish"), 1 - v)).otherwise(-_bounded_gain(-F.col("_wish"), v)))
    chroma = bounded.withColumns({f"_{c}": F.col(f"_{c}") - v for c in "rgb"})
    high, low, new = F.greatest(*cols("_")), F.least(*cols("_")), F.col("_new")
    follow = F.least(F.pow((new + 0.02) / (v + 0.02), F.lit(colour)), F.lit(2.0)) * (1 + vibrance * (1 - 0.5 * (high - low)))
    room = F.least((1 - new) / F.greatest(high, F.lit(1e-6)), new / F.greatest(-low, F.lit(1e-6)))
    scaled = chroma.withColumns({"_follow": follow, "_room": room}).withColumn("_k", _bounded_gain(F.col("_follow"), F.col("_room")))
    step = dither(F.col("x"), F.col("y"))
    done = scaled.withColumns({c: F.floor(F.least(F.greatest((F.col(f"_{c}") * F.col("_k") + new) * 255 + step + 0.5, F.lit(0.0)), F.lit(255.0))).cast("int") for c in "rgb"})
    return done.select(*df.columns)
