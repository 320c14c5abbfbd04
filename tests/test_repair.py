"""Repair operators and the plan builder."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.operators import filling, lighting, lines, repair
from photonframe.plans import pipeline
from photonframe.sources.relations import test_pattern as pattern


def pixels(spark, plane, name="v"):
    h, w = plane.shape
    return spark.createDataFrame([(0, y, x, float(plane[y, x])) for y in range(h) for x in range(w)], f"image_id long, y int, x int, {name} double")


def blurred(plane):
    """A 3 x 3 mean with edges repeated."""
    p = np.pad(plane, 1, mode="edge")
    return sum(p[a : a + plane.shape[0], b : b + plane.shape[1]] for a in range(3) for b in range(3)) / 9


def test_tiles_are_as_the_whole(spark):
    plane = np.random.default_rng(1).random((23, 31))
    got = np.zeros_like(plane)
    for r in repair.map_tiles(pixels(spark, plane), ["v"], lambda p: {"o": blurred(p["v"])}, ["o"], 4, tile=8).collect():
        got[r.y, r.x] = r.o
    assert np.abs(got - blurred(plane)).max() < 1e-9


def line_pixels(h, w, angle):
    """Digital lines of a picture, each as its pixels in order, drawn by stepping."""
    from math import floor, radians, tan

    out = {}
    flat = angle <= 45 or angle >= 135
    t = round(tan(radians(angle)), 12) if flat else round(1 / tan(radians(angle)), 12) if angle != 90 else 0.0
    for y in range(h):
        for x in range(w):
            key = y + floor(x * t + 0.5) if flat else x + floor(y * t + 0.5)
            out.setdefault(key, []).append((y, x))
    for own in out.values():
        own.sort(key=lambda p: p[1] if flat else p[0])
    return list(out.values())


@pytest.mark.parametrize("short", [0, 99])
@pytest.mark.parametrize("angle", lines.ANGLES)
def test_lines_at_every_angle(spark, monkeypatch, angle, short):
    """Against each line's pixels one by one, by frames and by running extremes alike."""
    monkeypatch.setattr(lines, "SHORT", short)
    plane = np.random.default_rng(3).integers(0, 50, (19, 23)).astype(float)
    ways = line_pixels(19, 23, angle)
    assert sorted(p for w in ways for p in w) == [(y, x) for y in range(19) for x in range(23)]
    for w in ways:  # neighbours touch
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(w, w[1:], strict=False))
    length = 7
    m = lines.steps(length // 2, angle)
    assert m == (3 if angle % 90 == 0 else 2 if angle % 45 == 0 else 3)

    def slide(values, f):
        return [f(values[max(0, i - m) : i + m + 1]) for i in range(len(values))]

    want = {}
    for w in ways:
        v = [plane[p] for p in w]
        for p, o, c in zip(w, slide(slide(v, min), max), slide(slide(v, max), min), strict=True):
            want[p] = o, c
    px = lines.opened_and_closed(pixels(spark, plane), "v", length, angle, "o", "c")
    assert {(r.y, r.x): (r.o, r.c) for r in px.collect()} == want
    assert not [n for n in ("Python", "Pandas", "Arrow") if n in px._jdf.queryExecution().executedPlan().toString()]
    sides = {}
    way = (angle + 90) % 180
    d = lines.steps(4, way)
    for w in line_pixels(19, 23, way):
        for i, p in enumerate(w):
            sides[p] = abs(plane[w[min(i + d, len(w) - 1)]] - plane[w[max(i - d, 0)]])
    assert {(r.y, r.x): r.s for r in lines.across(pixels(spark, plane), "v", 4, angle, "s").collect()} == sides


@pytest.mark.parametrize("seed", range(3))
def test_growth_by_steps(spark, seed):
    """Against a breadth-first search, in mazes."""
    r = np.random.default_rng(seed)
    allowed, seeds = r.random((20, 20)) < (0.35, 0.5, 0.7)[seed], r.random((20, 20)) < 0.02
    for most in (3, 12):
        far = {p: 0 for p in zip(*np.nonzero(allowed & seeds), strict=True)}
        edge = list(far)
        for step in range(1, most + 1):
            edge = [q for y, x in edge for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if 0 <= q[0] < 20 and 0 <= q[1] < 20 and allowed[q] and q not in far and not far.update({q: step})]
        frame = spark.createDataFrame([(7, int(y), int(x), bool(seeds[y, x])) for y, x in zip(*np.nonzero(allowed), strict=True)], "image_id long, y int, x int, seed boolean")
        assert {(p.y, p.x): p.far for p in lines.grow(frame, most).collect()} == {(int(y), int(x)): d for (y, x), d in far.items()}
    assert lines.grow(frame.limit(0), 5).collect() == []


def pyramid(plane, mask):
    """The filling again, level by level on arrays."""
    h, w = plane.shape
    top = max(1, (max(h, w) - 1).bit_length())
    levels = {}
    for k in range(1, top + 1):
        n = 1 << k
        for y in range(-(-h // n)):
            for x in range(-(-w // n)):
                block, bad = plane[y * n : (y + 1) * n, x * n : (x + 1) * n], mask[y * n : (y + 1) * n, x * n : (x + 1) * n]
                good = block[bad == 0]
                levels[k, y, x] = (min(1, 4 * len(good) / block.size), good.mean() if len(good) else None)
    filled = {}

    def above(k, y, x):
        parts = [(9, y // 2, x // 2), (3, y // 2, x // 2 + (1 if x % 2 else -1)), (3, y // 2 + (1 if y % 2 else -1), x // 2), (1, y // 2 + (1 if y % 2 else -1), x // 2 + (1 if x % 2 else -1))]
        there = [(w_, filled[k, a, b]) for w_, a, b in parts if filled.get((k, a, b)) is not None]
        return sum(w_ * v for w_, v in there) / sum(w_ for w_, _ in there) if there else None

    for k in range(top, 0, -1):
        for (level, y, x), (share, mean) in levels.items():
            if level == k:
                up = above(k + 1, y, x) if k < top else None
                filled[k, y, x] = mean if up is None or share == 1 else up if mean is None else share * mean + (1 - share) * up
    out = plane.copy()
    for y, x in zip(*np.nonzero(mask), strict=True):
        v = above(1, y, x)
        out[y, x] = plane[y, x] if v is None else v
    return out


@pytest.mark.parametrize("shape", [(16, 16), (13, 21), (1, 9), (40, 7)])
def test_filling(spark, shape):
    r = np.random.default_rng(shape[1])
    plane, mask = r.random(shape), (r.random(shape) < 0.2).astype(float)
    mask[: shape[0] * 3 // 4, : shape[1] // 2] = 1  # a hole far wider than any kernel
    px = pixels(spark, plane).join(pixels(spark, mask, "m"), ["image_id", "y", "x"])
    got = np.zeros(shape)
    for p in filling.fill(px, "m", ["v"]).collect():
        got[p.y, p.x] = p.v
    assert np.abs(got - pyramid(plane, mask)).max() < 1e-9 and (got[mask == 0] == plane[mask == 0]).all()


def test_filling_edges(spark):
    flat = np.full((12, 12), 0.4)
    mask = np.zeros((12, 12))
    mask[2:11, 2:11] = 1
    px = pixels(spark, flat).join(pixels(spark, mask, "m"), ["image_id", "y", "x"])
    assert all(abs(p.v - 0.4) < 1e-12 for p in filling.fill(px, "m", ["v"]).collect())
    grainy = [p.v - 0.4 for p in filling.fill(px, "m", ["v"], grain=0.05).collect() if mask[p.y, p.x]]
    assert 0.02 < np.std(grainy) < 0.09 and abs(np.mean(grainy)) < 0.03
    lost = px.withColumn("m", F.lit(1))
    assert {p.v for p in filling.fill(lost, "m", ["v"]).collect()} == {0.4}  # nothing to fill from
    odd = px.withColumn("m", F.lit(None).cast("int")).withColumn("v", F.when(F.col("y") == 5, F.lit(None)).otherwise(F.col("v")))
    assert all(abs(p.v - 0.4) < 1e-12 for p in filling.fill(odd, "m", ["v"]).collect())


def test_specks_go_and_edges_stay(spark):
    plane = np.full((32, 32), 0.5)
    plane[:, 20:] = 0.8
    plane[8, 8], plane[25, 9] = 1.0, 0.25
    rows = repair.remove_specks(pixels(spark, plane), "v", 5, 0.2, 0.2, 10).collect()
    hits = {(r.y, r.x) for r in rows if r.hit}
    assert hits == {(8, 8), (25, 9)}
    assert all(abs(r.fixed - (0.5 if r.x < 20 else 0.8)) < 1e-6 for r in rows)
    dark = {(r.y, r.x) for r in repair.remove_specks(pixels(spark, plane), "v", 5, 0.2, 0.3, 10).collect() if r.hit}
    assert dark == {(8, 8)}  # thresholds of their own


def test_scratches_go_and_edges_stay(spark):
    plane = np.full((48, 48), 0.4)
    plane[:, 36:] = 0.7  # an edge has different sides
    plane[20, 2:34] = 0.9
    plane[20, 5:10] = 0.48  # fainter for a while
    rows = repair.remove_scratches(pixels(spark, plane), "v", 3, 17, 0.1, 0.2).collect()
    hits = {(r.y, r.x) for r in rows if r.hit}
    assert hits and all(y == 20 for y, _ in hits) and {x for _, x in hits} >= set(range(4, 32))
    assert all(abs(r.fixed - (0.4 if r.x < 36 else 0.7)) < 1e-6 for r in rows if 4 <= r.x <= 30 or r.x >= 38)


def test_cleaning_at_strengths(spark):
    """A photo with white dust and a white scratch; strengths, grain and resolution count."""
    r = np.random.default_rng(8)
    photo = 110 + 20 * np.sin(np.arange(64)[:, None] / 9) + r.normal(0, 1, (64, 64))
    dusty = photo.copy()
    for _ in range(6):
        y, x = r.integers(4, 60, 2)
        dusty[y : y + 2, x : x + 2] = 235
    dusty[30, 8:56] = 225
    px = pixels(spark, np.rint(dusty)).select("image_id", "y", "x", *(F.col("v").cast("int").alias(c) for c in "rgb"))

    def left(frame):
        return max(abs(p.r - photo[p.y, p.x]) for p in frame.collect())

    assert left(px) > 100
    done = repair.clean(repair.clean(px, "specks", 60, 0.005), "scratches", 60, 0.005)
    assert left(done) < 25 and done.columns == px.columns
    assert repair.clean(px, "specks", 0) is px
    assert left(repair.clean(px, "specks", 60, 0.2)) > 100  # as strong as the grain: kept
    both = px.unionByName(px.withColumns({"image_id": F.lit(1).cast("long"), "x": F.col("x") + 3000}))  # a wide picture has larger defects
    assert repair.clean(both, "specks", 50).count() == 2 * 64 * 64


def test_good_levels_are_kept_and_faded_ones_stretched(spark):
    ramp = spark.range(256).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), *(F.col("id").cast("int").alias(c) for c in "rgb"))
    same = repair.restore_levels(ramp, 0, True).where("abs(r - x) > 2").count()
    assert same == 0
    faded = ramp.withColumns({c: (60 + F.col(c) * 0.4).cast("int") for c in "rgb"})
    got = repair.restore_levels(faded, 100, False).agg(F.min("r"), F.max("r")).first()
    assert got[0] <= 2 and got[1] >= 253
    assert repair.restore_levels(ramp, 0, False) is ramp


def test_builder_keeps_the_order_and_drops_what_does_nothing(spark):
    options = pipeline.Options(fading=10, denoise=20, finish="clean", lighting=lighting.PROFILES["vivid"], look=lighting.LOOKS["sony-vivid"], scale=2, hdr="dramatic")
    assert [n for n, _ in pipeline.build(options)] == ["denoise", "levels", "finish", "lighting", "look", "upscale", "hdr", "look finish"]
    options = pipeline.Options(scratches=5, dust=10, fading=10, sharpness=3, scale=2)
    assert [n for n, _ in pipeline.build(options)] == ["specks", "scratches", "levels", "upscale", "sharpen"]
    assert pipeline.build(pipeline.Options()) == []
    px = pattern(spark.range(1).selectExpr("id as image_id", "8 as size"))
    assert pipeline.run(px, pipeline.Options()) is px
    assert pipeline.run(px, pipeline.Options(scale=3)).count() == 9 * 64
    for bad in (pipeline.Options(scale=5), pipeline.Options(hdr="x"), pipeline.Options(finish="x")):
        with pytest.raises(ValueError):
            pipeline.build(bad)
