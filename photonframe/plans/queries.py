"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.functions import colour, pixel, settings
from photonframe.functions.pixel import cols, luma8
from photonframe.functions.stored import shared_path, stored
from photonframe.operators import faces, gainmap, jobs, joins, lighting, lines, networks, repair, resample, stats, stencil
from photonframe.plans import hdr, pipeline
from photonframe.sources import formats, pictures, samples
from photonframe.sources.relations import px_grey8, px_rgb64, spread, table, test_pattern
from photonframe.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BANDS_SATURATION = {"red": 10.0, "orange": -5.0, "yellow": 0.0, "green": 20.0, "aqua": 15.0, "blue": -10.0, "purple": 5.0, "magenta": 0.0}
MONO = lighting.Look(monochrome=100, mix=(0.4, 0.4, 0.2), rolloff=40)


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        # Formulas of many steps make methods that the JVM does not compile; Spark then calls
        # its projections, which are split, one by one.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        return f(spark, d)

    QUERIES[f.__name__] = run
    return run


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def squares(px: DataFrame) -> DataFrame:
    """Pictures with all 64 x 64 pixels; those that are not there are black."""
    every = px.select("image_id").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(4095)))).select("image_id", F.expr("p div 64").cast("int").alias("y"), (F.col("p") % 64).alias("x"))
    return every.join(px, ["image_id", "y", "x"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in "rgb"})


def linear(px: DataFrame, gain: float = 1.0) -> DataFrame:
    """8-bit pixels as linear BT.2020."""
    m = colour.conversion_matrix("bt709", "bt2020")
    px = px.withColumns({c: colour.srgb_eotf(F.col(c) / 255.0) * gain for c in "rgb"})
    return px.withColumns(dict(zip("rgb", colour.apply_matrix(cols(), m), strict=True)))


# ---- pixels, one by one
@query
def lighting_embeddings_8x8(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: contrast and shadows, quantised, 5 x 5 mean, statistics of each picture."""
    px = px_grey8(spark, d)
    px = px.withColumns({c: F.col("l") for c in "rgb"})
    px = lighting.apply_lighting(px, lighting.Adjustments(contrast=40, shadows=25))
    px = stencil.box_clip(px, "r", 2, "mean").withColumn("mean8", F.floor(F.col("mean") + 0.5).cast("int"))
    return px.groupBy("image_id").agg(F.min("mean8").alias("lowest"), F.max("mean8").alias("highest"), F.round(F.avg("r"), 6).alias("level"), F.count("*").alias("n"))


@query
def lighting_cinematic(spark: SparkSession, d: str) -> DataFrame:
    return lighting.apply_profile(px_rgb64(spark, d), "cinematic")


@query
def lighting_low_light_half(spark: SparkSession, d: str) -> DataFrame:
    return lighting.apply_profile(px_rgb64(spark, d), "low-light-recovery", 50)


@query
def lighting_neutral(spark: SparkSession, d: str) -> DataFrame:
    """A neutral stage leaves no trace in the plan."""
    return lighting.apply_profile(px_rgb64(spark, d), "original")


@query
def look_sony_cinematic(spark: SparkSession, d: str) -> DataFrame:
    return lighting.apply_look(spread(px_rgb64(spark, d)), lighting.LOOKS["sony-cinematic"])


@query
def look_leica_monochrome(spark: SparkSession, d: str) -> DataFrame:
    return lighting.apply_look(spread(px_rgb64(spark, d)), lighting.LOOKS["leica-monochrome"])


@query
def look_velvia_half(spark: SparkSession, d: str) -> DataFrame:
    return lighting.apply_look(spread(px_rgb64(spark, d)), lighting.LOOKS["fujifilm-velvia"].scaled(0.5))


@query
def look_finished(spark: SparkSession, d: str) -> DataFrame:
    """Sharpening and grain, as after the last stage of a job."""
    return lighting.finish_look(px_rgb64(spark, d), lighting.Look(sharpen=40, grain=60))


@query
def look_monochrome(spark: SparkSession, d: str) -> DataFrame:
    return lighting.apply_look(px_rgb64(spark, d), MONO)


@query
def hue_bands(spark: SparkSession, d: str) -> DataFrame:
    """Range join of hues with the intervals of the colour wheel."""
    px = px_rgb64(spark, d)
    high, chroma = F.greatest(*cols()), F.greatest(*cols()) - F.least(*cols())
    px = px.select("image_id", "y", "x", pixel.hue(tuple(c / 255.0 for c in cols()), high / 255.0, chroma / 255.0).alias("hue"))  # type: ignore[arg-type]
    wheel = spark.createDataFrame([(float(h), BANDS_SATURATION[n]) for n, h in lighting.BAND_HUES.items()], "hue double, value double")
    out = rounded(joins.interpolate(px, "hue", joins.bracket(wheel, "hue", "value", 360.0), "value"), "hue", "value", digits=5)
    return out.withColumn("value", F.col("value") + 0.0)  # no negative zero


@query
def grain_and_dither(spark: SparkSession, d: str) -> DataFrame:
    px = px_rgb64(spark, d)
    x, y = F.col("x"), F.col("y")
    return px.select("image_id", "y", "x", pixel.hash32(x, y, pixel.GRAIN_SEED).alias("hash"), F.round(pixel.dither(x, y), 6).alias("dither"), F.round(pixel.grain(x, y, 2.5), 6).alias("grain"))


@query
def orientation(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each picture turned by an EXIF orientation that its number gives."""
    px = px_rgb64(spark, d).withColumn("code", (F.col("image_id") % 8 + 1).cast("int"))
    at = pixel.orient(F.col("code"), F.col("y"), F.col("x"), F.lit(64), F.lit(64))
    return px.select("image_id", "code", at["y"].alias("y"), at["x"].alias("x"), luma8(cols()).alias("l"))


@query
def flatten_alpha(spark: SparkSession, d: str) -> DataFrame:
    return px_rgb64(spark, d).select("image_id", "y", "x", *(pixel.over(F.col(c), F.col("x") * 4, 255.0).alias(c) for c in "rgb"))


# ---- colour science
@query
def pq_codes(spark: SparkSession, d: str) -> DataFrame:
    """sRGB to linear BT.2020 to PQ, as 10-bit Y'CbCr."""
    px = linear(px_rgb64(spark, d)).withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in "rgb"})
    px = px.withColumns({c: colour.pq_encode(F.col(c) * colour.WHITE) for c in "rgb"})
    y, cb, cr = colour.ycbcr10(cols())
    return px.select("image_id", "y", "x", y.alias("luma"), cb.alias("cb"), cr.alias("cr"))


@query
def pq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    nits = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(colour.pq_encode(nits), 6).alias("signal"), F.round(colour.pq_decode(colour.pq_encode(nits)), 4).alias("nits"))


@query
def hlg_signal(spark: SparkSession, d: str) -> DataFrame:
    px = linear(px_rgb64(spark, d)).withColumns({c: F.greatest(F.col(c), F.lit(0.0)) * 203.0 for c in "rgb"})
    return px.select("image_id", "y", "x", *(F.round(c, 6).alias(n) for c, n in zip(colour.hlg_encode(cols()), "rgb", strict=True)))


@query
def sdr_preview(spark: SparkSession, d: str) -> DataFrame:
    """HDR of four times reference white, rolled off, to BT.709, fitted and sRGB-encoded."""
    px = linear(spread(px_rgb64(spark, d)), 4.0)
    px = px.withColumn("_k", colour.eetf_ratio(F.greatest(*cols()), 812.0, 203.0)).withColumns({c: F.col(c) * F.col("_k") for c in "rgb"})
    px = px.withColumns(dict(zip("rgb", colour.apply_matrix(cols(), colour.conversion_matrix("bt2020", "bt709")), strict=True)))
    px = px.withColumns(dict(zip("rgb", colour.fit_gamut(cols(), pixel.BT709), strict=True)))
    px = px.withColumns(dict(zip("rgb", colour.fit_high(cols()), strict=True)))
    return px.select("image_id", "y", "x", *(pixel.quantise(colour.srgb_oetf(F.col(c))).alias(c) for c in "rgb"))


@query
def proxy_curve(spark: SparkSession, d: str) -> DataFrame:
    """Forward and back through the 16-bit proxy, with each picture's peak."""
    px = linear(px_rgb64(spark, d), 4.0).withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in "rgb"})
    px = px.join(stats.peak(px), "image_id").withColumn("m", F.greatest(*cols()))
    code = F.rint(F.col("m") * colour.proxy_ratio(F.col("m"), F.col("peak")) * 65535)
    px = px.select("image_id", "y", "x", "peak", code.cast("int").alias("code"))
    back = F.col("code") / 65535.0
    return px.select("image_id", "y", "x", "code", F.round(back * colour.proxy_inverse_ratio(back, F.col("peak")), 6).alias("back"))


@query
def hdr_through_model(spark: SparkSession, d: str) -> DataFrame:
    """PQ codes of BT.709 pictures through a model that doubles the size, back to PQ codes."""
    px = px_rgb64(spark, d).na.fill(0).withColumns({c: F.col(c) * 180 for c in "rgb"})
    lin = hdr.decode(px, F.lit(hdr.PQ), F.lit(1))
    return hdr.encode(hdr.through(lin, lambda codes: resample.nearest(codes, 2)))


@query
def expand_highlights(spark: SparkSession, d: str) -> DataFrame:
    px = px_rgb64(spark, d).withColumns({c: colour.srgb_eotf(F.col(c) / 255.0) for c in "rgb"})
    k = colour.expand_ratio(F.greatest(*cols()), 4.926, 0.5)
    return px.withColumn("_k", k).select("image_id", "y", "x", *(F.round(F.col(c) * F.col("_k"), 6).alias(c) for c in "rgb"))


@query
def gain_map(spark: SparkSession, d: str) -> DataFrame:
    """4 x 4 means of the log2 ratio of expanded to plain light."""
    px = px_rgb64(spark, d).withColumns({c: colour.srgb_eotf(F.col(c) / 255.0) for c in "rgb"})
    high = F.greatest(*cols())
    px = px.withColumn("ratio", F.log2((high * colour.expand_ratio(high, 4.0, 0.5) + 1 / 64) / (high + 1 / 64)))
    return rounded(resample.block_reduce(px, 4, ["ratio"]), "ratio")


# ---- statistics
@query
def luma_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.luma_bins(px_rgb64(spark, d)), "mean_cb", "mean_cr")


@query
def monochrome(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.monochrome(px_rgb64(spark, d)), "colorfulness", "tint")


@query
def noise_estimate(spark: SparkSession, d: str) -> DataFrame:
    px = px_grey8(spark, d).withColumn("v", F.col("l") / 255.0)
    return rounded(stats.noise_level(px, "v"), "noise")


@query
def picture_levels(spark: SparkSession, d: str) -> DataFrame:
    out = stats.ageing_evidence(stats.levels(px_rgb64(spark, d)))
    return rounded(out, *(c for c in out.columns if c != "image_id"))


@query
def light_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.light_level(linear(px_rgb64(spark, d), 2.0)), "max_cll", "max_fall", digits=5)


@query
def block_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.block_reduce(px_rgb64(spark, d), 4, ["r", "g", "b"]), "r", "g", "b")


@query
def neutral_pictures(spark: SparkSession, d: str) -> DataFrame:
    return stats.neutrality(px_rgb64(spark, d))


@query
def error_and_bias(spark: SparkSession, d: str) -> DataFrame:
    """Of a lit version against the original."""
    px = px_rgb64(spark, d)
    lit = px.withColumn("g", F.least(F.col("g") + F.col("x") % 3, F.lit(255)))
    return rounded(stats.error_and_bias(px, lit, "g"), "error", "bias")


@query
def masked_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.masked_correlation(px_rgb64(spark, d).withColumn("w", F.col("x") / 64.0), "r", "b", "w"), "correlation")


# ---- neighbourhoods
@query
def box_clipped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.box_clip(px_grey8(spark, d), "l", 2, "mean"), "mean")


@query
def box_replicated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.box_replicate(px_grey8(spark, d), "l", 2, "mean"), "mean")


@query
def local_range(spark: SparkSession, d: str) -> DataFrame:
    px = stencil.extreme(px_grey8(spark, d), "l", (3, 3), False, "low")
    return stencil.extreme(px, "l", (3, 3), True, "high")


@query
def line_opening(spark: SparkSession, d: str) -> DataFrame:
    """Openings and closings with horizontal and vertical lines."""
    px = stencil.opening(px_grey8(spark, d), "l", (1, 5), "opened")
    return stencil.closing(px, "l", (5, 1), "closed")


@query
def gaussian(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.gaussian(px_grey8(spark, d), "l", 0.8, "blurred"), "blurred")


@query
def paeth_residue(spark: SparkSession, d: str) -> DataFrame:
    return stencil.paeth(px_grey8(spark, d), "l", "residue")


@query
def guided_filter(spark: SparkSession, d: str) -> DataFrame:
    px = px_grey8(spark, d).withColumn("v", F.col("l") / 255.0)
    return rounded(stencil.guided(px, "v", {"base": "v"}, 1, 0.012).drop("v"), "base")


@query
def hdr_balanced(spark: SparkSession, d: str) -> DataFrame:
    return stencil.hdr_tone(px_rgb64(spark, d), 0.9, 0.8, 0.6, 0.1, 0.55, 0.08, 3, 64)


@query
def sharpened(spark: SparkSession, d: str) -> DataFrame:
    px = px_grey8(spark, d).withColumns({c: F.col("l") / 255.0 for c in "rgb"})
    return stencil.noise_aware_sharpen(px, 0.7, 0.9, 0.006).select("image_id", "y", "x", F.round("r", 6).alias("v"))


@query
def denoised(spark: SparkSession, d: str) -> DataFrame:
    px = px_grey8(spark, d).withColumns({"r": F.col("l") / 255.0, "g": F.col("l") / 300.0, "b": F.col("l") / 400.0})
    return stencil.denoise(px, 50, 0.02).select("image_id", "y", "x", *(F.round(c, 5).alias(c) for c in "rgb"))


@query
def clarity(spark: SparkSession, d: str) -> DataFrame:
    px = px_grey8(spark, d).withColumns({c: F.col("l") / 255.0 for c in "rgb"})
    return stencil.clarity(px, 0.3, 1.0).select("image_id", "y", "x", F.round("g", 6).alias("v"))


# ---- resampling and tiles
@query
def nearest_twice(spark: SparkSession, d: str) -> DataFrame:
    return resample.nearest(px_grey8(spark, d), 2)


@query
def bilinear_up(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.bilinear_grid(px_grey8(spark, d), ["l"], 8, 8, 20, 12), "l")


@query
def lanczos_down(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.resize(px_grey8(spark, d), ["l"], 8, 8, 5, 6), "l")


@query
def box_resize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.resize(px_grey8(spark, d), ["l"], 8, 8, 4, 2, "box"), "l")


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 97).alias("width"), (F.col("p_size") * 61 + 5).alias("height"))


@query
def tile_plan(spark: SparkSession, d: str) -> DataFrame:
    return resample.plan_tiles(_images(spark, d), 512, 32)


@query
def tile_sides(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("image_id", resample.tile_size(F.col("height"), F.col("width"), 2500.0, 1e9).alias("tile"))


@query
def tiles_pasted(spark: SparkSession, d: str) -> DataFrame:
    """Pictures cut into overlapping tiles and put together again are themselves."""
    px = px_rgb64(spark, d)
    plan = resample.plan_tiles(spark.createDataFrame([(0, 64, 64)], "p long, height int, width int").withColumnRenamed("p", "image_id"), 40, 8).drop("image_id")
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return resample.paste(px.join(F.broadcast(plan), inside), ["r", "g", "b"])


@query
def warped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.warp(px_grey8(spark, d), ["l"], (0.8, 0.3, -0.5, -0.3, 0.8, 1.25), 8, 8), "coverage", "l", digits=5)


# ---- jobs
def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages as queued files that want the output <first path segment>.png."""
    stem = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1)
    return table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("source"), F.concat(stem, F.lit(".png")).alias("output"))


@query
def output_names(spark: SparkSession, d: str) -> DataFrame:
    return jobs.name_outputs(_sources(spark, d)).select("seq", "name", "number")


@query
def claimed_names(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a queue whose wanted names collide with numbered ones, with originals and with files that exist."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.expr("concat('p/', o_custkey % 211, case when o_orderkey % 3 = 0 then concat(' (', o_orderkey % 5 + 1, ')') else '' end, '.png')").alias("source"),
        F.expr("concat('p/', case when o_orderkey % 3 = 0 then 0 else o_custkey % 89 end, case when o_orderkey % 7 = 0 then concat(' (', o_orderkey % 13 + 2, ')') else '' end, '.png')").alias("output"),
    )
    there = table(spark, d, "customer").select(F.expr("concat('p/', c_custkey % 101, case when c_custkey % 4 > 0 then concat(' (', c_custkey % 17 + 2, ')') else '' end, '.png')").alias("output"))
    return jobs.name_outputs(o, there.where("output not like 'p/%0%'")).select("seq", "output", "number", "name")


@query
def item_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as the log of items: steps, progress and control, and what of it goes out."""
    e = table(spark, d, "events").select(
        F.expr("event_id div 40").alias("item"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"),
        F.expr("case event_id % 40 when 0 then 'queued' when 1 then 'processing' when 38 then 'done' when 20 then if(event_id % 3 = 0, 'done', 'queued') end").alias("status"),
        F.expr("if(event_id % 40 in (0, 1, 20, 38), null, if(event_id % 40 = 37, 1.0D, value / 200))").alias("progress"),
        F.expr("case when event_id div 40 % 5 = 1 and event_id % 40 = 12 then 'pause' when event_id div 40 % 5 = 1 and event_id % 40 = 17 then 'resume' when event_id div 40 % 11 = 4 and event_id % 40 = 25 then 'cancel' end").alias("control"),
    )
    e = e.withColumn("progress", F.when(F.col("control").isNull(), F.col("progress")))
    return ev.item_log(e, "item", 1800.0).select("item", F.unix_micros("at").alias("at"), "kind", "status", F.round("progress", 6).alias("progress"))


@query
def best_variants(spark: SparkSession, d: str) -> DataFrame:
    """For every brand and three scales the variant (a part) that serves it best."""
    part = table(spark, d, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_size").alias("native")).agg(F.min("p_partkey").alias("spec"))
    asked = part.select("family").distinct().withColumn("scale", F.explode(F.array(F.lit(2), F.lit(20), F.lit(45))))
    return jobs.best_variant(asked, part)


@query
def collected_inputs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["jpg", "PNG", "txt", "tiff", "gif", "webp"])), (F.col("page_id") % 6 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 7 == 0, "a/upscaled").when(F.col("page_id") % 7 == 1, "restored").otherwise("b/c")
    name = F.concat(F.lit("p"), (F.col("page_id") % 50).cast("string"), F.when(F.col("page_id") % 2 == 0, "_restored").otherwise(""))
    return jobs.collect_inputs(table(spark, d, "pages").select(F.concat(folder, F.lit("/"), name, F.lit("."), kind).alias("path")))


@query
def skipped_existing(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order: jobs whose output does not exist yet."""
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("output"))
    return jobs.skip_existing(wanted, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("output")))


@query
def clashing_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("source"), (F.col("event_id") * 7 % 9973 + F.col("user_id")).alias("output"))
    return jobs.clashes_with_sources(e)


@query
def missing_models(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(60).select(F.col("id").cast("int").alias("p_size"))
    return jobs.missing_inputs(asked, table(spark, d, "part").where("p_brand = 'Brand#1'"), "p_size")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    progress = F.floor(F.col("o_totalprice") % 100) / 100
    return table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderstatus").alias("status"), progress.alias("progress"))


@query
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return jobs.summary(_queue(spark, d), {"done": "F", "failed": "P", "queued": "O"}, ["batch"])


@query
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.progress(_queue(spark, d), ["F"], "P", ["batch"]), "fraction")


@query
def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").alias("weight"))
    s = s.groupBy("job", "stage").agg(F.sum("weight").alias("weight"))
    return rounded(jobs.stage_plan(s, "job"), "start", "share")


@query
def evicted_entries(spark: SparkSession, d: str) -> DataFrame:
    """Least recently used entries of each cache that go until 300,000 is kept."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("cache"), "o_orderkey", "o_orderdate", F.floor("o_totalprice").cast("long").alias("size"))
    return jobs.evict(e, 300_000, "cache", "size", ["o_orderdate", "o_orderkey"]).select("cache", "o_orderkey", "kept_up_to")


@query
def newest_entries(spark: SparkSession, d: str) -> DataFrame:
    return jobs.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 3, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query
def stale_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("look"), F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderstatus")).alias("hdr"))
    now = e.withColumn("hdr", F.when(F.col("o_orderkey") % 3 == 0, F.lit("F")).otherwise(F.col("hdr")))
    return jobs.stale(e, now, "o_orderkey", ["look", "hdr"])


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names, sizes and tags of results."""
    p = table(spark, d, "part")
    name = jobs.render_name("{name}_{scale}x", {"name": F.col("p_name"), "scale": F.col("p_size") % 4 + 1, "width": F.col("p_size")}, {"lighting": F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), "look": F.when(F.col("p_partkey") % 3 == 0, F.lit("a/b"))})
    return p.select("p_partkey", name.alias("name"), jobs.human_size((F.col("p_partkey") * F.col("p_partkey") * 1009).cast("double")).alias("size"), jobs.settings_tag([F.col("p_brand"), F.col("p_size").cast("string")]).alias("tag"), jobs.cache_key([F.col("p_name"), F.col("p_brand")]).alias("key"))


@query
def admitted_jobs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("w"), (F.col("p_size") * 700).alias("h"), (F.col("p_partkey") % 3 + 2).cast("int").alias("s"))
    return p.select("p_partkey", jobs.feasible(F.col("w"), F.col("h"), F.col("s"), 30_000_000_000).alias("reason"))


@query
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*map(F.lit, ["CUDA out of memory", "Permission denied: x", "No space left on device", "No such file", "strange"]))
    e = table(spark, d, "events").select(jobs.error_kind(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("kind"))
    return e.groupBy("kind").agg(F.count("*").alias("n"))


@query
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """Global row numbers in order of time, without one task for all rows."""
    return jobs.with_sequence(table(spark, d, "events").select("ts", "event_id"), "event_id").select("event_id", "seq")


@query
def unfinished_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("skipped")
    e = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, status).alias("status"))
    return jobs.unfinished(e)


@query
def source_references(spark: SparkSession, d: str) -> DataFrame:
    return jobs.references(table(spark, d, "lineitem"), "l_partkey")


@query
def names_after_withdrawal(spark: SparkSession, d: str) -> DataFrame:
    """Names given again once every third queued job is withdrawn; running ones stay."""
    batch = _sources(spark, d).withColumn("status", F.when(F.col("seq") % 2 == 0, "queued").otherwise("processing"))
    left = jobs.withdraw(batch, batch.where("seq % 3 = 0"), "seq")
    return jobs.name_outputs(left).select("seq", "name", "number")


@query
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's newest order, where finished, as a cache entry looked up by customer."""
    cache = jobs.newest(table(spark, d, "orders"), 1, "o_custkey", ["o_orderdate", "o_orderkey"])
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return jobs.looked_up(asked, cache.where("o_orderstatus = 'F'"), "o_custkey", ["o_orderkey"])


@query
def abandoned_files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("t"), F.col("event_id"), F.when(F.col("event_id") % 2 == 0, ".tmp").otherwise(".png")).alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))
    last = e.agg(F.max("modificationTime").alias("now"))  # one row
    return jobs.abandoned(e.crossJoin(F.broadcast(last)), F.col("now"), 24.0 * 3).select("path")


@query
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    """Folders, stems, extensions and tags of results."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    restored, kept = k % 2 == 0, k % 5 == 0
    colourised = jobs.will_colourise(k % 3 == 0, F.col("p_size") - 10, k % 7 < 3)
    stem = jobs.restored_stem(F.col("p_name"), F.when(k % 4 == 0, F.lit("heavy")), colourised, k % 3)
    hdr = F.element_at(F.array(*map(F.lit, ["", "avif", "exr", "gainmap", "png"])), (k % 5 + 1).cast("int"))
    image = F.when(k % 3 == 0, "jpeg").when(k % 3 == 1, "webp").otherwise("png")
    folder = jobs.output_folder(F.concat(F.lit("in/"), F.col("p_brand"), F.lit("/"), F.col("p_name")), F.when(k % 6 == 0, F.lit("out")), restored)
    tags = jobs.result_tags(F.col("p_type"), F.lit("look"), F.when(k % 2 == 0, F.lit("vivid-60")), hdr, kept)
    return p.select("p_partkey", folder.alias("folder"), stem.alias("stem"), jobs.output_extension(image, hdr).alias("extension"), jobs.output_tag([F.col("p_brand"), k % 3, image, F.when(k % 2 == 0, F.lit("x"))]).alias("tag"), tags["lighting"].alias("lighting"), tags["look"].alias("look"), tags["hdr"].alias("hdr"), jobs.keeps_hdr(k % 2 == 0, F.when(k % 3 == 0, "gain-map").otherwise("avif"), k % 4 == 0).alias("keeps_hdr"))


@query
def restoration_plan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ["light", "standard", "heavy", "odd"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("level"), (F.col("p_partkey") % 3).cast("int").alias("scale"))
    return jobs.restoration_stages(p)


@query
def recovery(spark: SparkSession, d: str) -> DataFrame:
    """Adjustments that follow restored levels; picture 0 counts as monochrome."""
    rows = stats.levels(px_rgb64(spark, d)).withColumn("monochrome", F.col("image_id") == 0)
    out = stats.recovery_adjustments(rows, 60, True)
    return rounded(out.select("image_id", "contrast", "shadows", "highlights", "saturation"), "contrast", "shadows", "highlights", "saturation")


# ---- interpolation, events, streams, formats
@query
def last_price(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: the last purchase value of the user before each error."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    return joins.as_of(left, e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value", "last_value").select("event_id", "last_value")


@query
def kept_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Non-maximum suppression of boxes made from parts; each brand is a picture."""
    p = table(spark, d, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("image_id"), F.col("p_partkey").alias("box_id"), (F.col("p_partkey") * 37 % 200).cast("double").alias("x0"), (F.col("p_partkey") * 53 % 200).cast("double").alias("y0"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("score"))
    return joins.suppress(p.select("image_id", "box_id", "x0", "y0", (F.col("x0") + F.col("s") + 20).alias("x1"), (F.col("y0") + F.col("s") + 20).alias("y1"), "score"))


@query
def event_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return rounded(ev.running_totals(e, "user_id", ["ts", "event_id"], "event_type = 'purchase'").drop("ts", "event_type", "user_id"), "fraction")


@query
def item_status(spark: SparkSession, d: str) -> DataFrame:
    return ev.last_status(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def _states(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, list(ev.NEXT))), (F.pmod(c, F.lit(7)) + 1).cast("int"))


@query
def illegal_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", _states(F.floor(F.col("value") * 100)).alias("status"))
    return ev.illegal_steps(e, "user_id", ["event_id"], "status")


@query
def throttled_events(spark: SparkSession, d: str) -> DataFrame:
    return ev.throttled(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "user_id", ["ts", "event_id"], 3600.0, "event_type = 'purchase'").select("event_id")


@query
def streamed_progress(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the event table read as a stream, finished items in hourly windows."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.progress_stream(stream, "event_type", "ts", "value > 50", "1 hour")
    kept: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:  # the windows so far, in the shared folder
        kept.append(stored(batch, "progress"))

    run = out.writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    last = kept[-1] if kept else stored(spark.createDataFrame([], "window struct<start: timestamp, end: timestamp>, event_type string, n long, finished long"), "progress")
    return last.select(F.unix_seconds("window.start").alias("at"), "event_type", "n", "finished")


@query
def png_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pictures written as 16-bit PNG with a cICP chunk, read back, and as pixels again."""
    px = px_rgb64(spark, d)

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        s = np.zeros((h, w, 3), np.uint16)
        s[pdf.y, pdf.x] = pdf[["r", "g", "b"]].to_numpy() * 257
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "content": [formats.write_png(s, {"cICP": bytes([9, 16, 0, 1])})]})

    files = px.groupBy("image_id").applyInPandas(encode, "image_id long, content binary")
    files = files.where(formats.sniff(F.col("content")) == "png-hdr")
    back = formats.explode_pixels(formats.decode_png(files))
    back = back.join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")  # incomplete pictures were padded
    return back.select("image_id", "y", "x", *((F.col(c) / 257).cast("int").alias(c) for c in "rgb"))


@query
def pictures_written(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to verified files in the shared folder; heads and a region read back from them."""
    folder = shared_path(spark, "pictures")
    px = px_rgb64(spark, d)
    pictures.write(pictures.from_pixels(px, "concat('set', image_id % 3, '/', image_id, '.png')", 16), folder)
    read = pictures.read(spark, folder, "samples", (8, 16, 20, 24), [("width", "=", 64), ("path", "endswith", ".png")])
    number = F.regexp_extract("path", r"set([0-9]+/[0-9]+)\.png$", 1)
    seen = read.select(F.regexp_extract(number, "[0-9]+$", 0).cast("long").alias("image_id"), number.alias("name"), "height", F.col("rows").alias("height_read"), F.col("columns").alias("w"), "channels", "depth", "data")
    parts = formats.explode_pixels(seen.select("image_id", F.col("height_read").alias("height"), F.col("w").alias("width"), "channels", "depth", "data"))
    sums = parts.groupBy("image_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"))
    return seen.select("image_id", "name", "height").join(sums, "image_id")


@query
def synthetic_pattern(spark: SparkSession, d: str) -> DataFrame:
    """A test picture of each part's own size."""
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 13 + 2).alias("size"))
    return test_pattern(sizes)




# ---- finishes, gain maps, samples, faces, settings
@query
def finished_photo(spark: SparkSession, d: str) -> DataFrame:
    """A finish: its adjustments, then midtone contrast."""
    return pipeline.run(px_rgb64(spark, d), pipeline.Options(finish="clean"))


@query
def gain_map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pictures brightened, stored as codes of a small gain map, and lifted again; what a picture
    lacks of its square is black."""
    sdr = squares(px_rgb64(spark, d)).withColumns({c: colour.srgb_eotf(F.col(c) / 255.0) for c in "rgb"})
    hdr = sdr.withColumns({c: F.col(c) * (1 + F.col("r")) for c in "rgb"})
    codes = gainmap.encode(gainmap.gains(sdr, hdr))
    return rounded(gainmap.apply(sdr, codes, 64, 64), "r", "g", "b", digits=5)


@query
def samples_to_8_bits(spark: SparkSession, d: str) -> DataFrame:
    px = px_rgb64(spark, d).withColumns({"i16": F.col("r") * 257, "i": F.col("g") * F.when(F.col("image_id") % 2 == 0, 200).otherwise(1), "f": F.col("b") / F.when(F.col("image_id") % 2 == 0, 255.0).otherwise(1.0)})
    for c, kind in (("i16", "I;16"), ("i", "I"), ("f", "F")):
        px = samples.to_8_bits(px, c, kind)
    return px.select("image_id", "y", "x", "i16", "i", "f")


@query
def public_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("Make"), F.col("p_brand"), F.lit("GPSLatitude"), F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, "Orientation").otherwise("Artist"), F.col("p_type"))
    kept = samples.public_metadata(tags)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"))


@query
def face_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Similarity transforms of each order's line items as five-point faces."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("face"), (F.col("l_linenumber") * F.col("l_linenumber")).cast("double").alias("sx"), (F.col("l_partkey") % 97).cast("double").alias("sy"), F.col("l_quantity").cast("double").alias("tx"), (F.col("l_suppkey") % 31).cast("double").alias("ty"))
    many = p.groupBy("face").agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    out = rounded(faces.similarity_transform(p.join(many, "face"), "face"), "a", "b", "c", "d", digits=4)
    return out.withColumns({n: F.col(n) + 0.0 for n in "abcd"})  # no negative zero


@query
def face_weights(spark: SparkSession, d: str) -> DataFrame:
    """How much of a restored face is used, from mode, size, score and detail."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    mode = F.when(k % 3 == 0, "off").when(k % 3 == 1, "strong").otherwise("natural")
    factors = [faces.base_weight(mode, k % 120), faces.size_factor(k % 20 * 1.0), faces.score_factor(0.9 + k % 10 / 100.0), faces.detail_factor(k % 17 / 8.0), faces.ellipse_mask(k % 512 * 1.0, k * 7 % 512 * 1.0)]
    weight = factors[0]
    for f in factors[1:]:
        weight = weight * f
    return p.select("p_partkey", F.round(weight + 1e-9, 4).alias("weight"))


@query
def decoded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Priors of small pictures and the boxes that offsets make of them."""
    images = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 3 + 20).alias("width"), (F.col("p_size") * 2 + 20).alias("height"))
    rows = faces.priors(spread(images)).withColumns({f"l{i}": F.sin(F.col("image_id") * (i + 1) + F.col("cx") * 9) for i in range(4)})
    boxes = rounded(faces.decode(rows).select("image_id", "prior", "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1", digits=5)
    return boxes.withColumns({c: F.col(c) + 0.0 for c in ("x0", "y0", "x1", "y1")})  # no negative zero


@query
def settings_read(spark: SparkSession, d: str) -> DataFrame:
    """Settings documents: values clamped, impossible ones replaced, presets recognised."""
    k = F.col("p_partkey")
    text = F.concat(F.lit('{"scale": '), k % 6, F.lit(', "quality": "'), F.when(k % 5 == 0, F.lit("x")).otherwise((k * 3 % 130).cast("string")), F.lit('", "mode": "'), F.when(k % 2 == 0, "restore").otherwise("other"), F.lit('", "hdr_enabled": '), F.when(k % 3 == 0, "true").otherwise('"maybe"'), F.lit("}"))
    s = table(spark, d, "part").select("p_partkey", settings.read(text).alias("s"))
    s = s.withColumn("s", F.when(k % 7 == 0, settings.apply_preset(F.col("s"), "vintage")).when(k % 7 == 1, settings.apply_preset(F.col("s"), "film").withField("camera_look", F.lit("kodak"))).otherwise(F.col("s")))
    return s.select("p_partkey", "s.scale", "s.quality", "s.mode", "s.hdr_enabled", "s.camera_look", "s.camera_look_intensity", settings.label(F.col("s")).alias("label"))


# ---- repair and whole jobs
@query
def restored_levels(spark: SparkSession, d: str) -> DataFrame:
    return repair.restore_levels(px_rgb64(spark, d), 60, True)


@query
def specks_removed(spark: SparkSession, d: str) -> DataFrame:
    px = px_rgb64(spark, d).select("image_id", "y", "x", (luma8(cols()) / 255.0).alias("v"))
    return rounded(repair.remove_specks(px, "v", 5, 0.3, 0.35, 10, 0.2), "fixed", "v", digits=5)


@query
def line_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings and closings with lines at two slanted angles, the longer one by running extremes."""
    px = px_rgb64(spark, d).select("image_id", "y", "x", luma8(cols()).alias("v"))
    px = lines.opened_and_closed(px, "v", 9, 22.5, "opened", "closed")
    return lines.opened_and_closed(px, "v", 31, 112.5, "opened_long", "closed_long")


@query
def blended(spark: SparkSession, d: str) -> DataFrame:
    px = px_rgb64(spark, d)
    return repair.blend(px, lighting.apply_profile(px, "vivid"), 0.35)


@query
def recoloured(spark: SparkSession, d: str) -> DataFrame:
    px = px_rgb64(spark, d)
    return repair.soft_colour(px.withColumns({c: luma8(cols()) for c in "rgb"}), px, 0.8)


@query
def whole_job(spark: SparkSession, d: str) -> DataFrame:
    """Levels, lighting, a look, upscaling and HDR as one plan."""
    options = pipeline.Options(fading=40, lighting=lighting.PROFILES["studio"], look=lighting.LOOKS["canon-natural"], scale=2, hdr="natural")
    return pipeline.run(px_rgb64(spark, d), options)


@query
def restored_job(spark: SparkSession, d: str) -> DataFrame:
    """Specks, scratches, tones, upscaling and sharpening as one plan."""
    options = pipeline.Options(dust=70, scratches=55, noise=0.01, fading=40, scale=2, sharpness=35)
    return pipeline.run(px_rgb64(spark, d), options)


@query
def network_upscaled(spark: SparkSession, d: str) -> DataFrame:
    """Pictures at twice their size by a small network, in tiles."""
    return networks.upscale(squares(px_rgb64(spark, d)), 2, networks.seeded(4, 1, 2), 32)


@query
def look_by_cube(spark: SparkSession, d: str) -> DataFrame:
    """A look baked into a cube of 17 levels and looked up by colour."""
    return lighting.apply_look(px_rgb64(spark, d), lighting.LOOKS["portra"], cube=17)


@query
def identity_job(spark: SparkSession, d: str) -> DataFrame:
    """Options that change nothing leave the scan alone."""
    return pipeline.run(px_rgb64(spark, d), pipeline.Options())
