"""Face geometry, sample depths and save options."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from photonframe.operators import faces
from photonframe.sources import samples


def test_similarity_transform_is_recovered(spark):
    r = np.random.default_rng(1)
    src = r.random((5, 2)) * 100
    s, t = 1.7, 0.4
    m = s * np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    dst = src @ m.T + [3, -8]
    rows = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(src, dst, strict=True)], "face long, sx double, sy double, tx double, ty double")
    got = faces.similarity_transform(rows, "face").first()
    assert np.allclose([got.a, got.b, got.c, got.d], [m[0, 0], m[1, 0], 3, -8], atol=1e-8)


def test_priors_cover_the_picture(spark):
    n = {(w, h): faces.priors(spark.createDataFrame([(1, w, h)], "image_id long, width int, height int")).count() for w, h in ((64, 32), (65, 33))}
    assert n == {(64, 32): 2 * (8 * 4 + 4 * 2 + 2 * 1), (65, 33): 2 * (9 * 5 + 5 * 3 + 3 * 2)}
    box = faces.decode(spark.createDataFrame([(0.5, 0.5, 0.2, 0.4, 0.0, 0.0, 0.0, 0.0)], "cx double, cy double, w double, h double, l0 double, l1 double, l2 double, l3 double")).first()
    assert np.allclose([box.x0, box.y0, box.x1, box.y1], [0.4, 0.3, 0.6, 0.7])


def test_factors(spark):
    row = spark.range(1).select(faces.size_factor(F.lit(5.0)).alias("a"), faces.size_factor(F.lit(16.0)).alias("b"), faces.score_factor(F.lit(0.97)).alias("c"), faces.detail_factor(F.lit(1.5)).alias("d"), faces.base_weight(F.lit("strong"), F.lit(50)).alias("e"), faces.ellipse_mask(F.lit(292.0), F.lit(256.0)).alias("f"), faces.ellipse_mask(F.lit(0.0), F.lit(0.0)).alias("g")).first()
    assert [round(v, 9) for v in row] == [0.3, 1.0, 1.0, 1.0, 0.8, 1.0, 0.0]


def test_identity_of_the_same_face_and_of_a_blank_one(spark):
    rows = spark.createDataFrame([(i // 50, float(i % 50) / 50 if i < 50 else 0.5, float(i % 50) / 50, 1.0) for i in range(100)], "image_id long, a double, b double, w double")
    got = {r.image_id: r.identity for r in faces.identity_factor(rows, "a", "b", "w").collect()}
    assert got == {0: 1.0, 1: 0.25}


def test_faces_are_filtered(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.99, 9.0), (1, 1, 1.0, 1.0, 10.0, 10.0, 0.95, 9.0), (1, 2, 50.0, 50.0, 60.0, 60.0, 0.95, 3.0), (1, 3, 80.0, 80.0, 90.0, 90.0, 0.5, 9.0)]
    frame = spark.createDataFrame(rows, "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double, eye_distance double")
    assert [r.box_id for r in faces.detected(frame).collect()] == [0]


def test_sample_depths(spark):
    px = spark.createDataFrame([(1, 65535.0), (1, 256.0), (2, 200.0), (2, 3.0)], "image_id long, v double")
    assert sorted(r.v for r in samples.to_8_bits(px, "v", "I").collect()) == [1, 3, 200, 255]
    assert sorted(r.v for r in samples.to_8_bits(px.withColumn("v", F.col("v") / 65535), "v", "F").collect())[-1] == 255


def test_save_options(spark):
    icc = F.lit(bytearray(b"\0" * 16 + b"GRAY"))
    opts = lambda fmt, q, mode, exif: samples.save_options(F.lit(fmt), F.lit(q), F.lit(mode), F.lit(bytearray(exif)), icc, F.lit(72), F.lit(2))
    row = spark.range(1).select(opts("JPEG", 90, "L", b"x" * 70_000).alias("a"), opts("PNG", 50, "RGB", b"xy").alias("b")).first()
    assert row.a == {"quality": "90", "subsampling": "0", "icc_profile": (b"\0" * 16 + b"GRAY").hex().upper(), "dpi": "144"}
    assert row.b == {"compress_level": "6", "exif": "7879", "dpi": "144"}
    tags = spark.range(1).select(samples.public_metadata(F.create_map(F.lit("GPSInfo"), F.lit("1"), F.lit("Make"), F.lit("m"), F.lit("Orientation"), F.lit("6"))).alias("t")).first().t
    assert tags == {"Make": "m", "Orientation": "1"}


def test_faces_are_pasted_where_they_were(spark):
    px = spark.range(24 * 32).select(F.lit(1).cast("long").alias("image_id"), F.expr("cast(id div 32 as int)").alias("y"), F.expr("cast(id % 32 as int)").alias("x"), *(F.lit(100).alias(c) for c in "rgb"))
    crop = spark.range(64).select(F.lit(7).cast("long").alias("face_id"), F.expr("cast(id div 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("x"), F.lit(50.0).alias("r"), F.lit(-20.0).alias("g"), F.lit(0.0).alias("b"), F.lit(0.5).alias("alpha"))
    where = spark.createDataFrame([(1, 7, 1.0, 0.0, -10.0, -4.0), (2, 7, 1.0, 0.0, 0.0, 0.0)], "image_id long, face_id long, a double, b double, c double, d double")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in faces.paste_faces(px, where, crop, side=8).collect()}
    inside = {(y, x) for y in range(4, 12) for x in range(10, 18)}
    assert len(got) == 24 * 32 and all(got[p] == ((125, 90, 100) if p in inside else (100, 100, 100)) for p in got)


def test_harmonised_faces_keep_the_photos_tone(spark):
    crop = spark.range(400).select(F.lit(1).cast("long").alias("image_id"), F.expr("cast(id div 20 as int)").alias("y"), F.expr("cast(id % 20 as int)").alias("x"), F.lit(0.4).alias("o"), (0.7 + 0.1 * F.pmod(F.col("id"), F.lit(2))).alias("n"))
    out = faces.harmonise(crop, "o", "n", False, "h").agg(F.avg("h").alias("m"), F.stddev("h").alias("s")).first()
    assert abs(out.m - 0.4) < 1e-3 and abs(out.s - 0.05) < 2e-3


def test_face_report(spark):
    rows = spark.createDataFrame([(1, 0.9, 1.0, 0.5), (1, 0.5, 1.0, 0.3), (1, 1.0, 1.0, 0.01)], "image_id long, identity double, size double, weight double")
    assert tuple(faces.face_report(rows).first()) == (1, 3, 2, 1)
