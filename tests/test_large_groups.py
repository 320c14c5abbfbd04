"""Crowded pictures, a colour at the edge of a rounding, and how often pixels are dealt."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from photonframe.operators import joins, lighting, repair, stencil
from photonframe.plans import pipeline, queries


def greedy(boxes: list[tuple], threshold: float) -> set[tuple[int, int]]:
    kept: dict[int, list[tuple]] = {}
    for image, box, x0, y0, x1, y1, _ in sorted(boxes, key=lambda b: (-b[6], b[1])):
        def covers(o: tuple) -> bool:
            both = max(min(x1, o[3]) - max(x0, o[1]), 0) * max(min(y1, o[4]) - max(y0, o[2]), 0)
            return both > threshold * max((x1 - x0) * (y1 - y0) + (o[3] - o[1]) * (o[4] - o[2]) - both, 1e-6)

        if not any(map(covers, kept.setdefault(image, []))):
            kept[image].append((box, x0, y0, x1, y1))
    return {(image, o[0]) for image, own in kept.items() for o in own}


def test_a_crowd_of_boxes_meets_few(spark, monkeypatch):
    """Boxes of a crowd do not all meet, whether they are copies, near copies or strewn."""
    r = random.Random(3)
    boxes = []
    for i in range(1500):
        x, y, s = (5.0, 5.0, 20.0) if i < 400 else (5 + i / 1000, 5.0, 20.0) if i < 900 else (r.uniform(0, 90), r.uniform(0, 90), r.uniform(8, 20))
        boxes.append((i % 2, i, x, y, x + s, y + s, float(r.randrange(40)) if i % 3 else i / 50))
    boxes += [(2, k, 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(3)]  # without extent: none overlaps
    frame = spark.createDataFrame(boxes, "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double")
    stored, rows = joins.stored, []

    def counted(df, tag):
        out = stored(df, tag)
        if tag == "pairs":
            rows.append(out.count())
        return out

    monkeypatch.setattr(joins, "stored", counted)
    got = {(x.image_id, x.box_id) for x in joins.suppress(frame).collect()}
    assert got == greedy(boxes, 0.4) and max(rows) < 80_000  # 185,000 and more if all met
    monkeypatch.undo()
    assert {(x.image_id, x.box_id) for x in joins.suppress(frame.where("box_id % 4 = 0 or image_id = 2"), top=5).collect()} == greedy([b for b in boxes if b[1] % 4 == 0 or b[0] == 2], 0.4)
    odd = frame.where("box_id < 2").withColumn("score", F.lit(None).cast("double"))
    assert joins.suppress(odd).count() == odd.count()


def test_a_colour_at_the_edge_of_two_levels(spark):
    """Of all 256^3 colours the one whose level hung on the order of operations."""
    px = spark.createDataFrame([(0, 0, 0, 142, 206, 43)], "image_id long, y int, x int, r int, g int, b int")
    mono = lighting.Look(monochrome=100, mix=(0.4, 0.4, 0.2), rolloff=40)
    assert tuple(lighting.apply_look(px, mono).select("r", "g", "b").first()) == (154, 154, 154)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_windows_find_their_lines_where_they_are(spark, monkeypatch):
    """Pixels are dealt once by picture, not for each window; large pictures by line as before."""
    px = spark.range(3 * 24 * 24).selectExpr("id div 576 as image_id", "cast(id % 576 div 24 as int) as y", "cast(id % 24 as int) as x", "cast(id * 37 % 251 as int) as r", "cast(id * 91 % 241 as int) as g", "cast(id * 13 % 239 as int) as b")
    grey = px.selectExpr("image_id", "y", "x", "r / 255 as v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        job = lambda: pipeline.run(px, pipeline.Options(scale=2, sharpness=35, hdr="natural"), side=24)
        marked = lambda: repair.mark_specks(stencil.by_picture(grey), "v", 5, 0.3, 0.35)
        assert exchanges(job()) == exchanges(marked()) == 1
        small = sorted(map(tuple, job().collect())), sorted(map(tuple, marked().collect()))
        monkeypatch.setattr(stencil, "WHOLE", 500)
        assert exchanges(job()) > 3 and exchanges(marked()) > 3
        assert small == (sorted(map(tuple, job().collect())), sorted(map(tuple, marked().collect())))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_priors_are_made_by_all_cores(spark, tmp_path):
    """A part is hundreds of priors: a table in one file is dealt over the cores before they are made."""
    spark.range(40).selectExpr("id as p_partkey", "cast(id % 9 + 1 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    boxes = queries.decoded_boxes(spark, str(tmp_path))
    spread = boxes.groupBy(F.spark_partition_id()).count().count()
    assert spread >= spark.sparkContext.defaultParallelism * 3 and boxes.select("image_id", "prior").distinct().count() == boxes.count()
