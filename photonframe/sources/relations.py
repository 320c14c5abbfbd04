"""Pixel relations: one row for each pixel, (image_id, y, x, channels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_rgb64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as 64 x 64 colour pictures of 8-bit channels."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 4096").alias("image_id"),
        F.expr("cast(event_id % 4096 div 64 as int)").alias("y"),
        F.expr("cast(event_id % 64 as int)").alias("x"),
        (F.floor(F.col("value") * 100 + 0.5) % 256).cast("int").alias("r"),
        (F.col("user_id") % 256).cast("int").alias("g"),
        (k % 256).alias("b"),
    )


def spread(px: DataFrame) -> DataFrame:
    """Pixels dealt over the cores where their table has fewer files than there are cores:
    worth an exchange where much is computed for each pixel and nothing else deals them."""
    cores = px.sparkSession.sparkContext.defaultParallelism
    return px.repartition(cores) if len(px.inputFiles()) < cores else px


def px_grey8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 grey pictures."""
    values = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    level = F.floor((F.col("v").cast("double") + 0.5) * 255 + 0.5)
    return values.select("image_id", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.least(F.greatest(level, F.lit(0)), F.lit(255)).cast("int").alias("l"))


def test_pattern(sizes: DataFrame) -> DataFrame:
    """Synthetic square colour pictures of (image_id, size): ramps along x and y, and a diagonal."""
    px = sizes.where("size > 0").withColumn("p", F.explode(F.expr("sequence(0, size * size - 1)")))
    y, x = F.expr("cast(p div size as int)"), F.expr("cast(p % size as int)")
    ramp = lambda c: F.floor(F.col(c) * (F.lit(255.0) / F.greatest(F.col("size") - 1, F.lit(1))) + 0.5).cast("int")
    return px.withColumns({"y": y, "x": x}).select(F.col("image_id").cast("long").alias("image_id"), "y", "x", ramp("x").alias("r"), ramp("y").alias("g"), ((F.col("x") + F.col("y")) % 32 * 8).cast("int").alias("b"))
