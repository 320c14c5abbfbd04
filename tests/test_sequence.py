"""Row numbers of tables that are larger than the sample that settles ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonframe.functions.sequence import global_sequence


def test_every_number_once(spark):
    n = 600_000
    rows = spark.range(n).select((F.xxhash64("id") % 100_003).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), "id")
    out = global_sequence(rows.repartition(7), ["key", "id"], ranges=16)
    seen = out.agg(F.countDistinct("seq").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    assert (seen.n, seen.low, seen.high) == (n, 0, n - 1)
    assert out.join(out.select((F.col("seq") - 1).alias("seq"), F.struct("key", "id").alias("next")), "seq").where(F.struct("key", "id") >= F.col("next")).count() == 0


def test_ties_and_nothing(spark):
    same = spark.range(1000).withColumn("key", F.lit(1))
    assert sorted(r.seq for r in global_sequence(same, ["key"]).collect()) == list(range(1000))
    assert global_sequence(same.where("false"), ["key"]).count() == 0
