"""Global row numbers without one task for all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonframe.functions.stored import stored


def global_sequence(rows: DataFrame, order: list[str], out: str = "seq", ranges: int | None = None) -> DataFrame:
    """Numbers from 0 in the order of columns. Rows are dealt by range and written with the
    number of their range, since the bounds of ranges are sampled and differ each time they
    are; then numbered in their range, and shifted by the sizes of the ranges before (one
    number for each range). Ties are numbered in any order, each number once."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def group_sequence(rows: DataFrame, group: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """Numbers from 0 within each group, in the order of columns. Groups lie one after the
    other in a global sequence, so a group that has most of the rows is still many ranges."""
    all_ = global_sequence(rows, [*group, *order], "_all")
    start = all_.groupBy(*(F.col(g).alias(f"_{k}") for k, g in enumerate(group))).agg(F.min("_all").alias("_start"))
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_{k}"))
    return all_.join(start, same).withColumn(out, F.col("_all") - F.col("_start")).select(*rows.columns, out)


def runs(rows: DataFrame, group: list[str], order: list[str], begins: Callable[[Callable[[str], Column]], Column], out: str = "run", ranges: int | None = None) -> DataFrame:
    """Names the run of each row, in the order of columns: a run goes from a row that begins
    one to the row before the next. ``begins`` gets a function from a column's name to its
    value in the row before; it need not look at groups, each of which begins anew. Ranges of
    rows are looked at apart; their last rows, one for each range, tell the next how it begins."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    dealt = stored(rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*group, *order)
    across = Window.orderBy("_range")
    row = F.struct(*names)
    last = dealt.groupBy("_range").agg(F.max_by(row, F.struct(*group, *order)).alias("_row"))
    last = last.select("_range", F.lag("_row").over(across).alias("_edge"))
    near = dealt.join(F.broadcast(last), "_range").withColumn("_before", F.coalesce(F.lag(row).over(inside), F.col("_edge"))).drop("_edge")
    same = F.col("_before").isNotNull()
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("_before")[g])
    mark = ~same | F.coalesce(begins(lambda c: F.col("_before")[c]), F.lit(False))
    near = near.withColumn("_n", F.row_number().over(inside)).withColumn("_begin", F.when(mark, F.struct("_range", "_n")))
    near = near.withColumn("_own", F.last("_begin", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    near = stored(near.select(*names, "_range", "_own"), "runs")
    carried = near.groupBy("_range").agg(F.max("_own").alias("_last"))
    carried = carried.select("_range", F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return near.join(F.broadcast(carried), "_range").select(*names, F.coalesce("_own", "_carried").alias(out))


def running_sum(rows: DataFrame, order: list[str | Column], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Sum of a column up to and with each row, in the order of columns, over all rows: by range
    and shifted by the sums of the ranges before. Rows that tie in all columns come in any order."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = sums.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(out, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
