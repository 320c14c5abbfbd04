"""A cache of results by file, as a table with versions.

An entry belongs to a file as it was (path, time of change, size) and to the settings it was
made with. A run takes what is there for its files, makes the rest, and writes the next version:
entries of files that have changed go, and of what no longer fits the budget those that were
used longest ago. A version is whole when Spark has committed it, so a run that fails leaves
the version before; two versions are kept, for those who still read the older one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.functions.sequence import running_sum
from photonframe.functions.stored import stored

STATE = ["path", "modified", "length"]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions in a folder, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath().getName() for s in store.listStatus(path)]
    child = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and store.exists(child(n)))


def _drop(spark: SparkSession, folder: str, version: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def refresh(folder: str, files: DataFrame, make: Callable[[DataFrame], DataFrame], settings: str | Column = "", budget: int = 4 << 30) -> DataFrame:
    """Results for files (path, modified, length): their columns, the result's columns and hit.

    ``make`` gets the files that have no entry and returns for each path one row (path, ...,
    bytes long): the columns of a result and its size. ``settings`` tells results of one file
    apart; entries with other settings stay, as long as there is room. A path that comes twice
    counts once, as the one changed last."""
    spark = files.sparkSession
    asked = files.select(*STATE).groupBy("path").agg(F.max(F.struct("modified", "length")).alias("s")).select("path", "s.*")
    asked = stored(asked.withColumn("settings", settings if isinstance(settings, Column) else F.lit(settings)), "cache-asked")
    known = versions(spark, folder)
    run = (known[-1] if known else 0) + 1
    if known:
        old = spark.read.parquet(f"{folder}/v{known[-1]}")
        found = old.join(asked, [*STATE, "settings"], "left_semi")
        missing = asked.join(found.select("path"), "path", "left_anti")
    else:
        old, found, missing = None, None, asked
    made = make(missing.select(*STATE))
    fresh = missing.join(made, "path").withColumns({"used": F.lit(run).cast("long"), "made": F.lit(run).cast("long")})
    names = fresh.columns
    entries = stored(fresh if found is None else fresh.unionByName(found.withColumn("used", F.lit(run).cast("long")).select(*names)), "cache-used")
    every = entries
    if old is not None:
        gone = asked.select("path", F.col("modified").alias("_m"), F.col("length").alias("_l"))
        other = old.join(entries.select(*STATE, "settings"), [*STATE, "settings"], "left_anti").join(gone, "path", "left")
        fresh_enough = F.col("_m").isNull() | ((F.col("_m") == F.col("modified")) & (F.col("_l") == F.col("length")))
        every = entries.unionByName(other.where(fresh_enough).select(*names))
    kept = running_sum(every, [F.desc("used"), "path", "settings"], "bytes", "_up_to").where(F.col("_up_to") <= budget).drop("_up_to")
    kept.write.mode("overwrite").parquet(f"{folder}/v{run}")
    for version in known[:-1]:
        _drop(spark, folder, version)
    return entries.withColumn("hit", F.col("made") < run).drop("used", "made", "settings")
