"""The cache of results over several runs, and sums over a whole order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from photonframe.functions.sequence import running_sum
from photonframe.operators import cache, stats


def run(spark, folder, files, settings="a", budget=10_000):
    """(results by path, paths that were made)"""
    made = []

    def make(missing):
        made.extend(r.path for r in missing.collect())
        return missing.select("path", F.concat("path", F.lit("@"), "modified").alias("value"), F.lit(100).cast("long").alias("bytes"))

    frame = spark.createDataFrame(files, "path string, modified long, length long")
    return {r.path: (r.value, r.hit) for r in cache.refresh(folder, frame, make, settings, budget).collect()}, sorted(made)


def test_only_changed_files_are_made_again(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    files = [(f"p{i}", 1, 10) for i in range(6)]
    got, made = run(spark, folder, files)
    assert made == [f"p{i}" for i in range(6)] and got["p3"] == ("p3@1", False)
    got, made = run(spark, folder, files)
    assert made == [] and got["p3"] == ("p3@1", True)
    files[2], files[4] = ("p2", 5, 10), ("p4", 1, 11)  # another time, another size
    got, made = run(spark, folder, [*files, ("new", 1, 1), files[0]])
    assert made == ["new", "p2", "p4"] and got["p2"] == ("p2@5", False) and got["p0"] == ("p0@1", True) and len(got) == 7
    assert run(spark, folder, files[:3], "b")[1] == ["p0", "p1", "p2"]  # other settings
    assert run(spark, folder, files)[1] == []  # the first ones are still there
    assert cache.versions(spark, folder)[-1] == 5 and len(cache.versions(spark, folder)) == 2
    assert run(spark, folder, [])[0] == {}
    (tmp_path / "cache" / "v99").mkdir()  # a run that never ended
    assert run(spark, folder, files)[1] == []


def test_least_recently_used_go(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    run(spark, folder, [(f"a{i}", 1, 1) for i in range(4)], budget=500)
    run(spark, folder, [("a1", 1, 1), ("a3", 1, 1), ("b", 1, 1), ("c", 1, 1)], budget=500)
    kept = {r.path for r in spark.read.parquet(f"{folder}/v2").collect()}
    assert kept == {"a1", "a3", "b", "c", "a0"}  # of the oldest, what fits
    assert run(spark, folder, [("a0", 1, 1), ("a2", 1, 1)], budget=500)[1] == ["a2"]


def test_running_sum(spark):
    r = random.Random(2)
    rows = [(r.randrange(50), i, r.randrange(9)) for i in range(400)]
    frame = spark.createDataFrame(rows, "a int, b int, v long").repartition(5)
    got = {(x.a, x.b): x.s for x in running_sum(frame, [F.desc("a"), "b"], "v", "s").collect()}
    total = 0
    for a, b, v in sorted(rows, key=lambda x: (-x[0], x[1])):
        total += v
        assert got[a, b] == total


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9, 1.0])
def test_trimmed_mean(spark, share):
    r = random.Random(3)
    rows = [(k, v) for k in range(4) for v in ([5.0] * 50 if k == 0 else [r.choice([1.0, 2.0, 3.0]) for _ in range(60)] if k == 1 else [r.gauss(0, 1) ** 5 for _ in range(300)] if k == 2 else [7.0])]
    frame = spark.createDataFrame([*rows, (2, None), (9, None)], "k int, v double").repartition(3)
    got = {x.k: x.m for x in stats.trimmed_mean(frame, "k", "v", share, "m").collect()}
    want = {}
    for k in range(4):
        own = sorted(v for q, v in rows if q == k)
        n = max(1, int(len(own) * share))
        want[k] = sum(own[:n]) / n
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = stats.trimmed_mean(frame, "k", "v", share, "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_bin" in plan
