"""Claims of output names and events of items against loops that go one by one."""

from __future__ import annotations

import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from photonframe.functions.sequence import group_sequence, runs
from photonframe.operators import jobs
from photonframe.streaming import events as ev


def claims(queue: list[tuple[int, str, str]], existing: set[str], most: int = 9_999) -> dict[tuple[str, str], tuple[str, int] | None]:
    """Names by (output, source): planned names first, then each source in turn."""
    originals, held = {s for _, s, _ in queue}, {}
    order = sorted({(o, s): q for q, s, o in sorted(queue, reverse=True)}.items(), key=lambda x: x[1])
    for (o, s), _ in order:
        if o not in originals:
            held.setdefault(o, s)
    wanted = {o for _, _, o in queue}
    out = {}
    for (o, s), _ in order:
        out[o, s] = None
        path = PurePosixPath(o)
        for n in range(1, most + 1):
            name = o if n == 1 else str(path.with_name(f"{path.stem} ({n}){path.suffix}"))
            if name in originals or name in existing or (n > 1 and name in wanted):
                continue
            if held.setdefault(name, s) == s:
                out[o, s] = name, n
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_claims_as_one_after_the_other(spark, seed):
    r = random.Random(seed)
    name = lambda k: f"d/{'abc'[r.randrange(k)]}{r.choice(['', '', '', ' (2)', ' (3)', ' (4)', ' (2) (2)', ' (02)', '.x'])}{r.choice(['.png', '.png', '.jpg', ''])}"
    source = lambda: name(2) if r.random() < 0.2 else f"in/{r.randrange(40)}.png"
    queue = [(q, source(), name(3)) for q in r.sample(range(1000), 120)]
    existing = {name(3) for _ in range(12)}
    frame = spark.createDataFrame(queue, "seq long, source string, output string")
    got = jobs.name_outputs(frame, spark.createDataFrame([(e,) for e in existing], "output string")).collect()
    want = claims(queue, existing)
    assert {(x["output"], x["source"]): (x["name"], x["number"]) for x in got} == want and len(got) == len(queue)
    assert len({v[0] for v in want.values()}) == len(want)  # no name twice


def test_a_hot_name_and_edges(spark):
    """Hundreds want one name; numbers that exist, or that others want, are passed over."""
    queue = [(i, f"s{i}", "a.png") for i in range(600)] + [(i, f"t{i}", f"a ({3 * i}).png") for i in range(1, 60)] + [(700, "s3", "a.png")]
    existing = {f"a ({i}).png" for i in range(2, 700, 7)}
    there = spark.createDataFrame([(e,) for e in existing], "output string")
    frame = spark.createDataFrame(queue, "seq long, source string, output string")
    got = {(x["output"], x["source"]): (x["name"], x["number"]) for x in jobs.name_outputs(frame, there).collect()}
    assert got == claims(queue, existing)
    few = {(x["output"], x["source"]): (x["name"], x["number"]) for x in jobs.name_outputs(frame.where("output = 'a.png'"), most=50).collect()}
    assert few["a.png", "s49"] == ("a (50).png", 50) and few["a.png", "s50"] == (None, None)
    assert jobs.name_outputs(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, None, None), (2, "x", None), (3, None, "b.png"), (4, "y", ".png"), (5, "z", ".png")], "seq long, source string, output string")
    assert {x["seq"]: x["name"] for x in jobs.name_outputs(odd).collect()} == {1: None, 2: None, 3: "b.png", 4: ".png", 5: ".png (2)"}


def test_group_sequence_and_runs(spark):
    r = random.Random(5)
    rows = [(r.choice("aaaaab"), r.randrange(500), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, t int, i int").repartition(7)
    got = {(x["g"], x["t"], x["i"]): x["n"] for x in group_sequence(frame, ["g"], ["t", "i"], "n").collect()}
    named = {(x["g"], x["t"], x["i"]): tuple(x["run"]) for x in runs(frame, ["g"], ["t", "i"], lambda before: F.col("t") - before("t") > 4).collect()}
    for g in "ab":
        own = sorted(x for x in rows if x[0] == g)
        assert [got[x] for x in own] == list(range(len(own)))
        for x, y in zip(own, own[1:], strict=False):
            assert (named[x] == named[y]) == (y[1] - x[1] <= 4)
    assert len({named[x] for x in named if x[0] == "a"} & {named[x] for x in named if x[0] == "b"}) == 0


@pytest.mark.parametrize("seed", range(3))
def test_throttled(spark, seed):
    """Dense and sparse stretches; 0.95 s and 1.01 s are not both let through at 1 s."""
    r = random.Random(seed)
    rows, at = [(0, 950_000, False, 0), (0, 1_010_000, False, 1)], {k: 0 for k in "123"}
    for i in range(2, 400):
        k = r.choice("1112223")
        at[k] += r.choice([0, 20_000, 120_000, 400_000, 1_000_000, 5_000_000])
        rows.append((int(k), at[k], r.random() < 0.05, i))
    frame = spark.createDataFrame(rows, "k int, us long, final boolean, i int").withColumn("at", F.timestamp_micros("us"))
    got = {x["i"] for x in ev.throttled(frame.repartition(5), "k", ["at", "i"], 1.0, "final").collect()}
    want, last = set(), {}
    for k, us, final, i in sorted(rows, key=lambda x: (x[0], x[1], x[3])):
        if k not in last or final or us - last[k] >= 1_000_000:
            want.add(i)
            last[k] = us
    assert got == want and 1 not in got
    assert ev.throttled(frame.limit(0), "k", ["at", "i"], 1.0, "final").collect() == []


def log_rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for item in range(6):
        at = 0
        for _ in range(60):
            at += r.choice([0, 10_000, 60_000, 150_000])
            what = r.random()
            row = (None, r.choice([r.random(), 1.0]), None) if what < 0.7 else (r.choice(list(ev.NEXT)), None, None) if what < 0.9 else (None, None, r.choice(["pause", "resume", "resume", "cancel"] if item % 2 else ["pause", "resume"]))
            out.append((item, 1_600_000_000_000_000 + at, len(out), *row))
        out.insert(-60, (item, 1_600_000_000_000_000, -2, "queued", None, None))
        out.insert(-60, (item, 1_600_000_000_000_000, -1, "processing", None, None))
    return out


def log_by_loop(rows: list[tuple], span: int) -> list[tuple]:
    """Written apart from the operator, as nested cases."""
    out, state = [], {}
    for item, at, _, status, progress, control in sorted(rows, key=lambda x: x[:3]):
        s = state.setdefault(item, {"status": "pending", "last": -(10**18), "paused": False, "cancelled": False})
        if control:
            if control == "cancel":
                s["cancelled"], s["paused"] = True, False
            else:
                s["paused"] = control == "pause" and not s["cancelled"]
        elif status:
            if status == "processing" and s["cancelled"]:
                status = "cancelled"
            legal = {"pending": {"queued"}, "queued": {"processing", "cancelled"}, "processing": {"done", "skipped", "failed", "cancelled"}}
            if status in legal.get(s["status"], set()) and not (status == "processing" and s["paused"]):
                s["status"], s["last"] = status, -(10**18)
                out.append((item, at, "status", status, None))
        elif s["status"] == "processing" and not s["paused"] and not s["cancelled"] and (at - s["last"] >= span or progress >= 1):
            s["last"] = at
            out.append((item, at, "progress", None, progress))
    return sorted(out, key=repr)


LOG = "item int, us long, tie long, status string, progress double, control string"


def micros(x) -> int:  # type: ignore[no-untyped-def]
    return round(x["at"].timestamp() * 1e6)


@pytest.mark.parametrize("seed", range(3))
def test_item_log(spark, seed):
    rows = log_rows(seed)
    frame = spark.createDataFrame(rows, LOG).withColumn("at", F.timestamp_micros("us")).drop("us")
    got = sorted(((x["item"], micros(x), x["kind"], x["status"], x["progress"]) for x in ev.item_log(frame.repartition(6), "item").collect()), key=repr)
    assert got == log_by_loop(rows, 100_000) and {x[2] for x in got} == {"status", "progress"}


def test_item_log_stream_equals_batch(spark, tmp_path):
    """Rows come late and out of order, over several files; the last file only moves the watermark."""
    rows = [(i, (us - 1_600_000_000_000_000) * 100 + 1_600_000_000_000_000, *rest) for i, us, *rest in log_rows(9)]
    r = random.Random(1)
    late = sorted(rows, key=lambda x: x[1] + r.randrange(50_000_000))
    schema = "item int, at timestamp, tie long, status string, progress double, control string"
    end = max(x[1] for x in rows) + 10**9
    parts = [late[k::1][:0] for k in range(0)] + [late[k : k + 90] for k in range(0, len(late), 90)] + [[(99, end, 0, None, None, None)], [(99, end + 1, 0, None, None, None)]]
    for k, part in enumerate(parts):
        frame = spark.createDataFrame(part, LOG).select("item", F.timestamp_micros("us").alias("at"), "tie", "status", "progress", "control")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    provider = next(iter(ev.STATE_STORE))
    before = spark.conf.get(provider)
    spark.conf.set(provider, ev.STATE_STORE[provider])
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        run = ev.item_log_stream(stream, "item", 10.0, "2 minutes").writeStream.format("memory").queryName("log").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
    finally:
        spark.conf.set(provider, before)
    got = sorted(((x["item"], micros(x), x["kind"], x["status"], x["progress"]) for x in spark.table("log").collect()), key=repr)
    assert got == log_by_loop(rows, 10_000_000)


def test_a_name_that_ten_thousand_want(spark):
    """Numbers go on beyond 9,999 unless a limit is asked for."""
    frame = spark.range(10_050).selectExpr("id as seq", "concat('s', id) as source", "'a.png' as output")
    last = jobs.name_outputs(frame).where("seq >= 9998").orderBy("seq").collect()
    assert [x["number"] for x in last] == list(range(9_999, 10_051)) and last[-1]["name"] == "a (10050).png"
