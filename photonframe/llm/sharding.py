"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact sizes.

Every source unit sends an exact number of rows to every shard. A unit is a run of at most
``UNIT`` rows of one source partition; partition and place are columns of the stored rows, so
a row's unit does not depend on how the stored files are split when they are read. The matrix
of the numbers follows the multivariate hypergeometric law, so that all assignments with the
given shard sizes are equally likely. It is never built whole: units are the leaves of a
binary tree whose nodes split their shard totals between the two halves, each by a draw
seeded by the node, and a task walks down to the rows of its own units. A unit's labels are
permuted locally. Rows are exchanged by shard and block and permuted again by a random key; a
block is a range of keys holding about ``block_rows`` rows, so no task gets a whole shard.

Cases: null texts have size 16 and the checksum of an empty text; repeated rows are rows of
their own; ties of the random key are broken by source partition and place; an empty table
gives no rows; with fewer rows than shards some shards are empty; the operator's columns
shard and slot replace columns of the same name; any number of rows up to 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UNIT = 1 << 16
NUMPY_MOST = 10**9  # NumPy draws from fewer balls than this


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """At most one apart; the first shards get the rest."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's approximation."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    v = 1 / (n * n)
    return (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v / 1680))) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation near the mean."""
    d = x - mean
    if abs(d) >= 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    v = d / (x + mean)
    total, term, k = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _log_binomial(x: int, n: int, share: float) -> float:
    """Log-probability by the saddle-point expansion, exact to rounding for any n."""
    if x == 0 or x == n:
        return n * log(1 - share if x == 0 else share) if n else 0.0
    return _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * share) - _deviance(n - x, n * (1 - share)) + 0.5 * log(n / (2 * pi * x * (n - x)))


def _log_law(x: int, good: int, bad: int, n: int) -> float:
    share = n / (good + bad)
    return _log_binomial(x, good, share) + _log_binomial(n - x, bad, share) - _log_binomial(n, good + bad, share)


def rejection(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good balls among n drawn without replacement, for counts of any size:
    rejection from the envelope that holds for every log-concave law on the integers, flat
    around the mode and exponential beyond."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    top = _log_law(mode, good, bad, n)
    p = exp(top)
    w = 1 + p / 2
    while True:
        flat = rng.random() * (1 + w) <= w
        y = (rng.random() * w if flat else w + rng.exponential()) / p
        x = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= x <= high and log(1 - rng.random()) + min(0.0, w - p * y) <= _log_law(x, good, bad, n) - top:
            return x


def draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """n draws without replacement from an urn with these colours."""
    total = int(colours.sum())
    if total < NUMPY_MOST:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out = np.zeros(len(colours), np.int64)
    for i, own in enumerate(colours.tolist()):
        total -= own
        out[i] = rejection(rng, own, total, n)
        n -= int(out[i])
    return out


def matrix_row(starts: np.ndarray, sizes: np.ndarray, unit: int, seed: int) -> np.ndarray:
    """Row ``unit`` of the communication matrix. starts: rows before each unit, and all rows
    at the end; its memory is one number for each unit."""
    low, high, totals = 0, len(starts) - 1, sizes
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(np.random.default_rng((seed, low, high)), totals, int(starts[mid] - starts[low]))
        low, high, totals = (low, mid, left) if unit < mid else (mid, high, totals - left)
    return totals


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the task that writes it and its place there."""
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(place, place + n))], names=[*batch.schema.names, "_part", "_place"])
        place += n


def _assign(first_unit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int):  # type: ignore[no-untyped-def]
    def labels(unit: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng((seed, unit, 1 << 30))
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(starts, sizes, unit, seed))
        rng.shuffle(own)
        return own, rng.integers(0, 1 << 62, len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            part, place = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_part", "_place"))
            unit = first_unit[part] + place // UNIT
            shard, key = np.empty(len(unit), np.int32), np.empty(len(unit), np.int64)
            for u in np.unique(unit).tolist():
                if u not in held:
                    if len(held) >= 4:
                        held.pop(next(iter(held)))
                    held[u] = labels(u)
                own = unit == u
                shard[own], key[own] = (x[place[own] % UNIT] for x in held[u])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(key)], names=[*batch.schema.names, "shard", "_key"])

    return run


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 0, block_rows: int = 500_000) -> DataFrame:
    """``rows`` with shard (int) and slot (long, gapless from 0 in the shard)."""
    rows = rows.drop("shard", "slot", "_key", "_part", "_place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema += ", _part long, _place long"
    rows = materialize(rows.mapInArrow(_numbered, schema), "to-shard")
    counts = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}  # one number for each task that wrote
    sizes_ = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    first_unit = np.cumsum([0] + [-(-n // UNIT) for n in sizes_], dtype=np.int64)
    starts = np.cumsum([0] + [min(UNIT, n - at) for n in sizes_ for at in range(0, n, UNIT)], dtype=np.int64)
    total = int(starts[-1])
    placed = rows.mapInArrow(_assign(first_unit, starts, shard_sizes(total, shards), seed), schema + ", shard int, _key long")
    blocks = max(1, -(-total // (shards * block_rows)))
    placed = placed.withColumn("_block", F.expr(f"cast(floor(_key / {float(1 << 62)!r}D * {blocks}) as int)"))
    by_block = Window.partitionBy("shard", "_block").orderBy("_key", "_part", "_place")
    slotted = placed.withColumn("slot", F.row_number().over(by_block) - F.lit(1).cast("long"))
    if blocks > 1:
        before = Window.partitionBy("shard").orderBy("_block")
        offsets = placed.groupBy("shard", "_block").count().withColumn("_before", F.sum("count").over(before) - F.col("count")).drop("count")
        slotted = slotted.join(offsets, ["shard", "_block"]).withColumn("slot", F.col("slot") + F.col("_before")).drop("_before")
    return slotted.drop("_key", "_part", "_place", "_block").withColumn("slot", F.col("slot").cast("long"))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32); both by Spark's own functions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
