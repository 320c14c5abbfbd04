"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is there and holds neither null nor non-finite
    entries; no other column is read."""
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", finite))


def whole(values: np.ndarray, most: float) -> np.ndarray:
    """floor(1024 c) of doubles, which is exact as 1024 is a power of two. Entries beyond
    ``most`` would not leave room for exact squares and sums in 64 bits: they raise."""
    x = np.floor(values * SCALE)
    if x.size and float(np.abs(x).max()) > most:
        raise ValueError(f"a vector has an entry beyond {most / SCALE:.3g}: its squares do not fit 64 bits")
    return x.astype(np.int64)


def by_length(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, values as a matrix) of the vectors of each length in a batch."""
    offsets = column.offsets.to_numpy()
    flat, start, length = column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)
    out = []
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        out.append((rows, flat[start[rows][:, None] + np.arange(n)[None, :]]))
    return out
