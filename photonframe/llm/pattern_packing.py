"""Best-fit packing by patterns: the histogram of lengths is fitted with few-document patterns.

A pattern is a multiset of at most ``most`` lengths that fill a sequence exactly. Spark makes
the pieces and counts their lengths; the driver sees that histogram alone, ``max_len`` numbers
at most. There non-negative least squares finds how often to repeat each pattern, counts are
rounded to what the histogram still holds, and the lengths left over are packed best-fit from
long to short, class of equal lengths by class. The plan, whose size ``max_len`` bounds, goes
to all tasks: the r-th piece of a length has its place in it. Ranks of pieces come from counts
by (task, length), so a length that a third of all pieces have is nobody's single task.

Cases: a null text counts as an empty one (its only id is the end id); an empty table gives
no rows; repeated rows are packed separately; pieces of equal length are interchangeable;
only the id and text columns are read, so other columns cannot clash; a null id stays null.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, whole_texts

# Fixed value: how byte-level models of this kind cut a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabularies of byte-level models: printable
    Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """Token ids of texts under a byte-level file of ``tokenizers``. Merges run in tiktoken over
    the file's own vocabulary, several times quicker for the same ids; it merges by the rank of
    the result, so the file's merges have to make their tokens in the order of their ids. A text
    that holds the string of a special token goes through ``tokenizers`` itself."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, byte_of = told["model"]["vocab"], _alphabet()
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [vocabulary[x + y] for x, y in merges]
        if told["model"]["type"] != "BPE" or made != sorted(made) or told.get("normalizer"):
            raise ValueError("a byte-level BPE file whose ids follow its merges is needed")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for text in ("The cat's  9 lives,\n\n", " a\t b\r\n c", "x日 é!! \u3000\x1c", "AAAA      bb"):
            if self.quick.encode_ordinary(text) != self._ids(text):
                raise ValueError("the file cuts texts by another pattern")

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self._ids(text) if any(t in text for t in self.special) else self.quick.encode_ordinary(text)


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


def cuts(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be short."""
    first = n % max_len or max_len
    return [(0, first), *((at, max_len) for at in range(first, n, max_len))]


def _cutter(tokenizer: str, end_id: int, max_len: int):  # type: ignore[no-untyped-def]
    """Of rows (doc_id, text): the pieces, each with its place among those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, met = TaskContext.get().partitionId(), byte_encoder(tokenizer), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = memoryview(np.array([*encoder.encode(text.as_py()), end_id], "<u4")).cast("B")
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, max_len)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, met[length]))
                        met[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def patterns(lengths: np.ndarray, total: int, most: int = 3) -> np.ndarray:
    """All multisets of at most ``most`` of the lengths whose sum is ``total``, one to a row, in
    rising order, filled up with zeros in front. lengths: rising, different, positive."""
    have = np.zeros(total + 1, bool)
    have[lengths[lengths <= total]] = True
    lengths, found, part = np.flatnonzero(have), [], np.zeros((1, 0), np.int64)
    for k in range(1, most + 1):
        last = part[:, -1] if k > 1 else np.zeros(1, np.int64)
        rest = total - part.sum(axis=1)
        ok = (rest >= last) & (rest > 0)
        ok[ok] = have[rest[ok]]
        found.append(np.pad(np.column_stack([part[ok], rest[ok]]), ((0, 0), (most - k, 0))))
        if k < most:
            longer = (lengths[None, :] >= last[:, None]) & (2 * lengths[None, :] <= rest[:, None])
            i, j = np.nonzero(longer)
            part = np.column_stack([part[i], lengths[j]])
    return np.concatenate(found)


def fit(rows: np.ndarray, held: np.ndarray, power: float = 0.5, rounds: int = 2000, together: int = 128) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns (rows of lengths) that bring the sum of squares of
    w (held - A x) low: non-negative least squares by coordinates. A round moves the patterns
    whose own best step gains most, up to ``together`` that share no length, none below zero; few
    patterns, each with a large count, carry the fit, so rounding loses little. Weights w are the
    root of the length, since short pieces that are left still find room. It ends when no step
    gains a ten-millionth of the first one; what it leaves after ``rounds`` is packed afterwards."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    weight = (np.arange(len(held)) / len(held)) ** (2 * power)  # squared
    same = (rows[:, :, None] == rows[:, None, :]) & (rows > 0)[:, :, None]
    square = (same * weight[rows][:, :, None]).sum(axis=(1, 2))
    left, most, least = held.astype(float), min(len(rows), 4 * together), None
    for _ in range(rounds):
        step = np.maximum((left * weight)[rows].sum(axis=1) / square, -x)
        gain = step * step * square
        best = np.argpartition(-gain, most - 1)[:most]
        best = best[np.argsort(-gain[best], kind="stable")]
        least = 1e-7 * gain[best[0]] if least is None else least
        if gain[best[0]] <= least:
            break
        own, first = rows[best], np.full(len(held), most)
        np.minimum.at(first, own.ravel(), np.repeat(np.arange(most), own.shape[1]))
        alone = ((own == 0) | (first[own] == np.arange(most)[:, None])).all(axis=1)
        moved = best[alone]
        x[moved] += step[moved]
        np.subtract.at(left, rows[moved].ravel(), np.repeat(step[moved], rows.shape[1]))
        left[0] = 0
    return x


def rounded(rows: np.ndarray, x: np.ndarray, held: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): x rounded down to whole numbers that the histogram holds, the most
    used patterns first. held becomes what is left."""
    out = []
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] < 1:
            break
        own = Counter(v for v in rows[j].tolist() if v)
        n = min(int(x[j]), *(int(held[v]) // k for v, k in own.items()))
        if n > 0:
            for v, k in own.items():
                held[v] -= n * k
            out.append((tuple(v for v in rows[j].tolist() if v), n))
    return out


def best_fit(held: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) for all that is held: best-fit from long to short, where equal lengths
    and sequences of equal contents are one class, so the work depends on the number of
    different lengths and not on how many pieces there are."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by free space
    for length in np.flatnonzero(held)[::-1].tolist():
        n = int(held[length])

        def place(free: int, pattern: tuple[int, ...], times: int) -> None:
            open_[free][pattern] = open_[free].get(pattern, 0) + times

        for free in sorted(f for f in open_ if f >= length):
            # One sequence takes as many of the length as it can, which is what best fit does
            while n and open_[free]:
                pattern, times = next(iter(open_[free].items()))
                each = min(free // length, n)
                take = min(times, n // each)
                open_[free][pattern] -= take
                if not open_[free][pattern]:
                    del open_[free][pattern]
                place(free - each * length, pattern + (length,) * each, take)
                n -= take * each
                if free - each * length >= length and each == n:
                    break
            if not n:
                break
        each = total // length
        if n // each:
            place(total - each * length, (length,) * each, n // each)
        if n % each:
            place(total - (n % each) * length, (length,) * (n % each), 1)
    return [(p, n) for free in sorted(open_) for p, n in open_[free].items()]


def plan(histogram: dict[int, int], max_len: int, most: int = 3, shares: tuple[float, ...] = (1.0, 0.9, 0.5, 0.2)) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) for a histogram of lengths: every piece has exactly one place. Of the
    fitted counts these ``shares`` are tried, the rest being packed best-fit; the least number
    of sequences wins."""
    held = np.zeros(max_len + 1, np.int64)
    for length, n in histogram.items():
        held[length] = n
    full = [((max_len,), int(held[max_len]))] if held[max_len] else []
    held[max_len] = 0
    rows = patterns(np.flatnonzero(held), max_len, most)
    x, tried = fit(rows, held), []
    for share in shares:
        left = held.copy()
        tried.append(rounded(rows, share * x, left) + best_fit(left, max_len))
    return full + min(tried, key=lambda p: sum(n for _, n in p))


_RANK_BITS = 44


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks: (length << 44 | first rank) rising, the sequence of the first rank, and the
    offset in each sequence. Sequences of a run are consecutive."""
    key, base, offset, given, at = [], [], [], Counter(), 0
    for pattern, n in planned:
        done = 0
        for length in pattern:
            key.append(length << _RANK_BITS | given[length])
            base.append(at)
            offset.append(done)
            given[length] += n
            done += length
        at += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(c, np.int64)[order] for c in (key, base, offset))  # type: ignore[return-value]


def _placer(shared):  # type: ignore[no-untyped-def]
    """Of rows (doc_id, piece, start, length, ids_crc32, rank): sequence and offset besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy()
            own = length << _RANK_BITS | rank
            at = np.searchsorted(key, own, side="right") - 1
            columns = [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(base[at] + own - key[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_patterns(docs: DataFrame, tokenizer: str, end_id: int = 2, max_len: int = 1024, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and their place in it; ``sequence_id`` is
    dense from 0. Ids are those of ``tokenizer`` (a byte-level file of the tokenizers library),
    then ``end_id``. ``most``: pieces in a fitted pattern."""
    spark = docs.sparkSession
    made = whole_texts(docs, id_col, text_col).mapInArrow(_cutter(tokenizer, end_id, max_len), "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long")
    pieces = materialize(made, "pattern-pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "pattern-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    runs = spark.sparkContext.broadcast(places(plan(histogram, max_len, most)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = materialize(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("first")), "pattern-ranks")
    ranked = pieces.join(first, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    out = materialize(ranked.mapInArrow(_placer(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"), "pattern-packed")
    discard(pieces, counts, first)
    return out
