"""Packing: bounded-space online bin packing of token sequences.

Every task streams its documents. A document's ids are cut into pieces of at most
``max_len``; full pieces become sequences at once, the rest goes best-fit into one of
``open_windows`` open windows. When none fits, the fullest window is emitted. Windows
that are still open when the task ends are leftovers; the leftovers of
``merge_tasks`` neighbouring tasks are packed once more, whole window by whole window,
by the same rule. State is ``open_windows`` windows of pieces, whatever the input size.

Cases: a null text counts as an empty one (its only id is the end id); empty tables give
no rows; repeated rows are packed separately; equal candidates are resolved towards the
window opened first; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_texts

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = f"{PIECE}, sequence_id long, offset long"


_MARKS = re.compile(rb"(?<=[a-z0-9])([.,;:!?]+)(?=[\x20\x09-\x0D]|$)")


def _split_words(text: str) -> list[bytes]:
    """Words whose ids together are the text's: the models meant here lower-case, drop white
    space, and cut between a letter or digit and a mark, so fewer different words are met
    when ASCII capitals are lowered and marks at a word's end stand alone. Texts that might
    hold the name of a special token stay as they are."""
    raw = text.encode("utf-8", "replace")
    return raw.split() if b"<|" in raw else _MARKS.sub(rb" \1", raw.lower()).split()


class WordEncoder:
    """Token ids of texts under a ``tokenizers`` model that lower-cases, never joins across
    ASCII white space and cuts words from marks; ids of words are kept, at most ``keep`` of
    them, so that a word is encoded once."""

    def __init__(self, path: str, keep: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.model, self.keep = Tokenizer.from_file(path), keep
        ids = lambda text: self.model.encode(text, add_special_tokens=False).ids
        for whole, parts in (("The cat", ["the", "cat"]), ("a\t\n b", ["a", "b"]), ("End. no", ["end", ".", "no"]), ("x9?! é", ["x9", "?!", "é"])):
            if ids(whole) != [i for p in parts for i in ids(p)]:
                raise ValueError("a tokenizer is needed that lower-cases, drops white space and cuts words from marks")
        self.seen: dict[bytes, bytes] = {}

    def learn(self, new: set[bytes]) -> None:
        words = sorted(new)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for w, e in zip(part, self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.seen[w] = array("I", e.ids).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as unsigned 32-bit integers in the machine's order, which Spark's own machines
        have little-endian."""
        words = [_split_words(text) for text in texts]
        parts = [list(map(self.seen.get, w)) for w in words]
        new = {w for own, found in zip(words, parts, strict=True) if None in found for w, x in zip(own, found, strict=True) if x is None}
        if len(self.seen) + len(new) > self.keep:
            self.seen.clear()
            new = set().union(*words)
            parts = [[None]] * len(words)
        self.learn(new)
        return [b"".join(map(self.seen.__getitem__, own) if None in found else found) for own, found in zip(words, parts, strict=True)]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def word_encoder(path: str, keep: int) -> WordEncoder:
    """One for each worker process; tasks that reuse the worker reuse what it has learnt."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = WordEncoder(path, keep)
    return _ENCODERS[path, keep]


class OpenWindows:
    """At most ``k`` open windows, found best-fit by free space."""

    def __init__(self, k: int, size: int) -> None:
        self.k, self.size, self.count = k, size, 0
        self.free: list[tuple[int, int]] = []  # (free space, number), sorted
        self.items: dict[int, list] = {}

    def put(self, item: object, length: int) -> list | None:
        """Place the item; the window that had to leave, if one had to."""
        out, at = None, bisect_left(self.free, (length, -1))
        if at < len(self.free):
            space, n = self.free.pop(at)
        else:
            if len(self.free) >= self.k:
                out = self.items.pop(self.free.pop(0)[1])
            space, n = self.size, self.count
            self.count += 1
            self.items[n] = []
        self.items[n].append(item)
        if space > length:
            insort(self.free, (space - length, n))
            return out
        full = self.items.pop(n)
        return full if out is None else out + [None] + full

    def rest(self) -> list[list]:
        return [self.items[n] for _, n in sorted(self.free)]


def _split(windows: list | None) -> list[list]:
    """put() may emit two windows at once, with None in between."""
    if windows is None:
        return []
    if None in windows:
        at = windows.index(None)
        return [windows[:at], windows[at + 1 :]]
    return [windows]


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _packer(encoder: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int, max_len: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, end, windows, number = encoder(), np.array([end_id], "<u4").tobytes(), OpenWindows(k, max_len), 0
        rows: list[tuple] = []

        def emit(window: list, leftover: bool) -> None:
            nonlocal number
            offset = 0
            for piece in window:
                rows.append((*piece, (task << 32) + number, offset, leftover, task))
                offset += piece[2]
            number += 1

        for doc_id, body in ((d, x) for batch in batches for part in _slices(batch) for d, x in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True)):
            ids = body + end
            n = len(ids) // 4
            for start in range(0, n, max_len):
                part = ids[4 * start : 4 * (start + max_len)]
                piece = (doc_id, start, len(part) // 4, zlib.crc32(part), n)
                if piece[2] == max_len:
                    emit([piece], False)
                else:
                    for w in _split(windows.put(piece, piece[2])):
                        emit(w, False)
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows.clear()
        for w in windows.rest():
            emit(w, True)
        yield _batch(rows)

    return run


_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("leftover", pa.bool_()), ("task", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def _merger(k: int, max_len: int):
    """Streams leftover windows (rows sorted by sequence_id, offset) and packs them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, windows, number = TaskContext.get().partitionId(), OpenWindows(k, max_len), 0
        rows: list[tuple] = []

        def emit(packed: list) -> None:
            nonlocal number
            offset = 0
            for piece in (p for window in packed for p in window):
                rows.append((*piece[:5], (1 << 62) + (task << 32) + number, offset))
                offset += piece[2]
            number += 1

        def close(window: list) -> None:
            if window:
                for w in _split(windows.put(window, sum(p[2] for p in window))):
                    emit(w)

        window: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if window and window[0][5] != row[5]:
                    close(window)
                    window = []
                window.append(row)
            yield _out(rows)
            rows.clear()
        close(window)
        for w in windows.rest():
            emit(w)
        yield _out(rows)

    return run


def _out(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(list(_ARROW)[:7])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, max_len: int = 2048, open_windows: int = 64, merge_tasks: int = 64, keep_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and their place in it.

    ``sequence_id`` is unique, not dense. Ids are those of ``tokenizer`` (a file of the
    tokenizers library whose model keeps white-space-separated words apart), then ``end_id``.
    ``keep_words``: words whose ids a Python worker remembers at most."""
    pieces = whole_texts(docs, id_col, text_col).mapInArrow(_packer(lambda: word_encoder(tokenizer, keep_words).encode_many, end_id, max_len, open_windows), f"{SCHEMA}, leftover boolean, task long")
    pieces = materialize(pieces, "pieces")  # both branches below read it
    done = pieces.where(~F.col("leftover")).drop("leftover", "task")
    left = pieces.where("leftover").withColumn("group", F.expr(f"task div {merge_tasks}"))
    merged = left.repartition(F.col("group")).sortWithinPartitions("sequence_id", "offset").select(*done.columns).mapInArrow(_merger(open_windows, max_len), SCHEMA)
    return done.unionByName(merged)
