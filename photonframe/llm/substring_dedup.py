"""Substring dedup with a log-structured fingerprint index.

A window is 13 consecutive words. Its fingerprint is the least hash of the nine runs of five
words in it, so equal windows have equal fingerprints and neighbouring windows mostly share
one: a document has a fifth as many fingerprints as windows. The index is a set of immutable
runs, one for each ingested batch: tables of (fingerprint, doc_id) bucketed and sorted by
fingerprint, so that a new batch's run is merge-joined with each earlier run without a
shuffle. Fingerprints that two documents share are candidates; they are verified on the
whole windows: of the documents, new or stored, only those that have them are taken up again,
each window below such a fingerprint is hashed in full, and of the documents with the same
fingerprint and window hash all but the one with the least doc_id lose the window. (The two
hashes have 64 bits each; the window's chains its words one by one through a mixing step and
so does not follow from those that make the fingerprint. Words themselves are not compared.)
When ``fanout`` runs
have gathered they are compacted into one.

A fingerprint that many documents share is dealt over salts, about ``salt_rows`` documents
each: documents lose what an earlier one of their salt has, and only the first of each salt
goes into a second comparison of the salts.

Cases: null and short texts (fewer than 13 words) have no windows and stay whole; windows
that recur only within one document stay; documents with a null doc_id neither lose words
nor make others lose them; rows with the same doc_id count as one document and each get
their own result; empty batches add empty runs; only the id and text columns are read.
Documents are compared with what was ingested before and with their own batch: ingest in
order of doc_id, as ``dedup`` does, where the least id is to stay.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, release, table_path, whole_texts, words_of

WINDOW, GRAM = 13, 5
BROADCAST_IDS = 1_000_000  # candidates' ids (8 MB) that are broadcast at most
_GRAM_MIX, _WINDOW_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _rolling(words: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, mixed so that its order is arbitrary."""
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= factor
        out += words[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _chained(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; every word goes through a mixing step."""
    n = len(words) - width + 1
    out = np.full(n, _WINDOW_MIX)
    for k in range(width):
        out ^= words[k : k + n]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def window_hashes(words: list[bytes], full: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Fingerprint of each window, and its full hash."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = _rolling(each, GRAM, _GRAM_MIX)
    n = len(words) - WINDOW + 1
    least = grams[:n].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[k : k + n], out=least)
    return least.view(np.int64), _chained(each, WINDOW).view(np.int64) if full else None


def fingerprints(texts: DataFrame) -> DataFrame:
    """(fp, doc_id) of all windows, each once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(window_hashes(words_of(x.as_py()), full=False)[0]) for x in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(ids.astype(np.int64))], names=["fp", "doc_id"])

    return texts.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "fp long, doc_id long")


def _lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """List column from values in row order and their rows."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _candidate_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, fps, salts) to a row for each run of neighbouring windows with a
    candidate fingerprint: its first place and the window hashes."""
    names = ["fp", "salt", "salts", "doc_id", "crc", "start", "hashes"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            fp, salts, docs, crc, start, row, hashes, rows = [], [], [], [], [], [], [], 0
            part = batch.slice(at, 256)
            for doc, text, wanted, number in zip(part.column(0).to_pylist(), part.column(1), part.column(2), part.column(3), strict=True):
                raw = text.as_py() or ""
                own, full = window_hashes(words_of(raw))
                keys = wanted.values.to_numpy(zero_copy_only=False)
                order = np.argsort(keys)
                keys, per_key = keys[order], number.values.to_numpy(zero_copy_only=False)[order]
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == own)
                if not len(hit):
                    continue
                new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(own[hit]) != 0)])
                first = hit[new]
                fp.append(own[first])
                salts.append(per_key[place[first]])
                docs.append(np.full(len(first), doc, np.int64))
                crc.append(np.full(len(first), zlib.crc32(raw.encode("utf-8", "surrogatepass")), np.int64))
                start.append(first)
                row.append(rows + np.cumsum(new) - 1)
                hashes.append(full[hit])
                rows += len(first)
            if rows:
                fp, salts, docs, crc, start, row, hashes = (np.concatenate(x) for x in (fp, salts, docs, crc, start, row, hashes))
                salt = np.where(salts > 1, docs % np.maximum(salts, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(salt.astype(np.int64)), pa.array(salts.astype(np.int64)), pa.array(docs), pa.array(crc), pa.array(start.astype(np.int32)), _lists(hashes, row, rows, pa.int64())], names=names)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp, salt and doc_id: for each the windows that a smaller doc_id of the
    same fp and salt has, and, where there are several salts, those it is the first to have.
    Between batches only the windows of the last fp and salt are kept."""
    held = tuple(np.zeros(0, np.int64) for _ in range(4))  # fp, salt, doc, hash
    for batch in batches:
        fp, salt, salts, doc, crc, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        column = batch.column(6)
        hashes, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
        counts = np.diff(ends)
        row = np.repeat(np.arange(len(fp)), counts)
        place = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], counts) + start[row]
        k = len(held[0])
        f, s, d, h = (np.concatenate([a, b]) for a, b in zip(held, (fp[row], salt[row], doc[row], hashes), strict=True))
        order = np.lexsort((np.arange(len(f)), h, s, f))  # stable: the least doc_id first
        of, os, oh = f[order], s[order], h[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (os[1:] != os[:-1]) | (oh[1:] != oh[:-1])]) if len(f) else np.zeros(0, bool)
        least = np.empty(len(f), np.int64)
        least[order] = d[order][new][np.cumsum(new) - 1] if len(f) else least
        last = np.flatnonzero(new)[(of[new] == f[-1]) & (os[new] == s[-1])] if len(f) else np.zeros(0, np.int64)
        keep = order[last]
        late = d[k:] > least[k:]
        # All rows of the least document are first ones: another row of it may have the window too.
        first = (d[k:] == least[k:]) & (salts[row] > 1)
        held = (f[keep], s[keep], d[keep], h[keep])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), batch.column(4), _lists(place[late], row[late], len(fp), pa.int32()), _lists(place[first], row[first], len(fp), pa.int32()), _lists(hashes[first], row[first], len(fp), pa.int64())],
            names=["fp", "doc_id", "crc", "late", "first", "first_hashes"],
        )


_LATE = "fp long, doc_id long, crc long, late array<int>, first array<int>, first_hashes array<bigint>"


def _compare(rows: DataFrame) -> DataFrame:
    return rows.repartition("fp", "salt").sortWithinPartitions("fp", "salt", "doc_id").select("fp", "salt", "salts", "doc_id", "crc", "start", "hashes").mapInArrow(_later, _LATE)


def late_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, crc, late), stored: places of windows that a document with a smaller id has."""
    by_salt = materialize(_compare(rows), "by-salt")  # two readers
    firsts = by_salt.where(F.size("first") > 0).select("fp", "doc_id", "crc", F.explode(F.arrays_zip("first", "first_hashes")).alias("w"))
    between = _compare(firsts.select("fp", F.pmod("w.first_hashes", F.lit(1024)).alias("salt"), F.lit(1).cast("long").alias("salts"), "doc_id", "crc", F.col("w.first").alias("start"), F.array("w.first_hashes").alias("hashes")))
    late = materialize(by_salt.unionByName(between).where(F.size("late") > 0).select("doc_id", "crc", "late"), "late")
    discard(by_salt)
    return late


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _without(raw: bytes, removed: list[bool] | None) -> bytes:
    """The text without the removed words and the white space after each; all else stays."""
    if not removed or not any(removed):
        return raw
    head = raw[: len(raw) - len(raw.lstrip())]
    return head + b"".join(w for w, r in zip(_WORD.findall(raw), removed, strict=True) if not r)


def _apply(names: list[str], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, out = [], [], []
            for text, late in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                words, removed = raw.split(), None
                n.append(len(words))
                if late.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = late.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + WINDOW, -1)
                    removed = (np.cumsum(edge[:-1]) > 0).tolist()
                gone.append(sum(removed) if removed else 0)
                if keep_text:
                    out.append(_without(raw, removed).decode("utf-8", "surrogatepass"))
                else:
                    out.append(hashlib.sha256(b" ".join(w for w, r in zip(words, removed, strict=True) if not r) if removed else b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string()), *batch.columns[3:]], names=names)

    return run


class SubstringIndex:
    """The runs, and the documents that have been ingested."""

    def __init__(self, spark: SparkSession, fanout: int = 4, salt_rows: int = 1_000, buckets: int | None = None) -> None:
        self.spark, self.fanout, self.salt_rows = spark, fanout, salt_rows
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.paths: dict[str, str] = {}

    def _write_run(self, rows: DataFrame) -> str:
        """An immutable run: one table, bucketed and sorted by fingerprint."""
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp")
        self.paths[name] = table_path(self.spark, "run")
        writer.options(path=self.paths[name], compression="zstd", **{"parquet.writer.version": "v2"}).saveAsTable(name)
        return name

    def _counts(self, run: str) -> DataFrame:
        return self.spark.table(run).groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))

    def add(self, texts: DataFrame) -> DataFrame:
        """Append the run of a batch (doc_id, text); its candidates, from all runs:
        (doc_id, fps, salts) for each document with a fingerprint that two documents share,
        at least one of them in the batch."""
        new = self._write_run(fingerprints(texts))
        counts = self._counts(new)
        for run in self.runs:
            old = self._counts(run).select("fp", F.col("n").alias("n_"), F.col("low").alias("low_"), F.col("high").alias("high_"))
            counts = counts.join(old, "fp", "left").select("fp", (F.col("n") + F.coalesce("n_", F.lit(0))).alias("n"), F.least("low", "low_").alias("low"), F.greatest("high", "high_").alias("high"))
        shared = counts.where("low < high").select("fp", F.expr(f"1 + n div {self.salt_rows}").alias("salts"))
        self.runs.append(new)
        release(self.spark)
        hits = reduce(DataFrame.unionByName, (self.spark.table(run).join(shared, "fp") for run in self.runs))
        return hits.groupBy("doc_id").agg(F.collect_list("fp").alias("fps"), F.collect_list("salts").alias("salts"))

    def compact(self) -> None:
        """Merge all runs into one; the old ones go."""
        if len(self.runs) > 1:
            merged = self._write_run(reduce(DataFrame.unionByName, (self.spark.table(r) for r in self.runs)))
            self.drop()
            self.runs = [merged]

    def drop(self) -> None:
        """Take the runs out of the catalogue and delete their files. Only after everything
        that reads them has been written, as the results of ``ingest`` are."""
        for run in self.runs:
            table = self.spark.table(run)
            table.stored_at = self.paths.pop(run)
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            discard(table)
        self.runs = []

    def ingest(self, batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        """Ingest a batch (doc_id, text). stored: the documents ingested before, if any.
        (doc_id, crc, late) of documents of the batch that lose windows."""
        candidates = materialize(self.add(batch), "candidates")
        texts = batch if stored is None else stored.unionByName(batch)
        ids = candidates.select("doc_id")
        if ids.count() <= BROADCAST_IDS:  # then no text is shuffled that is no candidate
            texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
        rows = texts.join(candidates, "doc_id").select("doc_id", "text", "fps", "salts")
        rows = rows.mapInArrow(_candidate_windows, "fp long, salt long, salts long, doc_id long, crc long, start int, hashes array<bigint>")
        late = late_windows(rows)
        discard(candidates)
        release(self.spark)
        if len(self.runs) >= self.fanout:
            self.compact()
        return late


def dedup(docs: DataFrame, batches: int = 2, fanout: int = 4, salt_rows: int = 1_000, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; with ``whole`` kept_text (white
    space between words that stay is not touched) in place of the digest, and doc, a struct
    of all columns of docs.

    The documents are ingested in ``batches`` ranges of doc_id, in ascending order; the
    result does not depend on how many."""
    texts = whole_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    index = SubstringIndex(docs.sparkSession, fanout, salt_rows)
    cuts = texts.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    late = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        before = texts.where(F.col("doc_id") < low) if low is not None else None
        now = texts if low is None else texts.where(F.col("doc_id") >= low)
        now = now if high is None else now.where(F.col("doc_id") < high)
        late.append(index.ingest(now, before))
    index.drop()  # nothing is ingested after this
    late = reduce(DataFrame.unionByName, late).groupBy("doc_id", "crc").agg(F.flatten(F.collect_list("late")).alias("late"))
    doc = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if whole else [text_col]))).alias("doc")
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc).withColumn("crc", F.crc32(text.cast("binary")))
    joined = every.join(late, ["doc_id", "crc"], "left").select("doc_id", text.alias("text"), "late", *(["doc"] if whole else []))
    kinds = [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text" if whole else "kept_sha256", T.StringType()))]
    out = T.StructType(kinds + ([joined.schema["doc"]] if whole else []))
    return joined.mapInArrow(_apply(out.names, whole), out)


def strip(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, where repeated passages are gone from the text; n_chars, where
    there is one, follows."""
    found = dedup(docs, batches, whole=True, id_col=id_col, text_col=text_col)
    text = F.when((F.col("n_removed") == 0) & F.col(f"doc.`{text_col}`").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    new = {text_col: text, "n_chars": F.length("kept_text").cast("long")}
    return found.select(*((new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
