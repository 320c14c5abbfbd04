"""SimHash near-duplicates over pivot distance tables.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Equal
fingerprints are one node. Every node is dealt to groups by what it has left when ``drop``
of its ``blocks`` blocks of bits are masked out, for each choice of blocks. Two fingerprints
at most ``drop`` bits apart agree in some such group, so no link is lost, and a group has at
most 2^(masked bits) different fingerprints (2^24), whatever the input. Within a group the
distances to many reference fingerprints are computed once; a pair whose distances to any
reference differ by more than the radius is discarded by the triangle inequality, and the
pairs that survive are verified bit by bit. Groups are connected along a spanning forest:
what the distances to a reference out of the group itself link directly needs no pairs among
itself, so a large group of near copies costs its size, not its square. Components of the forest's edges
are found by star steps.

Cases: null and empty texts have fingerprint zero and link like any other; fewer words than
a shingle give one shingle of the whole sequence; equal texts and repeated rows share a node
and so a component; null ids are never a component's name unless all its ids are null; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, whole_texts
from .graph import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(len(words) - width + 1, 1)
    spans = map(slice, starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    view, hash_ = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((hash_(view[s], seed) for s in spans), np.uint64, n)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), width) for x in batch.column(1)], pa.int64())], names=["doc_id", "fp"])

    texts = whole_texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, drop: int) -> list[int]:
    """For each choice of ``drop`` of the blocks, the bits that stay, as signed integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    full = (1 << 64) - 1
    masks = [full ^ sum(own[i] for i in gone) for gone in combinations(range(blocks), drop)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivots(count: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference, (fingerprints, references)."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :])


def group_links(fps: np.ndarray, radius: int, refs: np.ndarray, block: int = 1024, small: int = 64, own: int = 32) -> list[tuple[int, int]]:
    """Edges (indices) that connect what links within ``radius`` connect in the group.

    The distance table comes first: the distances of all members to the references. A group
    of more than ``small`` members gets up to ``own`` references of its own besides, members
    that no reference before is near; what the table shows to be within the radius of such a
    one is linked to it and needs no pairs among itself. All other pairs in different parts
    are discarded where any coordinate differs by more than the radius, and the survivors
    are verified bit by bit."""
    n = len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    edges: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))

    table = pivot_table(fps, refs).astype(np.int16)
    free = np.ones(n, bool)
    for _ in range(own if n > small else 0):
        if not free.any():
            break
        pick = int(np.argmax(free))
        column = pivot_table(fps, fps[pick : pick + 1]).astype(np.int16)
        table = np.concatenate([table, column], axis=1)
        near = column[:, 0] <= radius
        for j in np.flatnonzero(near).tolist():
            join(pick, j)
        free &= ~near
    # All pairs left have at least one member outside the largest part.
    part = np.array([root(i) for i in range(n)])
    names, sizes = np.unique(part, return_counts=True)
    if len(names) == 1:
        return edges
    outside = np.flatnonzero(part != names[sizes.argmax()])
    order = np.argsort(table[:, 0], kind="stable")  # by the first coordinate: only a slice can survive
    first = table[order, 0]
    for at in range(0, len(outside), block):
        rows = outside[at : at + block]
        rows = rows[np.argsort(table[rows, 0], kind="stable")]
        lo, hi = np.searchsorted(first, table[rows[0], 0] - radius), np.searchsorted(first, table[rows[-1], 0] + radius, side="right")
        for to in range(lo, hi, block):
            cols = order[to : min(to + block, hi)]
            alive = part[rows][:, None] != part[cols][None, :]
            for k in range(table.shape[1]):
                if not alive.any():
                    break
                alive &= np.abs(table[rows, k][:, None] - table[cols, k][None, :]) <= radius
            x, y = np.nonzero(alive)
            good = np.bitwise_count(fps[rows[x]] ^ fps[cols[y]]) <= radius
            for i, j in zip(rows[x[good]].tolist(), cols[y[good]].tolist(), strict=True):
                join(i, j)
    return edges


def links(nodes: DataFrame, radius: int = 3, blocks: int = 8, references: int = 32) -> DataFrame:
    """Edges (a, b) between different fingerprints at most ``radius`` bits apart, enough to
    connect all that such links connect. nodes: (fp long), each once."""
    masks = F.array(*(F.lit(m).cast("long") for m in block_masks(blocks, radius)))
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # each row becomes 56
    dealt = nodes.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"))
    groups = dealt.groupBy("choice", "kept").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(references)
        for batch in batches:
            a, b = [], []
            for x in batch.column(0):
                fps = np.sort(x.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                for i, j in group_links(fps, radius, refs):
                    a.append(fps[i])
                    b.append(fps[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (a, b)], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    member = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Both sides of the join are then read as they are, so that a large component can be split.
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = named.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- exact similarity, for texts that a few bits of 64 do not reach
SAMPLE = 16  # one text in so many is asked which shingles are common
COMMON = 8  # texts of the sample that make a shingle common
LISTED = 1 << 17  # common shingles that are broadcast at most, the most common first
HUBS = 6  # members of a meeting place that are compared with all others first
MARKS = 1 << 24  # places of the marks by which texts are read again


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles, lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(len(words) - width + 1, 1)
    spans = map(slice, (ends - lengths)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    view, hash_ = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_(view[s]) for s in spans), np.uint64, n))


def node_of(grams: np.ndarray) -> int:
    """A name for a set of shingles, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def majority(grams: np.ndarray) -> int:
    """The set's SimHash: bits that more than half of the hashes have, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), CHUNK):
        bits = np.unpackbits(grams[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)[0])


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each place that some shingle takes, of four places or more for each shingle
    (a power of two). Two bitmaps differ in at most as many bits as their sets have shingles
    that the other lacks; the same holds when the longer one is folded to the other's size."""
    size = max(512, 4 << int(len(grams) - 1).bit_length()) if len(grams) else 512
    bits = np.zeros(size, np.uint8)
    bits[grams % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bitmap_distance(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


CLASSES = 64


def class_counts(grams: np.ndarray) -> np.ndarray:
    """How many shingles fall into each class of hashes, 127 at most: two such rows of counts
    are no further apart in sum than one set has shingles that the other lacks, both ways."""
    return np.minimum(np.bincount((grams >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES), 127).astype(np.int8)


def prefix_size(n: int, similarity: float) -> int:
    """So many of n shingles, the first in an order that all texts share, hold at least one
    that any text of the similarity has among its own first ones."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and how often a sample of the texts has them. They only settle the
    order of shingles; any order gives the same pairs, this one gives small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), width).view(np.int64))], names=["gram"])

    counted = texts.where(f"pmod(text_hash, {SAMPLE}) = 0").select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(LISTED).toArrow()
    grams = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found["n"].to_numpy()[order]


_ROW = [("text_hash", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64())), ("classes", pa.list_(pa.int8()))]


def _prefixes(shared, width: int, similarity: float):  # type: ignore[no-untyped-def]
    """Of rows (doc_id, text, text_hash): doc_id and what ``_ROW`` names, rare shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for batch in batches:
            nodes, prints, sizes, bitmaps, prefixes, classes = [], [], [], [], [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), width)
                weight = np.zeros(len(grams), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    weight = np.where(common[at] == grams, often[at], 0)
                nodes.append(node_of(grams))
                prints.append(majority(grams))
                sizes.append(len(grams))
                bitmaps.append(bitmap(grams))
                classes.append(class_counts(grams))
                prefixes.append(grams[np.argsort(weight, kind="stable")[: prefix_size(len(grams), similarity)]].view(np.int64))
            own = (nodes, prints, sizes, bitmaps, prefixes, classes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, (_, t) in zip(own, _ROW[1:], strict=True))], names=["doc_id", *(n for n, _ in _ROW)])

    return run


def _sets(shared, width: int):  # type: ignore[no-untyped-def]
    """Of rows (text, text_hash) whose place is marked: (node, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(MARKS, bool)
        marked[shared.value] = True
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            wanted = np.flatnonzero(marked[hashes % MARKS])
            nodes, sets = [], []
            for i in wanted.tolist():
                if hashes[i] not in seen:
                    seen.add(hashes[i])
                    grams = shingles(batch.column(0)[i].as_py(), width)
                    nodes.append(node_of(grams))
                    sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "grams"])

    return run


def _possible(similarity: float):
    """Of pairs (a, b, n, other_n, bits, other_bits, hash, other_hash) those that sizes and
    bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.array([bitmap_distance(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            most = (all_ - apart) / 2
            mask = pa.array(most * (1 + similarity) >= similarity * all_ - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1, 6, 7)], names=["a", "b", "hash", "other_hash"])

    return run


def _alike(similarity: float):
    """Of pairs (a, b, ga, gb) those of the similarity, by their whole sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(same >= similarity * (len(both) - same) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def print_pairs(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash nominates: nodes of a fingerprint with the least of
    them, and the least ones of fingerprints that ``links`` connects. nodes: (node, fp)."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"), radius).withColumnsRenamed({"a": "x", "b": "y"})
    ends = [first.select(F.col("fp").alias(k), F.col("first").alias(n)) for k, n in (("x", "m"), ("y", "n"))]
    near = near.join(ends[0], "x").join(ends[1], "y").select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"))
    return same.unionByName(near).distinct()


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component, component_id) for every row: components of all pairs of
    texts whose sets of shingles have at least this Jaccard similarity, and of no others.

    Texts with the same set are one node. Pairs are nominated in three rounds, and the whole
    sets decide on each: first what SimHash over the pivot tables links, which gathers the
    copies; then, since SimHash finds a pair at the threshold by chance only, the meeting
    places: two sets of the similarity share one of their first shingles (``prefix_size``) in
    any order common to all texts, so no pair is left out; with rare shingles first, what many
    texts share is no meeting place unless a text has little else. At a meeting place the
    sizes and the places of the shingle in the order rule out pairs. Where members are still
    in different components, all are compared with ``HUBS`` of them; where that leaves
    different components, all pairs across components are compared that counts of their
    shingles by class (``class_counts``) do not rule out."""
    spark = docs.sparkSession
    texts = whole_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    listed = spark.sparkContext.broadcast(_common(texts, width))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(texts.mapInArrow(_prefixes(listed, width, similarity), f"doc_id {id_type}, text_hash long, node long, fp long, n int, bits binary, prefix array<long>, classes array<tinyint>"), "prefixes")
    nodes = materialize(rows.select("node", "fp", "n", "bits", "text_hash", "classes").dropDuplicates(["node"]), "nodes")
    release(spark)

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of the similarity. The sets that the bitmaps leave are made from the
        texts again: kept from the start, they would take more room than the texts."""
        one = nodes.select(F.col("node").alias("a"), "n", "bits", F.col("text_hash").alias("hash"))
        two = nodes.select(F.col("node").alias("b"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"), F.col("text_hash").alias("other_hash"))
        sizes = F.least("n", "other_n") >= similarity * F.greatest("n", "other_n") - 1e-6
        both = pairs.join(one, "a").join(two, "b").where(sizes).select("a", "b", "n", "other_n", "bits", "other_bits", "hash", "other_hash")
        left = materialize(both.mapInArrow(_possible(similarity), "a long, b long, hash long, other_hash long"), "possible")
        marks = left.select(F.explode(F.array("hash", "other_hash")).alias("hash")).select(F.pmod("hash", F.lit(MARKS)).cast("int").alias("at")).distinct()
        marks = spark.sparkContext.broadcast(marks.toArrow()["at"].to_numpy())  # MARKS at most
        release(spark)
        sets = materialize(texts.select("text", "text_hash").mapInArrow(_sets(marks, width), "node long, grams binary").dropDuplicates(["node"]), "sets")
        release(spark)
        both = left.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
        found = materialize(both.select("a", "b", "ga", "gb").mapInArrow(_alike(similarity), "a long, b long"), "alike")
        discard(left, sets)
        release(spark)
        return found

    def near(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
        return F.least(n - pos, other_n - other_pos) * (1 + similarity) >= similarity * (n + other_n) - 1e-6

    pairs = materialize(print_pairs(nodes.select("node", "fp")), "pairs")
    links_ = alike(pairs)

    place = Window.partitionBy("key")
    met = rows.select("node", "n", "prefix").dropDuplicates(["node"]).select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    met = met.withColumns({"low": F.min("node").over(place), "high": F.max("node").over(place)}).where("low < high").drop("low", "high")
    met = materialize(met, "meetings")
    release(spark)

    def still_open() -> DataFrame:
        """Members of meeting places that are not all in one component, and their part."""
        part = components(links_).withColumnRenamed("component", "part")
        parts = met.join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
        parts = parts.withColumns({"low": F.min("part").over(place), "high": F.max("part").over(place)}).where("low < high").drop("low", "high")
        return materialize(parts, "open")

    every = met
    met = still_open()
    discard(every)
    ok = near(F.col("n"), F.col("pos"), F.col("other_n"), F.col("other_pos"))
    other = met.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "pos")))
    every = met
    met = materialize(met.drop("part").join(other, (met["key"] == other["key"]) & (F.col("node") != F.col("other_node")) & ok, "left_semi"), "meetings")
    discard(every)
    open_ = still_open()
    hubs = F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("rank"), "node", "n", "pos", "part")).over(place) for k in range(HUBS)))
    apart = lambda h: (h["part"] != F.col("part")) & near(F.col("n"), F.col("pos"), h["n"], h["pos"])
    first = open_.withColumn("hubs", hubs).withColumn("hub", F.explode(F.filter("hubs", apart)))
    more = first.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialize(more, "pairs")
    release(spark)
    discard(open_)
    links_, pairs = links_.unionByName(alike(more)), pairs.unionByName(more)
    open_ = still_open()
    # Counts by class rule out most pairs of what is left before they are pairs
    counted = open_.join(nodes.select("node", "classes"), "node")
    other = counted.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "pos", "part", "classes")))
    apart = F.aggregate(F.zip_with("classes", "other_classes", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda total, x: total + x)
    few = apart * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("other_n")) + 1e-6
    across = counted.join(other, (counted["key"] == other["key"]) & (F.col("node") < F.col("other_node")) & (F.col("part") != F.col("other_part")) & ok & few)
    across = across.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    member = components(links_.unionByName(alike(materialize(across, "pairs"))))
    named = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Both sides of the joins are then read as they are, so that a large component can be split.
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = materialize(named.join(least, "component").select("node", "component", "component_id"), "components")
    out = rows.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", "component", "component_id")
    out = materialize(out, "similar")
    discard(rows, nodes, met, open_, named)
    release(spark)
    return out


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component of similar texts, with its columns: the one with the
    least id; of repeated rows one. Only ids and hashes decide; texts move once, at the end."""
    found = similar(docs, width, similarity, id_col=id_col, text_col=text_col)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))  # few rows of a component are left
    order = Window.partitionBy("component").orderBy("text_hash")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    stay = first.withColumn("n", F.row_number().over(order)).where("n = 1").select(name.alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    rows = rows.withColumns({"_id": F.coalesce(F.col(f"doc.`{id_col}`").cast("string"), F.lit("null")), "_hash": F.xxhash64(text)})
    again = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    return rows.join(stay, ["_id", "_hash"], "left_semi").withColumn("n", F.row_number().over(again)).where("n = 1").select("doc.*")
