"""Lloyd's algorithm over two trees: a cover tree of the vectors and one of the centroids.

Vectors are dealt to blocks of at most ``block`` rows as they are read. A block keeps its
different vectors once, with their numbers of copies, in a cover tree: a node's children lie
within its level's radius, nodes of a level lie further apart than that radius, and every node
is its own first child. Trees are made once and written; each round broadcasts the centroids,
k vectors, whose own tree a task makes anew. From both roots downwards a pair of nodes is left
out where its least possible distance exceeds the greatest possible distance to another
centroid node; a vector node with one centroid left is taken as a whole, by its sums, and what
reaches the leaves is compared exactly, in whole numbers. Blocks pass on k sums.

Cases: rows without a vector, or of another number of components, or with null or non-finite
entries, are dropped; an empty table gives no rows; fewer vectors than centroids start fewer
clusters; a null id stays null and starts no cluster while there are others; equal and
repeated rows each count; ties go to the smaller number; an empty cluster stays where it is;
other columns are not read. An entry beyond 2^17 has no exact 64-bit distances and raises.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import usable, whole

MOST = float(1 << 27)
#: Below this, sums of 2^8 products are exact as doubles, and far quicker.
EXACT = 1 << 22


@dataclass
class CoverTree:
    """Nodes in order of depth: the children of a node are consecutive, and so are the points
    below it. points are in the tree's order; order gives their places in the input."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray  # a place in points
    radius: np.ndarray  # no point below lies further from the centre
    level: np.ndarray  # children lie within first / 2^(level - 1) of their parent
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return self.children == 0


def _apart(points: np.ndarray) -> np.ndarray:
    """Distances of all pairs, near enough to shape a tree; bounds do not rest on them."""
    x = (points - points[0]).astype(float)
    squares = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0))


def cover_tree(points: np.ndarray, leaf: int = 16) -> CoverTree:
    """The cover tree of different points; nodes of at most ``leaf`` points are not divided."""
    n = len(points)
    far = _apart(points)
    near, own = far[0].copy(), np.zeros(n, np.int64)
    kids: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (level, point), rising levels
    picked, reach, level = [0], float(near.max()), 0
    top = reach
    while len(picked) < n:
        level += 1
        reach = top / 2**level
        above = own.copy()  # the nearest of the level above
        while len(picked) < n:
            at = int(near.argmax())
            if near[at] <= reach:
                break
            kids[above[at]].append((level, at))
            picked.append(at)
            closer = far[at] < near
            closer[at] = True
            near[closer], own[closer] = far[at][closer], at
            near[at] = -1.0
        if reach < 0.5:  # what is left are points that rounding took for one
            rest = np.setdiff1d(np.arange(n), picked).tolist()
            for at in rest:
                kids[0].append((level + 1, at))
            picked += rest
    below = [1] * n
    for at in reversed(picked):
        below[at] += sum(below[c] for _, c in kids[at])

    def count(at: int, since: int) -> int:
        return 1 + sum(below[c] for _, c in kids[at][since:])

    def members(at: int, since: int) -> list[int]:
        found, todo = [], [(at, since)]
        while todo:
            p, k = todo.pop()
            found.append(p)
            todo += [(c, 0) for _, c in kids[p][k:]]
        return found

    # Depth by depth; a node is a point and how many of its children stand above
    order: list[int] = []
    centre, first, last, child, children, levels = [], [], [], [], [], []
    queue = [(0, 0, 0, 0)]
    slots = np.zeros(n, np.int64)
    for at, since, start, depth in queue:
        size = count(at, since)
        centre.append(at)
        first.append(start)
        last.append(start + size)
        levels.append(depth)
        if size <= leaf:
            slots[start : start + size] = members(at, since)
            child.append(0)
            children.append(0)
            continue
        depth = kids[at][since][0]
        same = [c for lv, c in kids[at][since:] if lv == depth]
        child.append(len(queue))
        children.append(1 + len(same))
        place = start
        for c, k in [(at, since + len(same)), *((c, 0) for c in same)]:
            queue.append((c, k, place, depth))
            place += count(c, k)
    order = slots
    sorted_ = points[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    centre, first, last = place[np.array(centre)], np.array(first), np.array(last)
    radius = np.array([np.sqrt(float(((sorted_[a:b] - sorted_[c]) ** 2).sum(axis=1).max())) for c, a, b in zip(centre.tolist(), first.tolist(), last.tolist(), strict=True)])
    return CoverTree(sorted_, order, centre, radius * (1 + 1e-12), np.array(levels), first, last, np.array(child), np.array(children))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of y, as 64-bit numbers."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0))) < EXACT and x.shape[1] <= 256:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in y], axis=1)


def assign(tree: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, int]:
    """For every point of the tree the number of its nearest centroid, ties to the smaller one,
    and how many exact comparisons that took. Centroids that are equal stand once in their tree,
    under their smallest number."""
    number = centroids.order
    out = np.full(len(tree.points), -1, np.int64)
    compared = 0
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        # least and greatest distances of each pair of nodes
        gap = np.sqrt(((tree.points[tree.centre[node]] - centroids.points[centroids.centre[other]]).astype(float) ** 2).sum(axis=1))
        slack = tree.radius[node] + centroids.radius[other]
        most = np.full(len(tree.centre), np.inf)
        np.minimum.at(most, node, gap + slack)
        keep = gap - slack <= most[node] * (1 + 1e-9)
        node, other = node[keep], other[keep]
        wide = ~centroids.leaf[other]
        if wide.any():  # the centroids' side first: k is small
            times = centroids.children[other[wide]]
            steps = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            node = np.concatenate([node[~wide], np.repeat(node[wide], times)])
            other = np.concatenate([other[~wide], np.repeat(centroids.child[other[wide]], times) + steps])
            continue
        left = np.bincount(node, minlength=len(tree.centre))
        alone = left[node] == 1
        for v, c in zip(node[alone].tolist(), other[alone].tolist(), strict=True):
            out[tree.first[v] : tree.last[v]] = number[centroids.centre[c]]
        node, other = node[~alone], other[~alone]
        done = tree.leaf[node]
        if done.any():
            compared += _compare(tree, centroids, node[done], other[done], out)
        node, other = node[~done], other[~done]
        times = tree.children[node]
        steps = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        node, other = np.repeat(tree.child[node], times) + steps, np.repeat(other, times)
    return out, compared


def _compare(tree: CoverTree, centroids: CoverTree, node: np.ndarray, other: np.ndarray, out: np.ndarray) -> int:
    """Exact comparisons of the points of leaves with the centroids that are left for them."""
    best = np.full(len(tree.points), np.iinfo(np.int64).max)
    compared = 0
    for c in sorted(set(other.tolist()), key=lambda c: centroids.order[centroids.centre[c]]):
        own = node[other == c]
        size = tree.last[own] - tree.first[own]
        rows = np.repeat(tree.first[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        far = _gaps(tree.points[rows], centroids.points[centroids.centre[c]][None, :])[:, 0]
        nearer = far < best[rows]
        best[rows[nearer]], out[rows[nearer]] = far[nearer], centroids.order[centroids.centre[c]]
        compared += len(rows)
    return compared


def centroid_tree(centroids: np.ndarray) -> CoverTree:
    """One centroid to a leaf; of equal ones the first."""
    _, first = np.unique(centroids, axis=0, return_index=True)
    first = np.sort(first)
    tree = cover_tree(centroids[first], leaf=1)
    tree.order = first[tree.order]
    return tree


def _blocks(dims: int, block: int):
    """Rows (vec_id, v) as (ids, copy, tree): a block's ids, for each the place of its vector in
    the tree, and the pickled tree."""

    def made(ids: list[pa.Array], values: list[np.ndarray]) -> pa.RecordBatch:
        points, copy = np.unique(np.concatenate(values), axis=0, return_inverse=True)
        tree = cover_tree(points)
        place = np.empty(len(points), np.int64)
        place[tree.order] = np.arange(len(points))
        tree.order = np.zeros(0, np.int64)
        ids_ = pa.concat_arrays(ids)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(ids_)], pa.int32()), x) for x in (ids_, pa.array(place[copy.ravel()].astype(np.int32)))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(tree, 5)], pa.binary())], names=["ids", "copy", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - held)
                ids.append(part.column(0))
                values.append(whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), MOST))
                held, at = held + part.num_rows, at + part.num_rows
                if held == block:
                    yield made(ids, values)
                    ids, values, held = [], [], 0
        if held:
            yield made(ids, values)

    return run


def _round(shared):  # type: ignore[no-untyped-def]
    """Of rows (copy, tree): (cluster, at, total), sums over a task; at -1 stands the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        top = centroid_tree(centroids)
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            for copy, raw in zip(batch.column(0), batch.column(1), strict=True):
                tree = pickle.loads(raw.as_py())
                near, _ = assign(tree, top)
                weight = np.bincount(copy.values.to_numpy(), minlength=len(tree.points))
                sums = np.zeros((len(near) + 1, total.shape[1]), np.int64)  # running, so a run of points is one difference
                np.cumsum(np.column_stack([tree.points, np.ones(len(near), np.int64)]) * weight[:, None], axis=0, out=sums[1:])
                ends = np.append(np.flatnonzero(np.diff(near)) + 1, len(near))
                np.add.at(total, near[ends - 1], np.diff(sums[np.append(0, ends)], axis=0))
        k, at = (x.ravel() for x in np.indices(total.shape))
        at = np.where(at == centroids.shape[1], -1, at)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total.ravel())], names=["cluster", "at", "total"])

    return run


def _labelled(shared):  # type: ignore[no-untyped-def]
    """Of rows (ids, copy, tree): (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        top = centroid_tree(centroids)
        for batch in batches:
            for ids, copy, raw in zip(*batch.columns, strict=True):
                tree = pickle.loads(raw.as_py())
                near, _ = assign(tree, top)
                far = ((tree.points - centroids[near]) ** 2).sum(axis=1)
                own = copy.values.to_numpy()
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(near[own].astype(np.int32)), pa.array(far[own])], names=["vec_id", "cluster", "distance"])

    return run


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of
    ``dims`` components. The driver and each task hold ``k`` centroids."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).where(F.size("v") == dims)
    start = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), F.transform("v", lambda c: F.floor(c * F.lit(1024.0))).alias("x"))
    first = start.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], np.int64)
    trees = materialize(rows.mapInArrow(_blocks(dims, block), "ids array<long>, copy array<int>, tree binary"), "cover-trees")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        found = trees.select("copy", "tree").mapInArrow(_round(shared), "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect()
        total = {(r["cluster"], r["at"]): r["total"] for r in found}
        centroids = np.array([[total[c, d] // n if (n := total[c, -1]) else int(centroids[c, d]) for d in range(dims)] for c in range(len(centroids))], np.int64)
    shared = spark.sparkContext.broadcast(centroids)
    near = materialize(trees.mapInArrow(_labelled(shared), "vec_id long, cluster int, distance long"), "labelled")
    inertia = {r["cluster"]: r["s"] for r in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    discard(trees)
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return near.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
