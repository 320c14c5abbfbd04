"""Whitening, dual-tree Lloyd and pattern packing against direct computation."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from photonframe.llm import dual_tree, pattern_packing, whitening
from photonframe.llm.queries import op11_whitening_jacobi, op12_dual_tree_lloyd, op13_pattern_packing, tokenizer_file

from .fixtures import SCHEMA, rows

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed: int, n: int, d: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    flat = (r.normal(size=(n, d)) * np.linspace(1, 0.01, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0]
    out = [(i, [float(np.float32(v)) for v in x], 0) for i, x in enumerate(flat)]
    odd = [(n, None, 0), (n + 1, [None] * d, 0), (n + 2, [math.nan] * d, 0), (n + 3, [math.inf] * d, 0), (None, out[0][1], None)]
    return out + odd + out[:40] + [(n + 4, out[2][1], 1)] * 30  # repeated rows and copies


def valid(rows_: list[tuple]) -> list[tuple]:
    return [(i, x) for i, x, _ in rows_ if x is not None and all(v is not None and math.isfinite(v) for v in x)]


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_jacobi(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d))
    a = a @ a.T
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-10) and np.allclose(v @ np.diag(e) @ v.T, a) and np.allclose(v.T @ v, np.eye(d))


def test_jacobi_small_eigenvalues():
    """A matrix of graded scale has eigenvalues of 1 to 1e-24, each right to many digits."""
    scale = 10.0 ** -np.arange(0, 13, 3)
    core = np.full((5, 5), 0.3) + 0.7 * np.eye(5)
    e, _ = whitening.jacobi(core * scale[:, None] * scale[None, :])
    from fractions import Fraction

    a = [[Fraction(x) for x in row] for row in (core * scale[:, None] * scale[None, :]).tolist()]
    det = Fraction(1)
    for k in range(5):  # exact determinant by elimination
        det *= a[k][k]
        for i in range(k + 1, 5):
            f = a[i][k] / a[k][k]
            a[i] = [x - f * y for x, y in zip(a[i], a[k], strict=True)]
    assert abs(np.prod(e) / float(det) - 1) < 1e-12 and e[-1] > 0


@pytest.mark.parametrize("d", [5, 12])
def test_whiten(spark, d):
    table = vectors(1, 300, d)
    frame = spark.createDataFrame(table, VECTORS).withColumnRenamed("label", "w")  # a clashing name
    got = whitening.whiten(frame).collect()
    own = valid(table)
    x = [[math.floor(1024 * v) + whitening.OFFSET for v in c] for _, c in own]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[(n * v - s) / n for v, s in zip(r, sums, strict=True)] for r in x])
    cov = z.T @ z / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(8, d)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    want = Counter()
    for (i, _), r in zip(own, x, strict=True):
        want[i, sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True))] += k
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got) == want
    white = z @ axes[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        mine = sorted(r["whitened"] for r in got if r["component"] == c + 1)
        ours = np.sort(white[:, c])
        assert np.allclose(mine, ours, atol=1e-7) or np.allclose(mine, -ours[::-1], atol=1e-7)
    assert all(abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9 for r in got)


def test_whiten_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [0.5] * 3, 0) for i in range(4)], VECTORS)).collect()
    assert len(same) == 12 and {(r["whitened"], r["explained"], int(r["deviation"]), r["identity_error"]) for r in same} == {(0.0, 0.0, 0, 0.0)}
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 2.0], 0), (3, [1.0], 0), (4, [3.0], 0), (5, [], 0)], VECTORS)).collect()
    assert Counter((r["length"], r["n"]) for r in two) == {(2, 2): 4, (1, 2): 2}
    assert {abs(round(r["whitened"], 9)) for r in two if r["component"] == 1} == {1.0}
    far = whitening.whiten(spark.createDataFrame([(1, [1e12], 0), (2, [-1e12], 0), (3, [0.0], 0)], VECTORS)).collect()
    assert sum(int(r["deviation"]) for r in far) > 1 << 62  # beyond 64 bits, still exact


def brute_lloyd(own: list[tuple], k: int, rounds: int) -> list[tuple]:
    x = [(i, [math.floor(1024 * v) for v in c]) for i, c in own]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", c) for i, c in x)[:k]
    centroids = [c for _, c in start]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for _ in range(rounds):
        near = [min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c)) for _, v in x]
        for c in range(len(centroids)):
            members = [v for (_, v), a in zip(x, near, strict=True) if a == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    near = [min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c)) for _, v in x]
    far = [gap(v, centroids[a]) for (_, v), a in zip(x, near, strict=True)]
    inertia = Counter()
    for a, f in zip(near, far, strict=True):
        inertia[a] += f
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, a, f, inertia[a], sum(far), sha[a]) for (i, _), a, f in zip(x, near, far, strict=True)), key=repr)


@pytest.mark.parametrize(("n", "d", "k", "block"), [(400, 6, 8, 64), (3, 4, 8, 16), (300, 3, 20, 1000)])
def test_lloyd(spark, n, d, k, block):
    table = vectors(2, n, d)
    frame = spark.createDataFrame(table, VECTORS).withColumnRenamed("label", "cluster")
    got = dual_tree.lloyd(frame, k=k, rounds=4, dims=d, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lloyd(valid(table), k, 4)


def test_lloyd_ties_and_edges(spark):
    """Whole numbers on a grid: many distances tie, and copies of one vector start several centroids."""
    table = [(i, [float(i % 4), float(i // 4 % 4)], 0) for i in range(64)] + [(100 + i, [1.0, 1.0], 0) for i in range(60)]
    got = dual_tree.lloyd(spark.createDataFrame(table, VECTORS), k=12, rounds=3, dims=2, block=32)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lloyd(valid(table), 12, 3)
    assert dual_tree.lloyd(spark.createDataFrame([], VECTORS)).collect() == []
    other = dual_tree.lloyd(spark.createDataFrame([(1, [1.0] * 3, 0), (2, [2.0] * 64, 0)], VECTORS)).collect()
    assert [r["vec_id"] for r in other] == [2]
    with pytest.raises(Exception, match="64 bits"):
        dual_tree.lloyd(spark.createDataFrame([(1, [1e9] * 64, 0)], VECTORS)).collect()


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_and_pruning(seed):
    r = np.random.default_rng(seed)
    points = np.unique((r.normal(size=(700, 3)) * 30 + 400 * r.integers(0, 4, (700, 1))).astype(int), axis=0)
    tree = dual_tree.cover_tree(points, leaf=8)
    assert (tree.points == points[tree.order]).all() and sorted(tree.order.tolist()) == list(range(len(points)))
    top = np.sqrt(((points - points[0]) ** 2).sum(axis=1)).max()
    levels: dict[int, list[int]] = {}
    for node in range(len(tree.centre)):
        span = tree.points[tree.first[node] : tree.last[node]]
        centre = tree.points[tree.centre[node]]
        assert np.sqrt(((span - centre) ** 2).sum(axis=1)).max() <= tree.radius[node]
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        if tree.children[node]:
            assert tree.centre[kids[0]] == tree.centre[node]  # nesting
            assert [tree.first[k] for k in kids] == [tree.first[node], *(tree.last[k] for k in kids[:-1])] and tree.last[kids[-1]] == tree.last[node]
            assert all(np.sqrt(((tree.points[tree.centre[k]] - centre) ** 2).sum()) <= top / 2 ** (tree.level[k] - 1) + 1e-6 for k in kids)  # covering
        levels.setdefault(int(tree.level[node]), []).append(int(tree.centre[node]))
    for level, own in levels.items():  # separation
        at = tree.points[np.unique(own)].astype(float)
        gap = np.sqrt(((at[:, None] - at[None, :]) ** 2).sum(axis=2)) + np.eye(len(at)) * 1e9
        assert gap.min() > top / 2**level - 1e-6
    centroids = points[r.choice(len(points), 12)]
    near, compared = dual_tree.assign(tree, dual_tree.centroid_tree(centroids))
    gaps = ((tree.points[:, None] - centroids[None, :]) ** 2).sum(axis=2)
    assert (near == gaps.argmin(axis=1)).all() and compared < gaps.size / 2  # most pairs are never compared


def placed_well(got: list, documents: list[tuple], ids_of, max_len: int, end: int) -> int:
    """Checks the contract of pieces; the number of sequences."""
    by_doc, windows = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    texts: dict = {}
    for i, t, *_ in documents:
        texts.setdefault(i, []).append(t)
    assert set(by_doc) == set(texts)
    for i, own in texts.items():
        want = Counter()
        for t in own:
            ids = [*ids_of(t or ""), end]
            at = 0
            for k, (start, length) in enumerate(pattern_packing.cuts(len(ids), max_len)):
                assert start == at and (length == max_len or k == 0)
                at += length
                want[k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            assert at == len(ids)
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == want
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) <= max_len
    return len(windows)


def test_pack_patterns(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    table = [*rows(), (900, "x  y   z \n\n  end <|endoftext|> it's 　 \x1c é" * 9, "en", "s", 1), (None, "no id", None, None, None)]
    frame = spark.createDataFrame(table, SCHEMA).withColumnsRenamed({"lang": "piece", "source": "length", "n_chars": "task"})  # clashing names
    got = pattern_packing.pack_patterns(frame, tokenizer_file("byte_bpe_50k.json"), max_len=128).collect()
    n = placed_well(got, table, lambda t: model.encode(t, add_special_tokens=False).ids, 128, 2)
    total = sum(r["length"] for r in got)
    assert n <= math.ceil(total / 128) + 2
    assert pattern_packing.pack_patterns(spark.createDataFrame([], SCHEMA), tokenizer_file("byte_bpe_50k.json")).collect() == []


def test_byte_encoder():
    import random

    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    model, mine, r = Tokenizer.from_file(path), pattern_packing.ByteEncoder(path), random.Random(3)
    parts = [" ", " ", " ", "\n", "\t", "a", "b", "The", "é", "日", "1", ".", "'s", "'t", "　", "\x1c", "\x85", "\xa0", "​", "<|endoftext|>", "<|", "😀", "\r"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(2000)]
    import duckdb

    texts += [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert [mine.encode(t) for t in texts] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError, match="byte-level"):
        pattern_packing.ByteEncoder(tokenizer_file("word_bpe_49k.json"))


@pytest.mark.parametrize(("low", "high", "n"), [(1, 100, 3000), (30, 70, 2000), (5, 9, 500), (51, 99, 400), (100, 101, 50), (1, 2, 10), (1, 101, 30000)])
def test_plan(low, high, n):
    """Every piece has one place, windows hold no more than they can, and few are used."""
    lengths = Counter(np.random.default_rng(n).integers(low, high, n).tolist())
    made = pattern_packing.plan(dict(lengths), 100)
    used = Counter()
    for pattern, times in made:
        assert sum(pattern) <= 100 and times > 0
        for v in pattern:
            used[v] += times
    assert used == lengths
    least = max(math.ceil(sum(v * k for v, k in lengths.items()) / 100), sum(k for v, k in lengths.items() if v > 50))
    assert sum(t for _, t in made) <= least * 1.02 + 2
    key, base, offset = pattern_packing.places(made)
    taken = set()
    for v, k in lengths.items():
        own = (v << pattern_packing._RANK_BITS) + np.arange(k)
        at = np.searchsorted(key, own, side="right") - 1
        for s, o in zip((base[at] + own - key[at]).tolist(), offset[at].tolist(), strict=True):
            cells = {(s, c) for c in range(o, o + v)}
            assert not cells & taken and o + v <= 100
            taken |= cells
    assert pattern_packing.plan({}, 100) == []


def test_patterns_and_fit():
    have = np.array([1, 2, 5, 10, 12])
    got = {tuple(v for v in r if v) for r in pattern_packing.patterns(have, 12, 3).tolist()}
    from itertools import combinations_with_replacement

    assert got == {c for k in (1, 2, 3) for c in combinations_with_replacement(have.tolist(), k) if sum(c) == 12}
    held = np.zeros(13, np.int64)
    held[[2, 5, 10]] = 40, 20, 30  # 10 x (2, 5, 5) and 30 x (2, 10), exactly
    fitted = pattern_packing.fit(pattern_packing.patterns(np.array([2, 5, 10]), 12), held)
    assert sorted(np.round(fitted[fitted > 1e-6]).tolist()) == [10, 30]


def test_queries_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert op11_whitening_jacobi(spark, sf).count() == 8 * n
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_dual_tree_lloyd(spark, sf).collect()), key=repr) == brute_lloyd(valid(table), 8, 10)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = op13_pattern_packing(spark, sf).collect()
    count = placed_well(got, docs, lambda t: model.encode(t, add_special_tokens=False).ids, 1024, 2)
    assert count <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.02 + 1
