"""Clustering and whitening against plain versions, on vectors with nulls, odd lengths, ties and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import kmeans, whitening
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, v string, n long, x0 int, c0 string, tree binary, w0 double, component int"
EXTRA = (1, 2, 3, "v", 5, 6, "c", b"t", 0.5, 7)


def vectors(n=700, dims=64, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    f32 = lambda x: float(np.float32(x))
    out = [(i, [f32(c + r.gauss(0, 0.15)) for c in r.choice(centres)]) for i in range(n)]
    same = out[5][1]
    out += [(n + i, same) for i in range(120)]  # a group of copies
    out += [out[7], out[7], (8, out[9][1])]  # repeated rows, and an id with another vector
    out += [(None, out[11][1]), (None, out[11][1])]
    out += [(2000, None), (2001, []), (2002, same[:-1]), (2003, [*same, 1.0]), (2004, [None, *same[1:]]), (2005, [float("nan"), *same[1:]]), (2006, [float("-inf"), *same[1:]])]
    return out


def frame(spark, held):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in held], SCHEMA).repartition(5)


@pytest.mark.parametrize(("tree_rows", "leaf", "at_once"), [(1 << 15, 24, 1 << 21), (100, 3, 1500)])
def test_kmeans(spark, monkeypatch, tree_rows, leaf, at_once):
    for name, value in (("TREE_ROWS", tree_rows), ("LEAF", leaf), ("AT_ONCE", at_once)):
        monkeypatch.setattr(kmeans, name, value)
    held = vectors()
    found = kmeans.clusters(frame(spark, held))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute.op11(held).values(), key=str)


def test_kmeans_ties(spark):
    """Vectors that lie as far from one centroid as from another, and centroids that are equal."""
    held = [(i, [float(i % 2) * 2, float(i % 3)]) for i in range(40)] + [(i, [1.0, 1.0]) for i in range(40, 60)]
    found = kmeans.clusters(frame(spark, held), k=8, rounds=3, dims=2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute.op11(held, 8, 3, 2).values(), key=str)


@pytest.mark.parametrize("scale", [1.0, 2e5, 3e6, 1e13])
def test_kmeans_large_components(spark, scale):
    """Beyond 2^27 squared distances are taken in whole numbers of any size; what no long can hold is null."""
    held = [(i, [float(x) * scale for x in v]) for i, v in vectors(60) if v and len(v) == 64 and None not in v]
    held = [(i, [float(np.float32(x)) for x in v]) for i, v in held]
    long = lambda x: x if x < 1 << 63 else None
    want = [(v, j, long(d), a, b, h) for v, j, d, a, b, h in brute.op11(held, rounds=2).values()]
    found = list(map(tuple, kmeans.clusters(frame(spark, held), rounds=2).collect()))
    assert sorted((r[:3] + r[5:] for r in found), key=str) == sorted((r[:3] + r[5:] for r in want), key=str)
    if all(r[2] is not None for r in want):
        assert {r[3:5] for r in found} == {(long(r[3]), long(r[4])) for r in want}


def test_kmeans_few_and_none(spark):
    held = [(i, [float(i), 0.0]) for i in range(3)]
    assert sorted(map(tuple, kmeans.clusters(frame(spark, held), dims=2).collect())) == sorted(brute.op11(held, dims=2).values())
    none = spark.createDataFrame([], SCHEMA)
    for rows in (none, frame(spark, [(1, None), (2, [])])):
        found = kmeans.clusters(rows)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0


def test_pruning_settles_whole_nodes():
    """Clusters far apart are settled above the leaves; every point is settled once."""
    r = np.random.default_rng(1)
    points = (r.integers(0, 8, 5000)[:, None] * 5000 + r.integers(-50, 50, (5000, 6))).astype(np.int64)
    tree = kmeans.Tree.unpacked(kmeans.Tree(points, np.arange(5000), np.ones(5000, bool)).ordered().summed().packed())
    centroids = np.arange(8)[:, None] * 5000 + np.zeros((8, 6), np.int64)
    told = list(kmeans.settled(tree, centroids))
    whole = sum(int(np.diff(tree.edges[level])[nodes].sum()) for level, nodes, _ in told if level is not None)
    single = sum(len(points) for level, points, _ in told if level is None)
    assert whole + single == 5000 and whole > 4500
    cluster, distance = kmeans.assigned(tree, centroids)
    far = ((tree.points.astype(np.int64)[:, None] - centroids[None]) ** 2).sum(2)
    assert (cluster == far.argmin(1)).all() and (distance == far.min(1)).all()


@pytest.mark.parametrize("pairs", [2080, 37])
def test_whitening(spark, monkeypatch, pairs):
    monkeypatch.setattr(whitening, "PAIRS", pairs)
    held = [(i, v) for i, v in vectors() if not v or len(v) == 64] + [(3000, [0.5] * 63)]
    usual = [(i, v) for i, v in held if v and len(v) == 64]
    found = whitening.whitened(frame(spark, held)).collect()
    ids, deviations, want, explained = brute.op12(usual)
    assert len(found) == 8 * len(ids)
    at = sorted((str(r["vec_id"]), r["deviation"], r["component"]) for r in found)
    assert at == sorted((str(i), d, k) for i, d in zip(ids, deviations, strict=True) for k in range(1, 9))
    for k in range(8):
        mine = sorted((r["deviation"], r["whitened"]) for r in found if r["component"] == k + 1)
        theirs = [sorted(zip(deviations, s * want[:, k], strict=True)) for s in (1, -1)]
        assert any(np.allclose([x for _, x in mine], [x for _, x in t], atol=1e-7) for t in theirs)
        assert [r["explained"] for r in found if r["component"] == k + 1] == [pytest.approx(explained[k], rel=1e-9)] * len(ids)
    assert {r["n"] for r in found} == {len(ids)} and max(r["identity_error"] for r in found) < 1e-8


def test_whitening_without_spread(spark):
    """Dimensions that do not vary, fewer dimensions than components, one row, none."""
    held = [(i, [float(i % 5), 1.0, float(i % 5)]) for i in range(30)]
    found = whitening.whitened(frame(spark, held)).collect()
    assert {r["component"] for r in found} == {1, 2, 3} and max(r["identity_error"] for r in found) < 1e-8
    assert {r["whitened"] for r in found if r["component"] > 1} == {0.0}
    found = whitening.whitened(frame(spark, [(1, [2.0, 3.0])])).collect()
    assert [(r["vec_id"], r["deviation"], r["whitened"], r["explained"]) for r in found] == [(1, 0, 0.0, 0.0)] * 2
    none = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_large_deviations(spark):
    """Where a deviation may leave a long it is taken in decimals, and null if it does."""
    held = [(i, [float(i) * 1e3, float(i % 3)]) for i in range(50)] + [(50, [1e6, 0.0])]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame(spark, held)).where(F.col("component") == 1).collect()}
    _, want, _, _ = brute.op12(held)
    assert found == {i: d if d < 1 << 63 else None for (i, _), d in zip(held, want, strict=True)} and None in found.values() and set(found.values()) != {None}
