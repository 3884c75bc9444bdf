"""Batches of vector queries against a comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import nearest


def table(n=600, dims=8, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    out = [(f"v{i}", f"t{i % 7}", (centres[i % 6] + r.normal(scale=0.05, size=dims)).tolist()) for i in range(n)]
    out += [(f"s{i}", f"t{i % 3}", out[0][2]) for i in range(200)]  # copies: ties
    out += [("zero", "z", [0.0] * dims), ("short", "y", [1.0]), ("null", "x", None), (None, "w", out[1][2]), ("v1", "t1", out[1][2])]
    return out


def brute(rows, queries, k):
    def cosine(a, b):
        if len(a) != len(b) or not np.any(a) or not np.any(b):
            return 0.0
        return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    return {q: sorted(((-round(cosine(v, x), 9), t, i) for i, t, x in rows if i is not None and x is not None))[:k] for q, v in queries}


@pytest.mark.parametrize(("packed", "block", "chunk", "k"), [(8192, 512, 1000, 5), (100, 16, 4, 30), (100, 16, 4, 100)])
def test_top_k(spark, monkeypatch, packed, block, chunk, k):
    for name, value in (("PACKED", packed), ("BLOCK", block), ("QUERIES", chunk)):
        monkeypatch.setattr(nearest, name, value)
    rows = table()
    queries = [(i, rows[37 * i][2]) for i in range(8)] + [(90, [0.0] * 8), (91, rows[0][2])]
    vectors = spark.createDataFrame(rows, "id string, tie string, embedding array<double>").repartition(3)
    hits, stats = nearest.top_k(vectors, spark.createDataFrame(queries, "query_id long, embedding array<double>"), k)
    want = brute(rows, queries, k)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((round(r["similarity"], 9), r["id"]))
    assert set(got) == set(want)
    for q, held in want.items():
        assert [s for s, _ in got[q]] == pytest.approx([-s for s, _, _ in held], abs=1e-8)
        last = held[-1][0]
        assert {i for s, i in got[q] if s > -last + 1e-7} == {i for s, _, i in held if s < last - 1e-7}
    told = stats.first()
    assert told["compared"] + told["skipped"] == (len(rows) - 2) * len(queries)
    if k < 30:
        assert told["skipped"] > 0


def test_nothing_to_ask_or_to_find(spark):
    vectors = spark.createDataFrame(table(20), "id string, tie string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, embedding array<double>")
    assert nearest.top_k(vectors, asked.limit(0), 3)[0].count() == 0
    assert nearest.top_k(vectors.limit(0), asked, 3)[0].count() == 0
    with pytest.raises(ValueError):
        nearest.top_k(vectors, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], asked.schema), 3)
    assert nearest.top_k(vectors.withColumn("query", F.lit(1)), asked, 3)[0].count() == 3
