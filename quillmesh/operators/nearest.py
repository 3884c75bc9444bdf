"""Exact nearest vectors by cosine for many queries at once.

Each task packs unit vectors into blocks of one pivot and a narrow band of distances from it,
without a shuffle, so equal or crowded vectors make more blocks and no larger task. A query skips
a block where the triangle inequality says that none of it can reach the k-th best similarity so far; the others
are one matrix product. The k-th best starts from the pivots, which are vectors themselves.
Pivots are a bounded choice (PIVOTS) that steers what is skipped and never what is found.

A vector that is zero or of another length than the query has similarity 0. Null vectors and ids
are left out. Equal similarities are ordered by tie, then id. Repeated rows count as often as they are
there. A task holds one file split of blocks and the best k of each query of a chunk.
"""

from __future__ import annotations

import bisect
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.vectors import dot
from quillmesh.sources.shared import written

PIVOTS = 64
#: Vectors that a task packs at a time, and of one block.
PACKED, BLOCK = 8192, 512
#: Queries that go to the tasks together.
QUERIES = 1000
#: More than what rounding can move a similarity.
SLACK = 1e-9
_BLOCK = "pivot int, low double, high double, ids array<string>, ties array<string>, units binary"


def _units(table: DataFrame, columns: list[str], dims: int) -> DataFrame:
    """columns and the unit vector; zero where there is none of this length."""
    v = F.col("embedding").cast("array<double>")
    held = table.where("embedding IS NOT NULL").select(*columns, v.alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    good = (F.size("v") == dims) & (F.col("norm") > 0)
    return held.select(*columns, F.when(good, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.array_repeat(F.lit(0.0), dims)).alias("unit"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def blocks(units: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The packed vectors of (id, tie, unit)."""
    dims = pivots.shape[1]

    def packed(ids, ties, unit):
        flat = (unit * unit).sum(1) == 0
        far = _distances(unit, pivots)
        pivot = np.where(flat, -1, far.argmin(1))
        radius = np.where(flat, 0.0, far.min(1))
        order = np.lexsort((radius, pivot))
        cuts = np.flatnonzero(np.diff(pivot[order])) + 1
        for some in np.split(order, cuts):
            for at in range(0, len(some), BLOCK):
                b = some[at : at + BLOCK]
                yield {"pivot": int(pivot[b[0]]), "low": radius[b[0]], "high": radius[b[-1]], "ids": [ids[i] for i in b], "ties": [ties[i] for i in b], "units": unit[b].tobytes()}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                some = batch.slice(at, PACKED)
                rows = list(packed(some.column(0).to_pylist(), some.column(1).to_pylist(), _matrix(some.column(2), dims)))
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.string())), ("ties", pa.list_(pa.string())), ("units", pa.binary())])
    return units.mapInArrow(run, _BLOCK)


def _search(index: DataFrame, pivots: np.ndarray, names: list, asked: np.ndarray, k: int) -> DataFrame:
    """(query, id, tie, similarity) of each task's best, and one row (compared, skipped) of it."""
    to_pivot = _distances(asked, pivots)
    zero = (asked * asked).sum(1) == 0
    known = np.sort(asked @ pivots.T, axis=1)
    floor = known[:, -k] - SLACK if len(pivots) >= k else np.full(len(asked), -np.inf)

    def run(batches):
        best: list[list] = [[] for _ in names]
        least, compared, skipped = floor.copy(), 0, 0
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time as objects
                block = batch.slice(i, 1).to_pylist()[0]
                n = len(block["ids"])
                if block["pivot"] < 0:
                    most = np.zeros(len(asked))
                else:
                    d = to_pivot[:, block["pivot"]]
                    gap = np.maximum(np.maximum(d - block["high"], block["low"] - d), 0)
                    most = np.where(zero, 0.0, 1 - gap * gap / 2)
                near = np.flatnonzero(most + SLACK >= least)
                compared, skipped = compared + n * len(near), skipped + n * (len(asked) - len(near))
                if not len(near):
                    continue
                similar = asked[near] @ np.frombuffer(block["units"]).reshape(n, -1).T
                for row, q in zip(similar, near.tolist(), strict=True):
                    for j in np.flatnonzero(row >= least[q]).tolist():
                        bisect.insort(best[q], (-row[j], block["ties"][j] or "", block["ids"][j]))
                    del best[q][k:]
                    if len(best[q]) == k:
                        least[q] = max(least[q], -best[q][-1][0])
        rows = [{"query": i, "id": x, "tie": t, "similarity": -s} for i, held in enumerate(best) for s, t, x in held]
        yield pa.RecordBatch.from_pylist([*rows, {"compared": compared, "skipped": skipped}], schema)

    schema = pa.schema([("query", pa.int32()), ("id", pa.string()), ("tie", pa.string()), ("similarity", pa.float64()), ("compared", pa.int64()), ("skipped", pa.int64())])
    return index.mapInArrow(run, "query int, id string, tie string, similarity double, compared long, skipped long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """vectors: (id, embedding), maybe tie; queries: (query_id, embedding), of one length.

    Gives (query_id, rank, id, similarity), and (compared, skipped): how many pairs were looked at and how many left out.
    """
    spark = vectors.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    lengths = [r[0] for r in queries.where("size(embedding) > 0").select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    if len(lengths) != 1:
        if lengths:
            raise ValueError("query vectors of several lengths")
        return spark.createDataFrame([], f"query_id {kind}, rank int, id string, similarity double"), spark.createDataFrame([(0, 0)], "compared long, skipped long")
    dims = lengths[0]
    tie = F.col("tie") if "tie" in vectors.columns else F.lit("")
    units = _units(vectors.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), tie.cast("string").alias("tie"), "embedding"), ["id", "tie"], dims)
    some = units.where(F.exists("unit", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = np.array([r["unit"] for r in some], float).reshape(-1, dims) if some else np.zeros((1, dims))
    index = written(blocks(units, pivots))
    asked = _units(queries, ["query_id"], dims).toLocalIterator()
    parts = []
    while chunk := list(islice(asked, QUERIES)):
        found = _search(index, pivots, [r["query_id"] for r in chunk], np.array([r["unit"] for r in chunk], float), k)
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(chunk)], f"query int, query_id {kind}")
        parts.append(written(found.join(F.broadcast(names), "query", "left")))
    told = parts[0]
    for p in parts[1:]:
        told = told.unionByName(p)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "tie", "id"))
    hits = told.where("id IS NOT NULL").withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
    return hits, told.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
