"""Whitening of embeddings by aggregates of columns.

Each component is an integer column. One aggregation gives counts and sums, a second one the sum of
the centred product of every pair of dimensions (the upper triangle, as generated SQL expressions),
PAIRS of them at a time. What comes to the driver is the covariance, whose eigenvectors LAPACK
finds; the projections are columns again. A third aggregation takes the covariance of what has
been whitened, to tell how far it is from the identity.

Null vectors, empty ones and those with a null or non-finite component are left out; so are vectors
of another length than most have (of equal shares the longer). Null ids stay. Repeated rows all
count and all come back. An empty table gives no rows. Extra columns are not looked at. A component
along which the vectors do not vary is zero in every row and not part of identity_error. A
deviation that no long can hold is null.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.embeddings import SCALE, vectors

#: Added to every integer.
OFFSET = 100_000
#: Pairs of dimensions in one aggregation: all of 64 dimensions.
PAIRS = 2080
_LONG = (1 << 63) - 1


def integers(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id and the columns x0, x1, ... of rows (vec_id, v). None is null, and told so: sums of what may be null take twice the time."""
    return rows.select("vec_id", *(F.coalesce(F.floor(F.get("v", F.lit(i)) * SCALE) + OFFSET, F.lit(0)).alias(f"x{i}") for i in range(dims)))


def centred(x: DataFrame, mean: list[float]) -> DataFrame:
    return x.select(*((F.col(f"x{i}").cast("double") - F.lit(m)).alias(f"c{i}") for i, m in enumerate(mean)))


def covariance(x: DataFrame, mean: list[float], n: int) -> np.ndarray:
    """dims x dims, divisor n."""
    dims, held = len(mean), centred(x, mean)
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    out = np.zeros((dims, dims))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        row = held.selectExpr(*(f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in some)).first()
        for (i, j), s in zip(some, row, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; the largest entry of each is positive."""
    values, columns = np.linalg.eigh(cov)
    values, rows = values[::-1][:most], columns.T[::-1][:most]
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return values, rows * sign[:, None]


def deviation(n: int, sums: list[int], bound: int) -> Column:
    """Sum of (n * x - S)^2, in longs where `bound`, the largest that it can be, is one."""
    kind = "long" if bound <= _LONG else "decimal(38,0)"
    terms = (F.lit(n).cast(kind) * F.col(f"x{i}").cast(kind) - F.lit(s).cast(kind) for i, s in enumerate(sums))
    return reduce(add, (t.cast(kind) * t.cast(kind) for t in terms)).try_cast("long")


def whitened(table: DataFrame, most: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable vector and each of the first components."""
    spark = table.sparkSession
    rows = vectors(table, vec_id, vector)
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).first()
    if usual is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dims = usual["dims"]
    x = integers(rows.where(F.size("v") == dims), dims)
    about = x.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(f"x{i}")).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.sum, F.min, F.max))).first()
    n, sums = about["n"], [about[f"sum{i}"] for i in range(dims)]
    mean = [s / n for s in sums]
    cov = covariance(x, mean, n)
    values, axes = components(cov, most)
    trace = float(np.trace(cov))
    varies = values > 1e-12 * max(trace, 0.0)
    bound = sum(max(abs(n * about[f"{f}{i}"] - s) for f in ("min", "max")) ** 2 for i, s in enumerate(sums))

    def along(k: int) -> Column:
        if not varies[k]:
            return F.lit(0.0)
        by = axes[k] / np.sqrt(values[k])
        return reduce(add, ((F.col(f"x{i}").cast("double") - F.lit(m)) * F.lit(float(w)) for i, (m, w) in enumerate(zip(mean, by, strict=True))))

    names = [f"w{k}" for k in range(len(values))]
    made = x.select("vec_id", deviation(n, sums, bound).alias("deviation"), *(along(k).alias(w) for k, w in enumerate(names)))
    real = [k for k in range(len(values)) if varies[k]]
    pairs = [(i, j) for i in real for j in real if i <= j]
    spread = made.agg(F.count(F.lit(1)), *(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()[1:]
    error = max((abs(v - (i == j)) for (i, j), v in zip(pairs, spread, strict=True)), default=0.0)
    share = [float(v / trace) if trace > 0 else 0.0 for v in values]
    each = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.col(w).alias("whitened"), F.lit(share[k]).alias("explained")) for k, w in enumerate(names)))
    told = made.select("vec_id", "deviation", F.inline(each))
    return told.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
