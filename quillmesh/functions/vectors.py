"""Vector similarity in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different length, or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(F.lit(0.0))


def unit_score(similarity: Column) -> Column:
    return (similarity + 1) / 2


def blended(keyword: Column, embedding: Column, weight: float = 0.3) -> Column:
    w = min(1.0, max(0.0, weight))
    return (1 - w) * keyword + w * embedding
