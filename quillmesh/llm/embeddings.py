"""What the operators on embeddings share: which vectors are usable, and their integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each component becomes floor(SCALE * component).
SCALE = 1024


def usable(vector: Column) -> Column:
    """Whether a vector (array of doubles) is there and all of its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))  # NaN is above infinity


def vectors(table: DataFrame, vec_id: str, vector: str, dims: int | None = None) -> DataFrame:
    """(vec_id, v array<double>) of the usable vectors with `dims` components (None: any number, but not zero)."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.size("v") == dims if dims else F.size("v") > 0).where(usable(F.col("v")))
