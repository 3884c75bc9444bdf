"""Continuous reload: an extension beside the batch operators.

A file stream of pages is upserted batch by batch: each batch writes a version of the pages
table in which its rows replace those of the same id. The highest version that has Spark's mark of
success is the last whole one. A batch that runs again after a failure writes the same version anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: What orders the rows of one id: the file's time and name, then the row's place in it.
ORDER = ("__time", "__file", "__row")


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those of the same id; of several new ones the last by ORDER, where new has those columns, then by content."""
    order = [c for c in ORDER if c in new.columns]
    kept = [c for c in new.columns if c != "id" and c not in order]
    last = new.groupBy("id").agg(F.max(F.struct(*order, *kept)).alias("p"))
    new = last.select(*("id" if c == "id" else F.col(f"p.{c}").alias(c) for c in new.columns if c not in order))
    return new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new)


def reload_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Follows Parquet files of pages below source; versions stand in target/v<n>."""

    def upsert(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{target}/v{n - 1}") if n else None
        merged(old, batch).write.mode("overwrite").parquet(f"{target}/v{n}")

    stream = spark.readStream.schema(schema).parquet(source)
    meta = (F.col(f"_metadata.{m}").alias(c) for m, c in zip(("file_modification_time", "file_path", "row_index"), ORDER, strict=True))
    return stream.select("*", *meta).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each kind in time windows; rows later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"))
