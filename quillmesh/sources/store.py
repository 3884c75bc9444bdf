"""Tables that a knowledge base keeps: pages, checksums, vectors; and what in them is out of date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKSUMS = "path string, sha256 string"
VECTORS = "id string, content_hash string, model string, dims int, embedding array<float>"
VECTOR_COLUMNS = ["id", "content_hash", "model", "dims", "embedding"]
META = "model string, dimensions int, version int"


def checksums(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.col(text), 256).alias("sha256"))


def stale(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, status): changed, added or removed, by the full outer join of two checksum tables."""
    both = current.select("path", F.col("sha256").alias("now")).join(cached.select("path", F.col("sha256").alias("then")), "path", "full")
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", status.alias("status")).where("status IS NOT NULL").orderBy("path")


def pending(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, content_hash) of pages without a vector of their present content; an empty hash is always pending."""
    held = vectors.where(F.size("embedding") > 0).select("id", "content_hash").distinct()
    return pages.select("id", "content_hash").join(held.where("content_hash <> ''"), ["id", "content_hash"], "left_anti").orderBy("id")


def embed_status(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: total, embedded, pending."""
    held = vectors.where(F.size("embedding") > 0).where("content_hash <> ''").select("id", "content_hash").distinct().withColumn("held", F.lit(True))
    both = pages.select("id", "content_hash").join(held, ["id", "content_hash"], "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("held").alias("embedded"), F.count_if(F.col("held").isNull()).alias("pending"))


class Store:
    """The tables below one folder, as Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save_pages(self, pages: DataFrame, files: DataFrame) -> None:
        pages.write.mode("overwrite").parquet(f"{self.root}/pages")
        checksums(files).write.mode("overwrite").parquet(f"{self.root}/checksums")

    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/pages")

    def checksums(self) -> DataFrame:
        return self.spark.read.schema(CHECKSUMS).parquet(f"{self.root}/checksums")

    def load(self, root: str, pattern: str = "*.md", auto_enrich: bool = False) -> tuple[DataFrame, DataFrame]:
        """pages and warnings of a folder; only files that changed since the last `load` are parsed again.

        Files go by their checksum: pages of files that are as they were come from the store,
        those of files that are gone stay out. Both tables are written anew as a next version,
        which `current` names once it is whole.
        """
        from quillmesh.sources import markdown

        files = markdown.scan(self.spark, root, pattern)
        now = checksums(files)
        held = self._current()
        if held is None:
            pages, warnings = markdown.load(self.spark, root, pattern, auto_enrich=auto_enrich)
            self._next(pages, now)
            return self.spark.read.parquet(f"{self._current()}/pages"), warnings
        then = self.spark.read.schema(CHECKSUMS).parquet(f"{held}/checksums")
        moved = stale(now, then)
        if moved.isEmpty():
            return self.spark.read.parquet(f"{held}/pages"), self.spark.createDataFrame([], "path string, message string")
        fresh = files.join(moved.where("status <> 'removed'").select("path"), "path", "left_semi")
        pages, warnings = markdown.read_pages(fresh, root, auto_enrich)
        old = self.spark.read.parquet(f"{held}/pages").join(moved.select(F.col("path").alias("source_path")), "source_path", "left_anti")
        self._next(old.select(*pages.columns).unionByName(pages), now)
        return self.spark.read.parquet(f"{self._current()}/pages"), warnings

    def _pointer(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _current(self) -> str | None:
        """The newest whole version: its checksums are written last, and their mark of success tells that they are whole."""
        fs, path = self._pointer()
        names = sorted((s.getPath().getName() for s in fs.listStatus(path)), key=int) if fs.exists(path) else []
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/{n}/checksums/_SUCCESS"))]
        return f"{self.root}/versions/{whole[-1]}" if whole else None

    def _next(self, pages: DataFrame, sums: DataFrame) -> None:
        fs, path = self._pointer()
        number = max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) + 1 if fs.exists(path) else 1
        pages.write.parquet(f"{self.root}/versions/{number}/pages")
        sums.write.parquet(f"{self.root}/versions/{number}/checksums")

    # Vectors lie in generations, of which each has one model. A generation counts once its `meta`
    # is whole, which is written last, so a change of model, or a compaction, that fails on the way
    # leaves the one before to read.

    def _generations(self) -> list[int]:
        """Whole ones, oldest first."""
        fs, _ = self._pointer()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.root}/generations")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if fs.exists(path(f"{self.root}/generations/{n}/meta/_SUCCESS")))

    def _generation(self, number: int) -> str:
        return f"{self.root}/generations/{number}"

    def _begin(self, number: int, model: str, dims: int) -> None:
        """Makes a generation count; those before the last but one go."""
        from quillmesh.sources.shared import remove

        self.spark.createDataFrame([(model, dims, 1)], META).coalesce(1).write.mode("overwrite").json(f"{self._generation(number)}/meta")
        for old in self._generations()[:-2]:
            remove(self.spark, self._generation(old))

    def ensure_model(self, model: str, dims: int) -> bool:
        """Records the model of the vectors; where another one's are held a new generation without vectors takes their place, and True comes back."""
        held = self.model()
        if held == (model, dims):
            return False
        from quillmesh.sources.shared import remove

        number = max(self._generations(), default=0) + 1
        remove(self.spark, f"{self._generation(number)}/vectors")  # what a compaction that failed may have left
        self._begin(number, model, dims)
        return held is not None

    def model(self) -> tuple[str, int] | None:
        """Model and dimensions of the vectors that are held."""
        numbers = self._generations()
        row = self.spark.read.schema(META).json(f"{self._generation(numbers[-1])}/meta").first() if numbers else None
        return (row["model"], row["dimensions"]) if row else None

    def save_vectors(self, vectors: DataFrame) -> None:
        """Adds or replaces vectors, by (id, content_hash). Where no model is recorded yet, that of the vectors is."""
        if not self._generations():
            first = vectors.select("model", "dims").first()
            if first is None:
                return
            self.ensure_model(first["model"], first["dims"])
        path = f"{self._generation(self._generations()[-1])}/vectors"
        held = self._saved(path)
        last = held.agg(F.max("seq")).first()[0] if held is not None else None
        vectors.select(*VECTOR_COLUMNS, F.lit((last or 0) + 1).cast("long").alias("seq")).write.mode("append").parquet(path)

    def _saved(self, path: str) -> DataFrame | None:
        fs, _ = self._pointer()
        return self.spark.read.schema(f"{VECTORS}, seq long").parquet(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)) else None

    def vectors(self, model: str, dims: int) -> DataFrame:
        """Those of a model, the last saved of each (id, content_hash); none where it is not the model that is recorded."""
        numbers = self._generations()
        held = self._saved(f"{self._generation(numbers[-1])}/vectors") if numbers and self.model() == (model, dims) else None
        if held is None:
            return self.spark.createDataFrame([], VECTORS)
        mine = held.where((F.col("model") == model) & (F.col("dims") == dims))
        last = mine.groupBy("id", "content_hash").agg(F.max(F.struct("seq", "model", "dims", "embedding")).alias("v"))
        return last.select("id", "content_hash", "v.model", "v.dims", "v.embedding")

    def compact_vectors(self) -> None:
        """Writes the last vectors as a generation of their own, one row each."""
        held = self.model()
        if held is None:
            return
        number = self._generations()[-1] + 1
        self.vectors(*held).withColumn("seq", F.lit(1).cast("long")).write.mode("overwrite").parquet(f"{self._generation(number)}/vectors")
        self._begin(number, *held)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """A text file of "hash  path" lines."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).where(F.col("value").contains("  ")).select(parts[1].alias("path"), parts[0].alias("sha256"))


def write_checksums(table: DataFrame, path: str) -> None:
    table.orderBy("path").select(F.concat_ws("  ", "sha256", "path")).write.mode("overwrite").text(path)


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, embedding, error) of files of bare little-endian float32."""

    def run(batches):
        for pdf in batches:
            raw = [bytes(b) for b in pdf["content"]]
            bad = [len(b) % 4 != 0 for b in raw]
            yield pd.DataFrame({"path": pdf["path"], "embedding": [None if x else np.frombuffer(b, "<f4").tolist() for b, x in zip(raw, bad, strict=True)], "error": ["corrupt: size is no multiple of 4" if x else "" for x in bad]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vec").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, embedding array<float>, error string")


def write_vector_files(vectors: DataFrame, root: str) -> None:
    """Writes each vector as a file of bare little-endian float32 below a root that all executors share; each is replaced as a whole."""
    import os
    import uuid

    def run(rows):
        os.makedirs(root, exist_ok=True)
        for r in rows:
            path = os.path.join(root, vector_file_name(r["id"], r["content_hash"]))
            made = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(made, "wb") as f:
                f.write(np.array(r["embedding"], "<f4").tobytes())
            os.replace(made, path)

    vectors.select("id", "content_hash", "embedding").foreachPartition(run)


def vector_file_name(page_id: str, content_hash: str) -> str:
    import hashlib

    return hashlib.sha256(f"{page_id}:{content_hash}".encode()).hexdigest() + ".vec"
