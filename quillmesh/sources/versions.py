"""Versions of a set of tables below one folder: a version counts once all of its tables are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.sources.shared import written


class Versions:
    """Readers see the newest version whose last table is whole. One writer at a time; `keep` versions stay."""

    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...], keep: int = 2):
        self.spark, self.root, self.tables, self.keep = spark, root.rstrip("/"), tables, keep

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        fs = self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(self._path()) if s.getPath().getName().isdigit()) if fs.exists(self._path()) else []

    def current(self) -> int:
        """The newest whole version; 0 if there is none."""
        fs = self._fs()
        return max((n for n in self.numbers() if fs.exists(self._path(str(n), self.tables[-1], "_SUCCESS"))), default=0)

    def read(self) -> dict[str, DataFrame]:
        n = self.current()
        if not n:
            raise FileNotFoundError(f"no version below {self.root}")
        return {t: self.spark.read.parquet(f"{self.root}/{n}/{t}") for t in self.tables}

    def begin(self) -> int:
        """The number of the next version."""
        return max(self.numbers(), default=0) + 1

    def put(self, n: int, table: str, df: DataFrame) -> DataFrame:
        """Writes a table of the version that has begun, the last one last, and reads it."""
        return written(df, f"{self.root}/{n}/{table}")

    def finish(self) -> None:
        """Versions older than those that are kept go, as do such as were never whole."""
        fs = self._fs()
        whole = [k for k in self.numbers() if fs.exists(self._path(str(k), self.tables[-1], "_SUCCESS"))]
        for k in self.numbers():
            if k not in whole[-self.keep :]:
                fs.delete(self._path(str(k)), True)

    def write(self, tables: dict[str, DataFrame]) -> int:
        """The next version, all at once."""
        n = self.begin()
        for t in self.tables:
            self.put(n, t, tables[t])
        self.finish()
        return n
