"""Pages of markdown files as a data source of Spark.

    register(spark)
    spark.read.format("quillmesh").option("pattern", "*.md").load("/kb").where("source_path LIKE '/kb/people/%'")
    pages.write.format("quillmesh").mode("append").save("/kb")

The folder must be on a mount that the driver and all executors share. Reading: files are listed
on the driver, filters on source_path (equal, in, starts with, ends with, contains) choose among them
before any is opened, and `filesPerTask` of them make a task. A file that cannot be parsed is a row with `error`;
option strict=false reads a text without frontmatter as all body.

Writing: each task renders its pages into a staging folder, with a list of them in buckets of their paths;
the job's commit moves the files to their places, each in one step, and an abort removes the staging folder, so
a failed task leaves no file. A page's source_path is below the folder, or relative to it. Two pages of one path
fail the job before anything has moved. Other files stay, so the mode is append.

The driver holds the paths that are read compressed, and of those that are written a few buckets at a time.
"""

from __future__ import annotations

import fnmatch
import heapq
import json
import os
import re
import shutil
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quillmesh.schema import FRONTMATTER, PAGE
from quillmesh.sources import markdown

FORMAT = "quillmesh"
SCHEMA = T.StructType([*PAGE, T.StructField("error", T.StringType())])
FILES_PER_TASK = 500
STAGING = ".staging-"
#: A task's list of its pages, in buckets of paths; equal paths are in the same one.
LIST, BUCKETS = "list", 1024
#: What the commit reads of the tasks' lists at once, or one bucket.
LIST_BYTES = 16 << 20


def _root(options) -> str:
    path = re.sub("^file:(//)?", "", options.get("path", "")).rstrip("/")
    if not path:
        raise ValueError("no path is given")
    return path


class Files(InputPartition):
    """Paths that are much alike take few bytes."""

    def __init__(self, paths: list[str]):
        self.packed = zlib.compress(json.dumps(sorted(paths)).encode(), 1)

    @property
    def paths(self) -> list[str]:
        return json.loads(zlib.decompress(self.packed))


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder, and where in its list each bucket begins and the last one ends."""

    folder: str
    edges: list[int]

    def moves(self, first: int = 0, end: int = BUCKETS) -> Iterator[tuple[str, str]]:
        """(staged file, path) of the buckets from first to before end."""
        left = self.edges[end] - self.edges[first]
        if left:
            with open(os.path.join(self.folder, LIST), "rb") as f:
                f.seek(self.edges[first])
                while left:
                    line = f.readline()
                    left -= len(line)
                    name, path = json.loads(line)
                    yield os.path.join(self.folder, name), path


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.pattern = _root(options), options.get("pattern", "*.md")
        self.strict = options.get("strict", "true").lower() != "false"
        self.per_task = int(options.get("filesPerTask", FILES_PER_TASK))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("source_path",):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        tests = {EqualTo: str.__eq__, In: lambda p, v: p in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
        return all(tests[type(f)](path, f.value) for f in self.filters)

    def partitions(self) -> list[Files]:
        found: list[Files] = []
        names: list[str] = []
        folders = [self.root]
        while folders:
            below = []
            try:
                entries = os.scandir(folders.pop())
            except OSError:  # not there, or not to be read
                continue
            with entries:
                for e in entries:
                    if e.name.startswith((".", "_")):
                        continue
                    if e.is_dir():
                        if not e.is_symlink():
                            below.append(e.path)
                    elif fnmatch.fnmatch(e.name, self.pattern) and self.wanted(e.path):
                        names.append(e.path)
                        if len(names) == self.per_task:
                            found.append(Files(names))
                            names = []
            folders += sorted(below, reverse=True)
        return [*found, Files(names)] if names or not found else found

    def read(self, partition: Files) -> Iterator[tuple]:
        empty = markdown._fields({}) | {"body": ""}
        for path in partition.paths:
            try:
                page = markdown.read_file(path, self.strict) | {"error": ""}
            except Exception as e:  # the row stays, with what is wrong with it
                page = empty | {"source_path": path, "error": str(e)}
            yield tuple(page[f.name] for f in SCHEMA)


class PagesWriter(DataSourceWriter):
    def __init__(self, options):
        self.root = _root(options)
        self.staging = os.path.join(self.root, STAGING + uuid.uuid4().hex)

    def write(self, iterator: Iterator) -> Staged:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(folder)
        buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
        for n, page in enumerate(iterator):
            path = os.path.normpath(os.path.join(self.root, page["source_path"] or ""))
            if not page["source_path"] or not path.startswith(self.root + os.sep):
                raise ValueError(f"{page['source_path']!r} is not below {self.root}")
            with open(os.path.join(folder, str(n)), "w", encoding="utf-8", newline="") as f:
                f.write(markdown.render(page))
            buckets[zlib.crc32(path.encode()) % BUCKETS].append(json.dumps([str(n), path]) + "\n")
        edges = [0]
        with open(os.path.join(folder, LIST), "wb") as f:
            for lines in buckets:
                edges.append(edges[-1] + f.write("".join(lines).encode()))
        return Staged(folder, edges)

    def commit(self, messages: list[Staged | None]) -> None:
        tasks, twice = [m for m in messages if m is not None], []
        sizes = [sum(m.edges[b + 1] - m.edges[b] for m in tasks) for b in range(BUCKETS)]
        first = 0
        while first < BUCKETS:
            end = first + 1
            while end < BUCKETS and sum(sizes[first : end + 1]) <= LIST_BYTES:
                end += 1
            seen = Counter(path for m in tasks for _, path in m.moves(first, end))
            twice = heapq.nsmallest(5, twice + [p for p, n in seen.items() if n > 1])
            first = end
        if twice:
            self.abort(messages)
            raise ValueError(f"several pages of one path: {', '.join(twice)}")
        for m in tasks:
            for made, path in m.moves():
                try:
                    os.replace(made, path)
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    os.replace(made, path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PagesReader:
        return PagesReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PagesWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode append")
        lacking = [f.name for f in PAGE if f.name not in schema.names]
        if lacking:
            raise ValueError(f"columns are missing: {', '.join(lacking)}")
        return PagesWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and turns on spark.sql.python.filterPushdown.enabled, without which Spark refuses a source that takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(PagesSource)
