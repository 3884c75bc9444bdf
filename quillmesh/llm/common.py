"""Helpers that the corpus operators share: shared folder, table reading, sizing and batch access."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.shared import shared_dir, written

__all__ = ["shared_dir", "written"]

#: Words are separated by these bytes only; bytes.split() uses the same six.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: As a table of bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text that one group of documents holds, so that a Python worker stays within a few hundred MB.
GROUP_BYTES = 8 << 20
#: What goes to a Python worker at once; Spark's own bound of 10,000 records is no bound for texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session whose Arrow batches have BATCH_BYTES or one row from here on."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def n_groups(docs: DataFrame, text: str = "text", each: int = GROUP_BYTES) -> int:
    """How many groups of about `each` bytes of text to make; a scan of all rows."""
    total = docs.agg(F.sum(F.octet_length(text) + F.lit(64)).alias("b")).first()["b"] or 0
    return int(max(1, -(-total // each)))


def release() -> None:
    """Gives back what a worker has freed: workers are reused, and stay beside the JVM while later stages run in it alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(values: pa.Array) -> list[bytes]:
    """The texts as bytes; null becomes empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return [b"" if x is None else x for x in values.cast(pa.large_binary()).to_pylist()]


def slices(batches, most: int = 4 << 20, text: str = "text"):
    """Cuts record batches so that each has about `most` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum([0 if x is None else x for x in pc.binary_length(column(batch, text)).to_pylist()])
        start = 0
        while start < n:
            done = int(size[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def distinct(values: np.ndarray) -> np.ndarray:
    """In ascending order; sorts, which for numbers takes less than numpy's hashing."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def numbered_words(data: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts that lie end to end with white space between them, the place of each word among them, and how many each text has."""
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    _, edges, raw = words.dictionary.buffers()
    edges, raw = np.frombuffer(edges, np.int64, len(words.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], words.indices.to_numpy(), np.diff(np.searchsorted(first, ends), prepend=0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(ids: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of each k consecutive 64-bit items; empty if there are fewer."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(base)
        out += ids[j : j + n]
    return mix64(out)
