"""Token counts of documents through a cache of digests.

A text's normalised content has a SHA-256 digest, and so have a tokenizer's file, its library and
the library's version. The cache is a Parquet table of (digest, tokenizer, n_bytes, n_tokens, run).
A run joins the digests of its documents, without the texts, to the cached ones of its tokenizer; the digests
that miss pick the texts, each of which is encoded once, however many documents hold it, and is
appended. Then all documents get their counts by a join of digests. `run` labels the run that
encoded a text.

Normalisation must not change a count, so by default it only makes null the empty text. Where a
tokenizer ignores more, give the column expression that takes it away.

Before texts are shuffled each task drops those it has sent already, so a text that a third of all
rows hold gives one row a task. Missing digests are broadcast where a count says that they are
at most BROADCAST; else both sides are shuffled. Two runs at a time may both append a digest; one row of each
is read. A run that fails between tasks has appended nothing, as the table is committed as a whole.

A null text is empty and has no tokens. Rows of any id, null or repeated, come back one for one.
Very long texts are encoded whole. An empty table appends nothing. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_batches, column, slices

#: Fixed value: the split of byte-level tokenizers that `by_pieces` relies on.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: White space and what follows it, to the next white space; and white space beyond ASCII, before which no text is cut.
PIECE = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Pieces whose counts a worker remembers; when it is full it starts anew.
REMEMBERED = 400_000
CACHE = "digest string, tokenizer string, n_bytes long, n_tokens long, run string"
#: Missing digests that are broadcast at most: some 10 MB.
BROADCAST = 100_000
_LOADED: dict[str, Counter] = {}


def library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that runs it."""
    with open(path, "rb") as f:
        file = hashlib.sha256(f.read()).hexdigest()
    name = library(path)
    return hashlib.sha256(f"{name} {importlib.import_module(name).__version__} {file}".encode()).hexdigest()


def by_pieces(path: str) -> bool:
    """Whether the tokens of a text are those of its PIECEs: the split takes white space with what follows it and nothing merges beyond."""
    if library(path) != "tokenizers":
        return False
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in parts["added_tokens"])
    return parts["pre_tokenizer"] == BYTE_LEVEL and plain and not (parts["normalizer"] or parts["post_processor"] or parts["truncation"] or parts["padding"])


class Counter:
    """Tokens of texts, as the library gives them; a worker keeps one for each tokenizer."""

    def __init__(self, path: str):
        self.kind, self.pieces, self.known = library(path), by_pieces(path), {}
        if self.kind == "tokenizers":
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
            self.encoder = Tokenizer.from_file(path)
            self.encoder.no_truncation()
            self.encoder.no_padding()
        else:
            from sentencepiece import SentencePieceProcessor

            self.encoder = SentencePieceProcessor(model_file=path)

    def whole(self, texts: list[str]) -> list[int]:
        if self.kind == "tokenizers":
            return [len(e) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(ids) for ids in self.encoder.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> np.ndarray:
        if not self.pieces:
            return np.array(self.whole(texts), np.int64)
        cut = [[t] if OTHER_SPACE.search(t) else PIECE.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({p for ps in cut for p in ps}.difference(self.known))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.known.update(zip(some, self.whole(some), strict=True))
        return np.fromiter((sum(map(self.known.__getitem__, ps)) for ps in cut), np.int64, len(texts))


def counts(path: str, texts: list[str]) -> np.ndarray:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path].counts(texts)


def first_of_each(batches):
    """Drops rows whose digest this task has had."""
    seen: set[str] = set()
    for batch in batches:
        keep = []
        for digest in column(batch, "digest").to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest, n_bytes, n_tokens, run of one tokenizer, each digest once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE).drop("tokenizer")
    held = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return held.groupBy("digest").agg(F.min(F.struct("run", "n_bytes", "n_tokens")).alias("c")).select("digest", "c.n_bytes", "c.n_tokens", "c.run")


def count_tokens(docs: DataFrame, cache: str, path: str, run: str = "", limit: int = 1024, normalise: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, digest, run of every row; brings the cache (a folder that all executors share) up to date."""
    spark = docs.sparkSession
    tokenizer = version(path)
    content = F.coalesce(F.col(text) if normalise is None else normalise, F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("digest"))
    missing = keyed.select("digest").distinct().join(cached(spark, cache, tokenizer).select("digest"), "digest", "left_anti")
    n = missing.count()
    if n:
        texts = bounded_batches(docs).select(F.sha2(content, 256).alias("digest"), content.alias("text"))
        if n <= BROADCAST:
            wanted = texts.join(F.broadcast(missing), "digest", "left_semi").mapInArrow(first_of_each, texts.schema).repartition("digest")
        else:
            wanted = texts.mapInArrow(first_of_each, texts.schema).repartition("digest").join(missing, "digest", "left_semi")

        def encode(batches):
            for batch in slices(first_of_each(batches), 1 << 20):
                held = column(batch, "text").to_pylist()
                sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in held], pa.int64())
                k = len(held)
                yield pa.RecordBatch.from_arrays([column(batch, "digest").cast(pa.string()), pa.array([tokenizer] * k, pa.string()), sizes, pa.array(counts(path, held)), pa.array([run] * k, pa.string())], schema=schema)

        schema = pa.schema([("digest", pa.string()), ("tokenizer", pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("run", pa.string())])
        wanted.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    found = cached(spark, cache, tokenizer).select("digest", "n_tokens", "run")
    return keyed.join(found, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest", "run")
