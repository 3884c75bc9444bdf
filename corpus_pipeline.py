"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

A null or empty text fails the quality rules. Rows with a null doc_id stay through the near-duplicate
stage, as nothing names them. Of repeated rows that stage keeps one. Very long texts are handled
whole. An empty table gives empty tables. Extra columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.bitplanes import SHARDS, read_documents, write_shards
from quillmesh.llm.common import table
from quillmesh.llm.decontaminate import drop_contaminated
from quillmesh.llm.mixing import mixed_documents
from quillmesh.llm.repetition import quality_filter
from quillmesh.llm.simhash import drop_near_duplicates
from quillmesh.sources.shared import passing, remove, shared_dir, written

#: The tokenizer's file among the public ones, and the id that ends each document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: How often the mix may repeat a source.
MAX_REPEATS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, k=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, max_repeats=MAX_REPEATS)


def file_order(docs: DataFrame) -> list[Column]:
    """Columns that order rows as they stand in the files that docs is read from, from file to file; none for other frames."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return []
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as the written files have them, in the order of the mix."""
    import public_tokenizers

    path = shared_dir(spark)
    write_shards(docs, path, public_tokenizers.path(TOKENIZER), END_ID, order=file_order(docs))
    return read_documents(spark.read.schema(SHARDS).parquet(path))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token ids", token_ids)]
#: Fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return docs
