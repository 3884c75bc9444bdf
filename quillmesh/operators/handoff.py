"""Results that someone else brings for pages a model failed on: parsed, joined to their files, merged.

The document is YAML with `files`, each with a path, entity_type, summary, entities and
relationships (subject, predicate, object). Every entry has an outcome of its own; one that
cannot be applied takes nothing from the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import strip_fence
from quillmesh.operators import enrich
from quillmesh.sources import markdown
from quillmesh.sources.shared import written

RESULTS = "ord int, path string, entity_type string, summary string, entities array<struct<name:string,type:string>>, relationships array<struct<subject:string,predicate:string,object:string>>"


def _text(x) -> str:
    return "" if x is None else str(x)


def parse_results(spark: SparkSession, text: str) -> DataFrame:
    """RESULTS of a document, fenced or not; ValueError if it is empty, no YAML, or without files."""
    import yaml

    inside = spark.range(1).select(strip_fence(F.lit(text)).alias("t")).first()["t"]
    if not inside:
        raise ValueError("the document is empty")
    try:
        told = yaml.safe_load(inside)
    except yaml.YAMLError as e:
        raise ValueError(f"the document is no YAML: {e}") from e
    files = told.get("files") if isinstance(told, dict) else None
    if not isinstance(files, list) or not files:
        raise ValueError("the document has no files")
    each = lambda file, part, keys: [tuple(_text(x.get(k)) for k in keys) for x in file.get(part) or [] if isinstance(x, dict)]
    rows = [(i, *(_text(f.get(k)) for k in ("path", "entity_type", "summary")), each(f, "entities", ("name", "type")), each(f, "relationships", ("subject", "predicate", "object"))) for i, f in enumerate(files) if isinstance(f, dict)]
    return spark.createDataFrame(rows, RESULTS)


def as_model(results: DataFrame) -> DataFrame:
    """results with `model`, the struct that enrich.merge_model takes. An edge to a named entity takes that entity's spelling, of several the last one's."""
    named = F.filter(F.transform("entities", lambda e: F.struct(F.trim(e["name"]).alias("name"), F.array().cast("array<string>").alias("aliases"), F.trim(e["type"]).alias("role"))), lambda e: e["name"] != "")
    edges = enrich.edges_of_spo(F.col("relationships"))

    def spelt(edge):
        same = F.filter(named, lambda e: F.lower(e["name"]) == F.lower(edge["target"]))
        return F.struct(F.coalesce(F.get(same, F.size(same) - 1)["name"], edge["target"]).alias("target"), edge["type"].alias("type"), edge["strength"].alias("strength"))

    none = F.array().cast("array<string>")
    model = F.struct(F.lower(F.trim("entity_type")).alias("entity_type"), F.trim("summary").alias("summary"), named.alias("entities"), F.transform(edges, spelt).alias("relationships"), none.alias("semantic_hints"), none.alias("possible_questions"))
    return results.withColumn("model", model)


def apply_results(files: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """files: (path, text). ord, path, applied, error and, where applied, the file's new text, of every result.

    Nothing is written; `markdown.write_files` is the sink. Where two results name one file, each
    is applied to the file as it is.
    """
    wanted = as_model(results).select("ord", F.col("path").alias("source_path"), "model")
    held = files.join(wanted.select(F.col("source_path").alias("path")).distinct(), "path", "left_semi").select("path", "text")
    held = written(held)  # files may be rendered ones, and these are read twice below
    pages = markdown.parsed(held, strict=False).join(held.withColumnRenamed("path", "source_path"), "source_path")
    both = wanted.join(pages, "source_path", "left")
    blank = F.trim("source_path") == ""
    error = F.when(blank, "the entry has no path").when(F.col("text").isNull(), "the file is not there").when(F.col("error") != "", F.concat(F.lit("the file cannot be read: "), F.col("error"))).otherwise("")
    told = both.withColumn("error", error)
    good = enrich.merge_model(told.where("error = ''"), force=force)
    texts = markdown.replaced_in(good.select(*[f.name for f in markdown.PAGE], "ord", "text"))
    return told.select("ord", F.col("source_path").alias("path"), (F.col("error") == "").alias("applied"), "error").join(texts, "ord", "left")
