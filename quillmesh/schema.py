"""Canonical tables of the knowledge graph.

A page is a node, a document and a row. Absent strings are empty, absent numbers zero, absent
lists empty, so that predicates never meet a null; `conform` brings any frame to that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
ENTITY = T.StructType([T.StructField("name", T.StringType()), T.StructField("aliases", STRINGS), T.StructField("role", T.StringType())])
RELATIONSHIP = T.StructType([T.StructField("target", T.StringType()), T.StructField("type", T.StringType()), T.StructField("strength", T.DoubleType())])
TEMPORAL = T.StructType([T.StructField("valid_from", T.StringType()), T.StructField("valid_until", T.StringType()), T.StructField("last_verified", T.StringType()), T.StructField("decay_rate", T.DoubleType())])
PROVENANCE = T.StructType([T.StructField("sources", STRINGS), T.StructField("created_by", T.StringType())])
ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("field", "message", "fix")])
MATCH = T.StructType([T.StructField(n, T.StringType()) for n in ("field", "value", "type")])

FRONTMATTER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("entity_type", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("tags", STRINGS), T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relationships", T.ArrayType(RELATIONSHIP)), T.StructField("semantic_relationships", T.ArrayType(RELATIONSHIP)),
    T.StructField("temporal", TEMPORAL), T.StructField("provenance", PROVENANCE), T.StructField("summary", T.StringType()), T.StructField("semantic_hints", STRINGS), T.StructField("possible_questions", STRINGS),
])
PAGE = T.StructType([*FRONTMATTER, T.StructField("body", T.StringType()), T.StructField("source_path", T.StringType())])

#: The canonical entity types.
ENTITY_TYPES = ["document", "person", "project", "concept", "organization", "software", "event", "place", "tool", "paper"]


def filled(column: Column, kind: T.DataType) -> Column:
    """The column cast to the type, with the type's empty value for null, all the way down."""
    if isinstance(kind, T.StructType):
        parts = F.struct(*(filled(column[f.name], f.dataType).alias(f.name) for f in kind))
        return parts
    if isinstance(kind, T.ArrayType):
        items = column if not isinstance(kind.elementType, T.StructType) else F.transform(column, lambda x: filled(x, kind.elementType))
        return F.coalesce(items.cast(kind), F.array().cast(kind))
    empty = {"string": F.lit(""), "double": F.lit(0.0), "boolean": F.lit(False)}[kind.simpleString()]
    return F.coalesce(column.cast(kind), empty)


def conform(pages: DataFrame) -> DataFrame:
    """pages with exactly the columns of PAGE; columns that are absent are empty."""
    empty = {f.name: F.from_json(F.lit("{}"), T.StructType([T.StructField("x", f.dataType)]))["x"] for f in PAGE}
    return pages.select(*(filled(F.col(f.name) if f.name in pages.columns else empty[f.name], f.dataType).alias(f.name) for f in PAGE))
