"""Enrichment: deterministic extraction, merges by policy, and what a merge changed.

Pages are rows; a merge is a projection, so the page before it is never touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import collections as C
from quillmesh.functions import text as X
from quillmesh.schema import ENTITY_TYPES

CREATED_BY = "quillmesh-enrich-v1"
TIER1_TYPE, TIER1_CONFIDENCE = "document", 0.7
#: Document types that models give, and what they count as.
MODEL_TYPES = {"PERSON": "person", "ORGANIZATION": "organization", "CONCEPT": "concept", "PROJECT": "project", "EVENT": "event", "LOCATION": "place", "OTHER": "document", "DATE": "event"}
#: Of types that are as frequent, the one with the lower number wins; all others come after.
TYPE_PRIORITY = {"OTHER": 0, "PERSON": 1, "PROJECT": 2, "CONCEPT": 3, "ORGANIZATION": 4, "DATE": 5, "EVENT": 6, "LOCATION": 7, "TOOL": 8, "TECHNOLOGY": 99}
UNKNOWN_PRIORITY = 1000
#: Strength of edges from subject-predicate-object and from index triples.
SPO_STRENGTH, TRIPLE_STRENGTH = 0.7, 0.8


def extracted(path: Column, body: Column, root: str, created_by: str = CREATED_BY) -> Column:
    """What can be read off a document: id, title, type, confidence, tags, edges, sources."""
    base = X.stem(path)
    tags = C.distinct_strings(F.concat(X.extract_hashtags(body), X.directory_tags(path, root)))
    return F.struct(
        X.slugify(base).alias("id"), X.extract_title(body, base).alias("title"), F.lit(TIER1_TYPE).alias("entity_type"), F.lit(TIER1_CONFIDENCE).alias("confidence"),
        tags.alias("tags"), X.extract_wikilinks(body).alias("relationships"), F.struct(X.extract_urls(body).alias("sources"), F.lit(created_by).alias("created_by")).alias("provenance"),
    )


def tier1(pages: DataFrame, root: str) -> DataFrame:
    """pages with `extracted`."""
    return pages.withColumn("extracted", extracted(F.col("source_path"), F.col("body"), root))


def _kept(old: Column, new: Column, force: bool, unset: Column) -> Column:
    """Forced: the new value unless it is empty. Else the old one unless it is."""
    if force:
        return F.when(new == unset, old).otherwise(new)
    return F.when(old == unset, new).otherwise(old)


def merge_frontmatter(pages: DataFrame, extracted: str = "extracted", force: bool = False) -> DataFrame:
    """pages merged with their extracted fields; by default empty fields are filled and lists united."""
    x = F.col(extracted)
    none, zero = F.lit(""), F.lit(0.0)
    lists = {"tags": (F.col("tags"), x["tags"], C.union_strings, C.distinct_strings), "relationships": (F.col("relationships"), x["relationships"], C.union_edges, C.distinct_edges), "sources": (F.col("provenance.sources"), x["provenance"]["sources"], C.union_strings, C.distinct_strings)}
    made = {k: F.when(F.size(new) > 0, distinct(new)).otherwise(old) if force else union(old, new) for k, (old, new, union, distinct) in lists.items()}
    scalars = {c: _kept(F.col(c), x[c], force, none) for c in ("id", "title", "entity_type")}
    # A forced confidence has to be above zero.
    confidence = F.when(x["confidence"] > 0, x["confidence"]).otherwise(F.col("confidence")) if force else _kept(F.col("confidence"), x["confidence"], False, zero)
    provenance = F.struct(made["sources"].alias("sources"), _kept(F.col("provenance.created_by"), x["provenance"]["created_by"], force, none).alias("created_by"))
    return pages.withColumns(scalars | {"confidence": confidence, "tags": made["tags"], "relationships": made["relationships"], "provenance": provenance, "entities": C.distinct_entities(F.col("entities"))})


def merge_summary(pages: DataFrame, summary: Column, force: bool = False) -> DataFrame:
    fill = summary != "" if force else (summary != "") & (F.col("summary") == "")
    return pages.withColumn("summary", F.when(fill, summary).otherwise(F.col("summary")))


def normal_type(kind: Column) -> Column:
    """Canonical type of a model's document type; empty if it has none."""
    mapped = reduce(lambda acc, kv: acc.when(F.upper(kind) == kv[0], kv[1]), list(MODEL_TYPES.items())[1:], F.when(F.upper(kind) == "PERSON", "person"))
    return F.coalesce(mapped, F.when(F.lower(kind).isin(ENTITY_TYPES), F.lower(kind)), F.lit(""))


def is_residual(kind: Column) -> Column:
    """A type that is given but maps to nothing."""
    return (kind != "") & (normal_type(kind) == "")


def merge_model(pages: DataFrame, model: str = "model", force: bool = False) -> DataFrame:
    """pages merged with a model's struct(entity_type, summary, entities, relationships, semantic_hints, possible_questions).

    A type other than "document" stays whatever the model says. A model's edges are semantic ones.
    """
    m = F.col(model)
    open_type = F.lower("entity_type").isin("", "document")
    kind = F.when(open_type & (normal_type(m["entity_type"]) != ""), normal_type(m["entity_type"])).otherwise(F.col("entity_type"))
    summary = _kept(F.col("summary"), m["summary"], force, F.lit(""))
    lists = (("entities", "entities", C.union_entities, C.distinct_entities), ("semantic_relationships", "relationships", C.union_edges, C.distinct_edges), ("semantic_hints", "semantic_hints", C.union_strings, C.distinct_strings), ("possible_questions", "possible_questions", C.union_strings, C.distinct_strings))
    made = {own: F.when(F.size(m[new]) > 0, distinct(m[new])).otherwise(F.col(own)) if force else union(F.col(own), m[new]) for own, new, union, distinct in lists}
    return pages.withColumns({"entity_type": kind, "summary": summary, **made})


def tier1_complete() -> Column:
    return (F.col("id") != "") & (F.col("title") != "") & (F.col("entity_type") != "") & (F.col("confidence") > 0)


def tier2_complete() -> Column:
    return F.col("summary") != ""


def needs_enrichment(text: Column | None = None, tier2: bool = False) -> Column:
    """Pages that an enrichment takes on: incomplete ones, and of raw files those without frontmatter."""
    done = tier1_complete() & tier2_complete() if tier2 else tier1_complete()
    return ~done if text is None else ~done & ~X.has_frontmatter(text)


def delta(before: Column, after: Column) -> Column:
    """What changed between two frontmatter structs: flags, lists of what was added, removed, modified, and `changed`."""
    flags = {f"{c}_changed": before[c] != after[c] for c in ("id", "title", "entity_type", "confidence", "summary")}
    flags["created_by_changed"] = before["provenance"]["created_by"] != after["provenance"]["created_by"]
    lists: dict[str, Column] = {}
    for name, a, b in (("tags", before["tags"], after["tags"]), ("sources", before["provenance"]["sources"], after["provenance"]["sources"]), ("semantic_hints", before["semantic_hints"], after["semantic_hints"]), ("questions", before["possible_questions"], after["possible_questions"])):
        lists |= {f"{name}_added": C.without(b, a, F.lower), f"{name}_removed": C.without(a, b, F.lower)}
    # Edges are told apart by target alone, entities by name; the rest of each is its body.
    for name, key, body in (("relationships", lambda r: r["target"], lambda r: F.struct(r["type"], r["strength"])), ("entities", lambda e: e["name"], lambda e: F.struct(e["role"], e["aliases"]))):
        a, b = before[name], after[name]
        lists |= {f"{name}_added": C.without(b, a, key), f"{name}_removed": C.without(a, b, key), f"{name}_modified": C.modified(a, b, key, body)}
    changed = reduce(Column.__or__, [*flags.values(), *(F.size(x) > 0 for x in lists.values())])
    return F.struct(*(v.alias(k) for k, v in (flags | lists).items()), changed.alias("changed"))


def enrich_pages(pages: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Merged pages with `delta`."""
    from quillmesh.schema import FRONTMATTER

    names = [f.name for f in FRONTMATTER]
    before = tier1(pages, root).withColumn("__before", F.struct(*names))
    return merge_frontmatter(before, force=force).withColumn("delta", delta(F.col("__before"), F.struct(*names))).drop("__before", "extracted")


def vote(roles: DataFrame, group: str, role: str = "role") -> DataFrame:
    """group, entity_type: the most frequent role, lower case; of several the one of lowest priority number, then name."""
    counts = roles.where(F.col(role) != "").groupBy(group, role).agg(F.count(F.lit(1)).alias("n"))
    number = reduce(lambda acc, kv: acc.when(F.col(role) == kv[0], kv[1]), list(TYPE_PRIORITY.items())[1:], F.when(F.col(role) == "OTHER", 0)).otherwise(UNKNOWN_PRIORITY)
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), number.alias("p"), F.col(role).alias("role"))).alias("best")).select(group, F.lower("best.role").alias("entity_type"))


def edges_of_spo(relations: Column) -> Column:
    """Edges of (subject, predicate, object) structs; those without predicate or object fall out."""
    made = F.transform(relations, lambda r: F.struct(X.trimmed(r["object"]).alias("target"), X.trimmed(r["predicate"]).alias("type"), F.lit(SPO_STRENGTH).alias("strength")))
    return F.filter(made, lambda r: (r["target"] != "") & (r["type"] != ""))


def triples(items: DataFrame, group: str, item: str = "item") -> DataFrame:
    """group, target, type, strength of "(subject, predicate, object)" items whose ends "[n], TYPE:name" items define."""
    named = items.select(group, F.regexp_extract(item, r"^\[(.*?)\], ([^:]*):(.*)$", 1).alias("n"), X.trimmed(F.regexp_extract(item, r"(?s)^\[(.*?)\], ([^:]*):(.*)$", 3)).alias("name")).where("n <> ''")
    told = items.where(F.col(item).startswith("(")).select(group, F.split(F.regexp_replace(item, r"^\(|\)$", ""), ", ").alias("p")).where("size(p) = 3")
    told = told.select(group, *(X.trimmed(F.col("p")[i]).alias(c) for i, c in enumerate(("s", "type", "o"))))
    subjects = named.select(group, F.col("n").alias("s")).distinct()
    objects = named.groupBy(group, F.col("n").alias("o")).agg(F.max("name").alias("target"))
    return told.join(subjects, [group, "s"], "left_semi").join(objects, [group, "o"]).select(group, "target", "type", F.lit(TRIPLE_STRENGTH).alias("strength"))
