"""Results as text for people and as JSON, one row for each thing told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE_FOUND = "No results found."


def _line(label: str, value: Column, when: Column | None = None) -> Column:
    line = F.concat(F.lit(label), value)
    return line if when is None else F.when(when, line)


def results(found: DataFrame) -> DataFrame:
    """rank, text, json of search results (id, title, entity_type, summary, score, matches), best first."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "title", "id"))
    kind = F.when(F.col("entity_type") == "", "").otherwise(F.format_string(" (%s)", "entity_type"))
    ranked = found.withColumn("rank", rank)
    text = F.concat_ws(
        "\n", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), kind, F.format_string("  [score: %.2f]", "score")), _line("   ID: ", F.col("id")),
        _line("   Summary: ", F.col("summary"), F.col("summary") != ""), _line("   Matched: ", F.array_join("matches.field", ", "), F.size("matches") > 0),
    )
    matches = F.transform("matches", lambda m: F.struct(m["field"].alias("field"), m["value"].alias("value")))
    told = F.struct("id", "title", "entity_type", F.nullif("summary", F.lit("")).alias("summary"), "score", matches.alias("matches"))
    return ranked.select("rank", text.alias("text"), F.to_json(told).alias("json"))


def pages(found: DataFrame) -> DataFrame:
    """id, text, json of pages."""
    text = F.concat_ws(
        "\n", _line("ID:          ", F.col("id")), _line("Title:       ", F.col("title")), _line("Type:        ", F.col("entity_type")), _line("Summary:     ", F.col("summary"), F.col("summary") != ""),
        F.format_string("Confidence:  %.2f", "confidence"), _line("Tags:        ", F.array_join("tags", ", "), F.size("tags") > 0), _line("Entities:    ", F.size("entities").cast("string"), F.size("entities") > 0),
        _line("Relationships: ", F.size("relationships").cast("string"), F.size("relationships") > 0), _line("\n", F.col("body"), F.col("body") != ""),
    )
    told = F.struct("id", "title", "entity_type", F.nullif("summary", F.lit("")).alias("summary"), "confidence", "tags", "body", "source_path", "entities", "relationships")
    return found.select("id", text.alias("text"), F.to_json(told).alias("json"))


def traversal(nodes: DataFrame, graph_pages: DataFrame) -> DataFrame:
    """id, depth, text, json of found nodes, indented by depth."""
    held = nodes.join(graph_pages.select("id", "title", "entity_type"), "id")
    kind = F.when(F.col("entity_type") == "", "").otherwise(F.format_string(" (%s)", "entity_type"))
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") > 0, "- ").otherwise(""), F.col("title"), kind)
    return held.select("id", "depth", text.alias("text"), F.to_json(F.struct("id", "title", "entity_type", "depth")).alias("json"))


def stats(row: DataFrame) -> DataFrame:
    """text and json of one row of pages, entities, relationships, tags (an array)."""
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("(none)")
    text = F.concat_ws("\n", _line("Pages:         ", F.col("pages").cast("string")), _line("Entities:      ", F.col("entities").cast("string")), _line("Relationships: ", F.col("relationships").cast("string")), _line("Tags:          ", tags))
    return row.select(text.alias("text"), F.to_json(F.struct("pages", "entities", "relationships", "tags")).alias("json"))


def issues(validated: DataFrame) -> DataFrame:
    """source_path, text of pages (with `issues`) that have any."""
    lines = F.transform("issues", lambda i: F.concat(F.lit("    - "), i["field"], F.lit(": "), i["message"], F.lit("\n      Fix: "), i["fix"], F.lit("\n")))
    return validated.where(F.size("issues") > 0).select("source_path", F.concat(F.lit("  "), F.col("source_path"), F.lit("\n"), F.array_join(lines, "")).alias("text"))


def retry_brief(failed: DataFrame, root: str) -> str:
    """What to hand to whoever retries failed extractions: a markdown brief of the queue (ord, id, error), in order.

    The queue is read row by row; it stays with the iterator and not in the driver's memory.
    """
    head = f"# Extractions to retry\n\nRoot: {root}\n\nAnswer with YAML: files, each with path, entity_type, summary, entities (name, type), relationships (subject, predicate, object).\n"
    return head + "".join(f"\n## {r['id']}\n\n{r['error']}\n" for r in failed.orderBy("ord").select("id", "error").toLocalIterator())
