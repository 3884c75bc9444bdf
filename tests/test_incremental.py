"""Updates of a stored graph against a rebuild."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.text import reconcile_key
from quillmesh.operators.graph import KnowledgeGraph, resolved
from quillmesh.operators.incremental import GraphTables
from quillmesh.schema import PAGE, conform
from quillmesh.sources.shared import written
from quillmesh.sources.versions import Versions


def frame(spark, rows):
    return conform(spark.read.schema(PAGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 2)))


def page(r, path):
    """Few names, so that pages fight for ids, slugs and aliases."""
    name = lambda: r.choice(["Ann", "Bob", "Old Town", "untitled", "日", "a b", "a-b"])
    edges = [{"target": r.choice([name(), "nobody", "a-b-01", "untitled"]), "type": "t", "strength": 0.5} for _ in range(r.randint(0, 3))]
    out = {"source_path": path, "title": name(), "relationships": edges, "semantic_relationships": edges[:1], "entities": [{"name": name(), "aliases": [name()], "role": ""}], "body": str(r.random())}
    return out | ({"id": r.choice(["ann", "a-b", "x", f"y{r.randint(0, 9)}"])} if r.random() < 0.3 else {})


def told(graph):
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    return rows(graph.pages, "source_path", "id", "id_derived", "title"), rows(graph.claims, "key", "page_id"), rows(graph.declared, "src", "written", "target", "type", "strength", "semantic", "resolved", "ord"), rows(graph.edges, "src", "target", "type", "strength", "semantic", "resolved", "ord")


def test_updates_are_rebuilds(spark, tmp_path):
    r = random.Random(8)
    paths = [f"/kb/{d}/{n}.{e}" for d in ("a", "b") for n in ("ann", "Bob", "日", "語", "a b", "a-b") for e in ("md", "txt")]
    held = {p: page(r, p) for p in paths[:18]}
    tables = GraphTables(spark, str(tmp_path / "graph"), "/kb")
    tables.build(frame(spark, held.values()))
    for step in range(3):
        changed = {p: page(r, p) for p in r.sample(paths, 3)}
        removed = r.sample(sorted(set(held) - set(changed)), 2) if step != 1 else []
        got = told(tables.update(frame(spark, changed.values()), spark.createDataFrame([(p,) for p in [*removed, "/kb/never.md", None]], "source_path string")))
        held = {p: v for p, v in (held | changed).items() if p not in removed}
        assert got == told(KnowledgeGraph.build(frame(spark, held.values()), "/kb"))
    before = tables.versions.current()
    assert told(tables.update(frame(spark, []))) == got and tables.versions.current() == before
    assert len(tables.versions.numbers()) == 2  # older versions are gone


def test_ids_without_a_slug(spark, tmp_path):
    """An id that has no key of its own is found by its text only, and lost with its page."""
    held = {"/kb/a.md": {"source_path": "/kb/a.md", "id": "a", "title": "A", "relationships": [{"target": t, "type": "t", "strength": 0.5} for t in ("日", "語", "a", "B")]}, "/kb/c.md": {"source_path": "/kb/c.md", "id": "c", "title": "C"}}
    tables = GraphTables(spark, str(tmp_path / "graph"), "/kb")
    tables.build(frame(spark, held.values()))
    added = {"/kb/b.md": {"source_path": "/kb/b.md", "id": "日", "title": "語"}}
    for changed, removed in ((added, []), ({}, ["/kb/b.md"]), (added, ["/kb/a.md"])):
        got = told(tables.update(frame(spark, changed.values()), spark.createDataFrame([(p,) for p in removed], "source_path string")))
        held = {p: v for p, v in (held | changed).items() if p not in removed}
        assert got == told(KnowledgeGraph.build(frame(spark, held.values()), "/kb"))


def test_a_popular_target_is_resolved_once(spark):
    """Edges are not dealt by their target, of which many have the same: they meet the few texts, resolved before."""
    many = spark.range(1_000_000).select(F.concat(F.lit("page-"), "id").alias("id"))
    edges = written(spark.range(1000).select(F.col("id").cast("string").alias("src"), F.concat(F.when(F.col("id") % 50 == 0, "nobody-").otherwise("Page "), (F.col("id") % 2).cast("string")).alias("written")).withColumn("key", reconcile_key(F.col("written"))))
    got = resolved(edges, many, many.select(F.col("id").alias("key"), F.col("id").alias("page_id")))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.groupBy("written", "target", "resolved").count().collect()} == {("Page 0", "page-0", True, 480), ("Page 1", "page-1", True, 500), ("nobody-0", "nobody-0", False, 20)}


def test_versions(spark, tmp_path):
    """A version that fails on the way leaves the one before to read."""
    held = Versions(spark, str(tmp_path / "v"), ("a", "b"))
    with pytest.raises(FileNotFoundError):
        held.read()
    one = spark.range(3)
    assert held.write({"a": one, "b": one}) == 1
    bad = one.selectExpr("raise_error('no') AS id")
    with pytest.raises(Exception):  # noqa: B017
        held.write({"a": one.where("id = 0"), "b": bad})
    assert held.current() == 1 and held.read()["a"].count() == 3
    assert held.write({"a": one.limit(1), "b": one}) == 3 and held.read()["a"].count() == 1 and held.numbers() == [1, 3]
