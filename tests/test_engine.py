"""The engine's tools over a small knowledge base on disk."""

import json

import pytest
from pyspark.sql import functions as F

from quillmesh.engine import Engine, Settings, scaffold
from quillmesh.operators import format as fmt
from quillmesh.operators import models, validation


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    scaffold(str(root))
    (root / "notes").mkdir()
    (root / "notes" / "raw.md").write_text("# Raw note\n#idea see [[First topic]]")
    return Engine.open(spark, str(root))


def test_tools(engine):
    now = F.lit("2026-06-01").cast("timestamp")
    assert {r["id"] for r in engine.graph.pages.collect()} == {"welcome", "first-topic", "raw"}
    assert engine.search("welcome", now=now).first()["id"] == "welcome"
    assert {r["id"] for r in engine.traverse("welcome")[0].collect()} == {"welcome", "first-topic"}
    assert engine.get_page("raw").first()["tags"] == ["idea", "notes"]
    assert tuple(engine.check().first())[:3] == (3, 0, 0) and engine.check().first()["dangling"] == 0
    assert engine.get_structure(entity_type="concept")[0].first()["pages"] == 1
    assert engine.reload().graph.pages.count() == 3


def test_embeddings(engine):
    vectors = engine.embed_pending()
    assert vectors.count() == 3 and engine.embed_status().first()["pending"] == 3
    full = Engine(engine.spark, engine.graph.pages.drop("id_derived"), settings=engine.settings, vectors=vectors)
    assert full.embed_status().first()["pending"] == 0
    assert full.search("about welcome", semantic=True).count() >= 1
    assert full.embed_file("raw").first()["dims"] == 64


def answer(prompt, body):
    if "raw" in body.lower():
        return "broken"
    return '{"summary": "s", "entity_type": "concept", "entities": [{"name": "N", "type": "CONCEPT"}], "relationships": [{"predicate": "p", "object": "n"}]}'


def test_enrich(engine):
    got = {r["id"]: r for r in engine.enrich(chat=answer, fallback=lambda p, b: answer(p, "")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"welcome": "enriched", "first-topic": "enriched", "raw": "recovered"}
    assert got["raw"]["semantic_relationships"][0]["target"] == "N" and got["raw"]["summary"] == "s"
    got = {r["id"]: r["status"] for r in engine.enrich(chat=answer).collect()}
    assert got["raw"] == "failed"
    assert {r["status"] for r in engine.enrich().collect()} == {"skipped"}


def test_export_to_a_stream(engine):
    import io

    out = io.StringIO()
    assert engine.export_to(out, body=True) == 3
    rows = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [r["id"] for r in rows] == ["first-topic", "raw", "welcome"] and all("body" in r for r in rows)
    out = io.StringIO()
    engine.export_to(out)
    assert not any("body" in json.loads(line) for line in out.getvalue().splitlines())


def test_reason(engine):
    got = engine.reason("raw?", lambda p, b: '```json\n{"pages": ["raw", "nope", "welcome"]}\n```')
    assert [r["id"] for r in got.collect()] == ["raw", "welcome"]
    assert engine.reason("raw?", lambda p, b: "no", max_pages=1).count() == 0


def test_formats(engine, spark):
    now = F.lit("2026-06-01").cast("timestamp")
    row = fmt.results(engine.search("welcome", now=now)).first()
    assert row["text"].startswith("1. Welcome (document)  [score: 7.") and json.loads(row["json"])["matches"][0]["field"] == "title"
    assert "Confidence:  1.00" in fmt.pages(engine.get_page("welcome")).first()["text"]
    texts = {r["text"] for r in fmt.traversal(engine.traverse("welcome")[0], engine.graph.pages).collect()}
    assert texts == {"Welcome (document)", "  - First topic (concept)"}
    stats = spark.createDataFrame([(1, 2, 3, ["a", "b"])], "pages long, entities long, relationships long, tags array<string>")
    assert fmt.stats(stats).first()["text"].endswith("Tags:          a, b")
    bad = validation.validated(engine.graph.pages.withColumn("title", F.lit("")))
    assert "- title: the page has no title" in fmt.issues(bad).first()["text"]
    assert "## raw" in fmt.retry_brief(spark.createDataFrame([(1, "raw", "bad")], "ord int, id string, error string"), "/kb")


def test_settings():
    got = Settings.cascade({"depth": 3, "entity_types": ["a"], "parallel": True}, {"depth": 0, "entity_types": []}, environment={"QUILLMESH_EMBEDDING_WEIGHT": "0.5"})
    assert (got.depth, got.entity_types, got.parallel, got.embedding_weight) == (3, (), True, 0.5)


def test_error_kinds():
    assert [models.ModelError("x", s).kind for s in (401, 403, 500, 404)] == ["auth", "auth", "server", "request"]
    assert models.top_n([(0, 0.1), (1, 0.9), (2, 0.9)], 2) == [(1, 0.9), (2, 0.9)] and len(models.top_n([(0, 1.0)], 0)) == 1
