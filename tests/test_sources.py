"""Files, stores, models and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import models
from quillmesh.schema import PAGE, conform
from quillmesh.sources import markdown, store
from quillmesh.streaming.reload import reload_stream

PAGE_TEXT = """---
id: alice
title: Alice Smith
entity-type: person
confidence: 0.95
tags:
  - team
  - 2024
entities:
  - name: Alice
    aliases: [Al, "A. Smith"]
    role: lead
relationships:
  - target: bob
    type: colleague
    strength: 0.9
temporal:
  valid-from: 2023-01-01
  decay-rate: 0.01
unknown: x
---
# Alice Smith

Body text.

## Related

- [[old]]
"""


def test_parse():
    page = markdown.parse(PAGE_TEXT)
    assert (page["id"], page["confidence"], page["tags"], page["temporal"]["valid_from"]) == ("alice", 0.95, ["team", "2024"], "2023-01-01")
    assert page["entities"] == [{"name": "Alice", "aliases": ["Al", "A. Smith"], "role": "lead"}] and page["body"].startswith("Body text.")
    again = markdown.parse(markdown.render(page))
    assert {k: v for k, v in again.items() if k != "body"} == {k: v for k, v in page.items() if k != "body"}
    assert "[[bob]] (type: colleague, strength: 0.9)" in again["body"] and "[[old]]" not in again["body"]
    assert markdown.replaced(page, markdown.replaced(page, PAGE_TEXT)) == markdown.replaced(page, PAGE_TEXT)
    stacked = markdown.prepended(page, markdown.prepended(page, "text"))
    assert markdown.replaced(page, stacked) == markdown.prepended(page, "text")


def test_parse_modes():
    with pytest.raises(ValueError):
        markdown.parse("no frontmatter")
    assert markdown.parse(" text \n", strict=False)["body"] == " text \n"
    with pytest.raises(ValueError):
        markdown.parse("---\nid: [a\n---\n", strict=False)
    with pytest.raises(ValueError):
        markdown.parse("---\nconfidence: high\n---\n")


def test_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".knowledge").mkdir()
    (tmp_path / "alice.md").write_text(PAGE_TEXT)
    (tmp_path / "sub" / "plain.md").write_text("# Plain\n#tag [[Alice Smith]]")
    (tmp_path / ".knowledge" / "hidden.md").write_text(PAGE_TEXT)
    (tmp_path / "note.txt").write_text("x")
    pages, warnings = markdown.load(spark, str(tmp_path))
    assert [r["id"] for r in pages.collect()] == ["alice"] and warnings.count() == 1
    pages, _ = markdown.load(spark, str(tmp_path), auto_enrich=True)
    plain = pages.where("title = 'Plain'").first()
    assert plain["id"] == "plain" and plain["tags"] == ["tag", "sub"] and plain["relationships"][0]["target"] == "alice-smith"
    with pytest.raises(ValueError):
        markdown.load(spark, str(tmp_path), ignore_errors=False)
    markdown.write_files(markdown.rendered(pages.where("id = 'alice'").withColumn("source_path", F.lit("a/b.md"))), str(tmp_path / "out"))
    assert markdown.parse((tmp_path / "out" / "a" / "b.md").read_text())["id"] == "alice"


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/kb")
    pages = conform(spark.createDataFrame([("a", "p"), ("b", "q")], "id string, source_path string"))
    files = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, text string")
    s.save_pages(pages, files)
    assert s.pages().count() == 2
    now = store.checksums(spark.createDataFrame([("p", "1!"), ("r", "3")], "path string, text string"))
    assert {tuple(r) for r in store.stale(now, s.checksums()).collect()} == {("p", "changed"), ("q", "removed"), ("r", "added")}
    store.write_checksums(s.checksums(), f"file://{tmp_path}/sums")
    assert store.read_checksums(spark, f"file://{tmp_path}/sums").exceptAll(s.checksums()).count() == 0
    texts = spark.createDataFrame([("a", "h1", "hello world"), ("b", "", "x")], "id string, content_hash string, text string")
    s.save_vectors(models.embedded(texts, models.HashEmbedder(8), "hash-8"))
    held = s.vectors("hash-8", 8)
    assert {r["id"] for r in store.pending(texts, held).collect()} == {"b"} and s.vectors("other", 8).count() == 0
    assert tuple(store.embed_status(texts, held).first()) == (2, 1, 1)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.vec").write_bytes(np.array([1, 2], "<f4").tobytes())
    (tmp_path / "v" / "b.vec").write_bytes(b"123")
    got = {r["path"][-5:]: (r["embedding"], bool(r["error"])) for r in store.read_vector_files(spark, f"{tmp_path}/v").collect()}
    assert got == {"a.vec": ([1.0, 2.0], False), "b.vec": (None, True)}


def test_vectors_are_replaced_and_models_change_whole(spark, tmp_path):
    kb = store.Store(spark, f"file://{tmp_path}/kb")
    rows = lambda *r: spark.createDataFrame(r, store.VECTORS)
    assert kb.model() is None and kb.vectors("m", 2).count() == 0
    kb.compact_vectors()
    kb.save_vectors(rows(("a", "h", "m", 2, [1.0, 2.0]), ("b", "h", "m", 2, [3.0, 4.0])))
    kb.save_vectors(rows(("a", "h", "m", 2, [0.5, 0.0]), ("a", "new", "m", 2, [9.0, 9.0]), ("x", "h", "other", 2, [7.0, 7.0])))
    want = {("a", "h"): [0.5, 0.0], ("b", "h"): [3.0, 4.0], ("a", "new"): [9.0, 9.0]}
    held = lambda: {(r["id"], r["content_hash"]): r["embedding"] for r in kb.vectors("m", 2).collect()}
    assert kb.model() == ("m", 2) and held() == want and kb.vectors("m", 2).count() == 3 and kb.vectors("other", 2).count() == 0
    kb.compact_vectors()
    assert held() == want and spark.read.parquet(f"file://{tmp_path}/kb/generations/2/vectors").count() == 3
    kb.save_vectors(rows(("b", "h", "m", 2, [0.0, 1.0])))
    assert held() == want | {("b", "h"): [0.0, 1.0]}
    # A change of model that has written all but its mark leaves the old model's vectors.
    spark.range(1).write.parquet(f"file://{tmp_path}/kb/generations/3/vectors")
    assert kb.model() == ("m", 2) and len(held()) == 3
    assert kb.ensure_model("n", 3) and kb.model() == ("n", 3) and kb.vectors("m", 2).count() == 0 and kb.vectors("n", 3).count() == 0
    assert kb.ensure_model("o", 3) and len(kb._generations()) == 2


def test_embedding_errors_stay_in_their_batch(spark):
    def fails(texts):
        raise models.ModelError("no", 401)

    texts = spark.createDataFrame([("a", "h", "t")], "id string, content_hash string, text string")
    assert models.embedded(texts, fails, "m").first()["error"] == "auth: no"


GOOD = '{"entities": [{"name": "Ann", "type": ["PERSON"]}], "relationships": [{"subject": "Ann", "predicate": "knows", "object": "ANN"}]}'


@pytest.mark.parametrize("text", [
    GOOD, f"```json\n{GOOD}\n```", GOOD[:-1], GOOD.replace('"entities":', '"entities"'), GOOD.replace('"relationships": [', '"relationships ['), GOOD.replace('"name": "', '"name:"'), GOOD.replace('"}], "rel', '"}}, "rel'), GOOD.replace('], "relationships"', ']}, {"relationships"'),
])
def test_repair(text):
    got = models.parse_extraction(text)
    assert got["entities"] == [{"name": "Ann", "role": "PERSON"}] and got["relationships"] == [{"target": "Ann", "type": "knows", "strength": 0.7}] and got["entity_type"] == "person"


def test_whole_json_is_left_alone():
    text = '{"a": "}, {\\" [", "entities": []}'
    assert models.repaired(text) == text
    with pytest.raises(models.ParseError):
        models.parse_extraction("no answer")


def test_votes():
    assert models.most_frequent(["TECHNOLOGY", "ORGANIZATION", "PERSON"]) == "person" and models.most_frequent(["zed", "abc"]) == "abc" and models.most_frequent([]) == ""


def test_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    page = conform(spark.createDataFrame([("a", "one"), ("b", "two")], "id string, title string"))
    page.write.parquet(source)
    target, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    reload_stream(spark, source, PAGE, target, check).awaitTermination()
    page.where("id = 'a'").withColumn("title", F.lit("new")).write.mode("append").parquet(source)
    reload_stream(spark, source, PAGE, target, check).awaitTermination()
    assert {(r["id"], r["title"]) for r in spark.read.parquet(f"{target}/v1").collect()} == {("a", "new"), ("b", "two")}
    # Of the rows of one id in a batch the last of the file stays.
    conform(spark.createDataFrame([("b", "z"), ("b", "y"), ("c", "three")], "id string, title string")).coalesce(1).write.mode("append").parquet(source)
    reload_stream(spark, source, PAGE, target, check).awaitTermination()
    held = spark.read.parquet(f"{target}/v2")
    assert {(r["id"], r["title"]) for r in held.collect()} == {("a", "new"), ("b", "y"), ("c", "three")} and set(held.columns) == set(page.columns)


def test_yaml_by_libyaml_reads_and_refuses_the_same():
    import yaml

    good = 'id: a\ntitle: "é \\u2026 😀"\ntags: [x, 1, yes]\ntemporal:\n  last-verified: 2024-01-31\nsummary: |\n  two\n  lines\n'
    assert markdown._FAST is yaml.CBaseLoader and markdown.load_yaml(good) == yaml.load(good, Loader=yaml.BaseLoader)
    with pytest.raises(ValueError, match="cannot read the frontmatter"):
        markdown.load_yaml("a: [1")


def test_yaml_nodes_are_built_as_the_loader_builds_them():
    import yaml

    for text in ("a: &x [1, {b: c}]\nd: *x\n<<: {e: f}\na: again\n", "", "~", "- !t x\n- ''\n- 'null'\n", "{a: {b: {}}, ? b : }"):
        assert markdown.load_yaml(text) == yaml.load(text, Loader=yaml.BaseLoader)
    for text in ("&a [*a]", "? [k]\n: v\n", "a: 1\n---\nb: 2\n"):
        with pytest.raises(ValueError, match="cannot read the frontmatter"):
            markdown.load_yaml(text)


def test_pages_of_a_small_file_are_dealt_over_the_cores(spark, tmp_path):
    from quillmesh.plans import datasets

    spark.range(400).selectExpr("id AS p_partkey", "'a b' AS p_name", "'B' AS p_brand", "'T' AS p_type", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for pages in (datasets.parts(spark, str(tmp_path)), datasets.notes(spark, str(tmp_path))):
        assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and pages.count() == 400
