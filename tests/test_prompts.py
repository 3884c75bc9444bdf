"""Prompts of all shapes, summaries, and calls in flight."""

import json
import threading
import time

import pytest

from quillmesh.engine import Engine, Settings, scaffold
from quillmesh.operators import models, prompts


def test_prompts():
    prompt, message = prompts.extraction("generic", ["person", "tool"])
    assert "person, tool" in prompt and "related-to, derived-from" in prompt and message("b{}") == "b{}"
    prompt, message = prompts.extraction("triples", ["PERSON"], ["uses"])
    told = message("the {body}")
    assert prompt == "" and told.startswith("Perform Named Entity Recognition (NER)") and '{"entity_types":["PERSON"]}' in told and '{"predicates":["uses"]}' in told and told.endswith("**Text:**\nthe {body}")
    prompt, message = prompts.extraction("spo", ["PERSON"], ["uses"])
    form = message("B").split("\n")[1]
    assert prompt == "" and json.loads(form) == {"entities": [{"name": "verbatim-string", "type": ["PERSON"]}], "relationships": [{"subject": "verbatim-string", "predicate": ["uses"], "object": "verbatim-string"}]} and message("B").endswith("\nB")
    assert set(json.loads(prompts.template(["a"], ["b"], ["entities"]))) == {"entities"}
    assert "Tags: (none)" in prompts.summary("T", "tool", [], "body") and "Tags: a, b" in prompts.summary("T", "tool", ["a", "b"], "body")
    with pytest.raises(ValueError):
        prompts.extraction("other", [])


def test_shapes():
    assert models.shape_for() == "generic" and models.shape_for("x/NuExtract-2.0-4B") == "spo"
    assert models.shape_for("m", "http://a", "", "http://a") == "triples" and models.shape_for("m", "http://a", "spo", "http://a") == "spo"
    with pytest.raises(ValueError):
        models.shape_for(wanted="yaml")


def test_calls_in_order():
    lock, now, most = threading.Lock(), [0], [0]

    def slow(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01 * (x % 3))
        with lock:
            now[0] -= 1
        return x * x

    assert models.called(slow, range(40), 5) == [x * x for x in range(40)] and 1 < most[0] <= 5
    most[0] = 0
    assert models.called(slow, range(5), 1) == [0, 1, 4, 9, 16] and most[0] == 1


@pytest.mark.parametrize("workers", [0, 1, 3, 100])
def test_pool_gives_what_single_calls_give(spark, workers):
    docs = spark.createDataFrame([(f"p{i}", f"body {i}") for i in range(60)], "id string, body string")

    def chat(prompt, text):
        i = int(text.split()[-1])
        if i % 7 == 0:
            raise models.ModelError("no", 500)
        return "broken" if i % 5 == 0 else json.dumps({"entity_type": "Tool", "entities": [{"name": f"n{i}", "role": "r", "aliases": ["x"]}], "semantic_hints": ["h"]})

    got = {r["id"]: r for r in models.extracted(docs, chat, "p", "generic", workers=workers).collect()}
    assert len(got) == 60
    for i in range(60):
        assert got[f"p{i}"]["status"] == ("model-error" if i % 7 == 0 else "parse-error" if i % 5 == 0 else "ok")
    assert got["p1"]["entities"][0].asDict() == {"name": "n1", "role": "r", "aliases": ["x"]} and got["p1"]["semantic_hints"] == ["h"] and got["p7"]["entities"] == []
    spread, each = models.in_flight(docs, workers)
    if workers:
        assert spread.rdd.getNumPartitions() * each <= workers


def test_enrichment_asks_in_the_settings_shape(spark, tmp_path):
    scaffold(str(tmp_path))
    (tmp_path / "bad.md").write_text("# Bad\nno summary comes")
    triples = json.dumps({"entities_and_triples": ["[1], TOOL:Drill", "[2], PERSON:Ann", "(1, used-by, 2)"]})

    def chat(prompt, text):
        if prompt == prompts.SUMMARY_PROMPT:
            if "Title: Bad" in text:
                raise models.ModelError("no")
            return ' "A page." \n'
        return triples if prompt == "" and "**Entity Types:**" in text else "not asked for triples"

    engine = Engine.open(spark, str(tmp_path), settings=Settings(root=str(tmp_path), chat_endpoint="http://t", triples_endpoint="http://t", parallel=True))
    got = {r["id"]: r for r in engine.enrich(force=True, chat=chat).collect()}
    assert {r["status"] for r in got.values()} == {"enriched"} and got["welcome"]["summary"] == "A page."
    assert got["bad"]["summary"] == "" and [r["type"] for r in got["bad"]["semantic_relationships"]] == ["used-by"]
    assert Settings.cascade({"predicates": "a,b", "parallel_workers": "3"}, environment={}).predicates == ("a", "b")
