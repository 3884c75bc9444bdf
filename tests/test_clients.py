"""HTTP clients against a local stub server, and what is brought from elsewhere."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillmesh.engine import Engine, Settings, ignore_store
from quillmesh.operators import handoff, models, search
from quillmesh.sources import clients, markdown, store


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.seen.append((self.path, self.headers.get("Authorization"), body))
        status, answer = 200, {}
        if self.path.startswith("/bad"):
            status, answer = {"/bad401": 401, "/bad503": 503, "/bad404": 404}[self.path.split("/v1")[0]], {"error": "no"}
        elif self.path.endswith("/embeddings"):
            answer = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]}
            if "short" in body["model"]:
                answer["data"].pop()
        elif self.path.endswith("/rerank"):
            answer = {"results": [{"index": i, "relevance_score": len(d)} for i, d in enumerate(body["documents"])] + [{"index": 99, "relevance_score": 9}]}
        elif "response_format" in body and self.path.startswith("/plain"):
            status, answer = 400, {"error": "response_format is not supported"}
        else:
            answer = {"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]} if "none" not in body["model"] else {"choices": []}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_embedding_client(server):
    embed = clients.EmbeddingClient(server + "/", model="m", key="k", token="t", batch=2)
    Stub.seen.clear()
    assert embed(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
    assert [(p, a, len(b["input"])) for p, a, b in Stub.seen] == [("/v1/embeddings", "Bearer k", 2), ("/v1/embeddings", "Bearer k", 1)]
    assert embed([]) == []
    with pytest.raises(models.ModelError):
        clients.EmbeddingClient(server, model="short")(["a"])
    for status, kind in ((401, "auth"), (503, "server"), (404, "request")):
        with pytest.raises(models.ModelError) as e:
            clients.EmbeddingClient(f"{server}/bad{status}")(["a"])
        assert e.value.kind == kind


def test_embedding_client_in_tasks(spark, server):
    texts = spark.createDataFrame([("a", "h", "xx"), ("b", "h", "yyy")], "id string, content_hash string, text string")
    got = {r["id"]: list(r["embedding"]) for r in models.embedded(texts, clients.EmbeddingClient(server, model="m"), "m").collect()}
    assert got == {"a": [2.0, 1.0], "b": [3.0, 1.0]}


def test_rerank_client(server):
    rerank = clients.RerankClient(server, token="t", limit=2)
    assert rerank("q", ["a", "b", "c"], ["xx", "x", "xx"], [1, 1, 1]) == [(0, 2.0), (2, 2.0)]
    assert rerank("q", [], [], []) == [] and Stub.seen[-1][1] == "Bearer t"


def test_search_survives_its_reranker(spark, server):
    pages = spark.createDataFrame([("a", "alpha", 1), ("b", "alpha beta", 2)], "id string, title string, n int")
    from quillmesh.schema import conform

    found = search.search(conform(pages), "alpha", F.lit("2026-01-01").cast("timestamp"), reranker=clients.RerankClient(f"{server}/bad503"))
    assert [(r["id"], len(r["matches"])) for r in found.collect()] == [("a", 1), ("b", 1)]


def test_chat_clients(server):
    chat = clients.ChatClient(server, model="m", extra={"model": "other", "top_k": 3})
    assert chat("be brief", "hello") == "HELLO"
    assert Stub.seen[-1][2] == {"model": "m", "top_k": 3, "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}]}
    with pytest.raises(models.ModelError):
        clients.ChatClient(server, model="none")("", "x")
    for where, asked in (("/plain", [True, False, False]), ("", [True, True])):
        schema = clients.SchemaChat(clients.ChatClient(server + where, model="m"), {"type": "object"})
        Stub.seen.clear()
        assert schema("", "a") == "A" and schema("", "b") == "B"
        assert ["response_format" in b for _, _, b in Stub.seen] == asked


def test_two_calls_and_shapes(spark):
    answers = {"entities": '{"entities": [{"name": "Ann", "type": "PERSON"}]}', "relationships": '```json\n{"relationships": [{"subject": "Ann", "predicate": "knows", "object": "ANN"}]}\n```'}
    two = clients.TwoCalls(lambda prompt, text: answers[prompt.split("\n")[-1]])
    docs = spark.createDataFrame([("d", "text")], "id string, body string")
    row = models.extracted(docs, two, "extract").first()
    assert (row["status"], row["entity_type"], row["relationships"][0]["target"]) == ("ok", "person", "Ann")
    triples = '{"entities_and_triples": ["[1], PERSON:Ann", "[2], ORG: Acme", "[3], ORG:Bay", "(1, WORKS_FOR, 2)", "(1, AT, 9)", "(1, X)"]}'
    row = models.extracted(docs, lambda p, t: triples, shape="triples").first()
    assert row["entity_type"] == "org" and [(r["target"], r["type"], r["strength"]) for r in row["relationships"]] == [("Acme", "WORKS_FOR", 0.8)]
    generic = '{"entity_type": "Concept", "summary": "s", "entities": [{"name": "N", "role": "r"}], "relationships": [{"target": "t", "type": "k", "strength": 0.4}]}'
    row = models.extracted(docs, lambda p, t: generic, shape="generic").first()
    assert (row["entity_type"], row["summary"], row["relationships"][0]["strength"]) == ("concept", "s", 0.4)


def test_endpoints():
    assert [clients.is_local(x) for x in ("", "localhost:11434", "http://127.0.0.1:80/x", "[::1]:5", "https://api.example.com")] == [True, True, True, True, False]
    assert [clients.transport(x) for x in ("http://10.1.2.3:8000", "box.lan", "http://[::1]/v1", "https://api.example.com", "")] == ["manual", "manual", "manual", "native", "native"]
    assert clients.normalised_endpoint(" HTTPS://API.Example.com:443/V1/?q=1#f") == "https://api.example.com/V1" and clients.normalised_endpoint("Host:1/") == "host:1"
    assert (clients.fallback_cap("localhost"), clients.fallback_cap("https://x.org"), clients.fallback_cap("https://x.org", 7)) == (0, 50, 7)
    assert clients.rejects_schema(models.ModelError("status 400: bad json_schema")) and not clients.rejects_schema(models.ModelError("status 400: no such model"))
    assert models.is_two_part_model("org/NuExtract-2.0-8B") and not models.is_two_part_model("nuextract-2.0")
    assert clients.looks_like_path("a/b") and not clients.looks_like_path("alice")


RESULT = """```yaml
files:
  - path: a.md
    entity_type: PERSON
    summary: all about a
    entities: [{name: Zoe, type: PERSON}, {name: " "}]
    relationships: [{subject: a, predicate: knows, object: ZOE}, {subject: a, object: x}]
  - path: gone.md
  - summary: nowhere
```"""


def test_results_from_elsewhere(spark):
    files = spark.createDataFrame([("a.md", "---\nid: a\ntitle: A\nentity-type: document\n---\n\n# A\n\nbody\n"), ("b.md", "b")], "path string, text string")
    got = {r["ord"]: r for r in handoff.apply_results(files, handoff.parse_results(spark, RESULT)).collect()}
    assert [(got[i]["applied"], got[i]["error"]) for i in range(3)] == [(True, ""), (False, "the file is not there"), (False, "the entry has no path")]
    page = markdown.parse(got[0]["text"])
    assert (page["entity_type"], page["summary"], page["body"]) == ("person", "all about a", "body")
    assert [(r["target"], r["type"]) for r in page["semantic_relationships"]] == [("Zoe", "knows")] and [e["name"] for e in page["entities"]] == ["Zoe"]
    for bad in ("", "``` \n```", "files: []", "x: 1", "a: [", "- 1"):
        with pytest.raises(ValueError):
            handoff.parse_results(spark, bad)


def test_only_changed_files_are_read_again(spark, tmp_path):
    root, kb = tmp_path / "kb", store.Store(spark, f"file://{tmp_path}/store")
    root.mkdir()
    write = lambda name, title: (root / f"{name}.md").write_text(f"---\nid: {name}\ntitle: {title}\nentity-type: concept\nconfidence: 1\n---\nbody\n")
    for name in "abc":
        write(name, name)
    titles = lambda pages: sorted((r["id"], r["title"]) for r in pages.select("id", "title").collect())
    assert titles(kb.load(str(root))[0]) == [("a", "a"), ("b", "b"), ("c", "c")]
    write("b", "new")
    write("d", "d")
    (root / "c.md").unlink()
    assert titles(kb.load(str(root))[0]) == [("a", "a"), ("b", "new"), ("d", "d")]
    assert titles(kb.load(str(root))[0]) == [("a", "a"), ("b", "new"), ("d", "d")]
    (root / "e.md").write_text("# Only text\n\nwith #tag\n")
    files = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in markdown.enriched_files(spark, str(root)).collect()}
    assert set(files) == {"e.md"} and markdown.parse(files["e.md"])["tags"] == ["tag"] and files["e.md"].endswith("# Only text\n\nwith #tag\n")


def test_vectors_of_another_model_go(spark, tmp_path):
    kb = store.Store(spark, f"file://{tmp_path}/s")
    vectors = spark.createDataFrame([("a", "h", "m", 2, [1.0, 2.0])], store.VECTORS)
    assert not kb.ensure_model("m", 2) and kb.model() == ("m", 2)
    kb.save_vectors(vectors)
    assert not kb.ensure_model("m", 2) and kb.vectors("m", 2).count() == 1
    assert kb.ensure_model("n", 3) and kb.model() == ("n", 3)
    store.write_vector_files(vectors, str(tmp_path / "v"))
    read = store.read_vector_files(spark, str(tmp_path / "v")).first()
    assert read["path"].endswith(store.vector_file_name("a", "h")) and list(read["embedding"]) == [1.0, 2.0]


def test_settings_of_files(tmp_path):
    a, b = tmp_path / "a.yaml", tmp_path / "b.yaml"
    a.write_text("depth: 3\nembedding-model: m\nentity-types: [x, y]\n")
    b.write_text("depth: 0\nparallel: true\n")
    got = Settings.of_files(str(a), str(b), str(tmp_path / "none"), environment={"QUILLMESH_RERANK_TOP_N": "5"})
    assert (got.depth, got.embedding_model, got.entity_types, got.parallel, got.rerank_top_n) == (3, "m", ("x", "y"), True, 5)
    got.save(str(tmp_path / "c.yaml"))
    assert Settings.of_files(str(tmp_path / "c.yaml"), environment={}) == got
    for _ in range(2):
        ignore_store(str(tmp_path))
    assert (tmp_path / ".gitignore").read_text() == f"{markdown.PRUNED}/\n"


def test_files_read_one_by_one(spark, tmp_path):
    path = tmp_path / "a.md"
    path.write_text("---\nid: a\ntitle: A\n---\nbody\n")
    assert markdown.read_file(str(path))["source_path"] == str(path)
    with open(path) as f:
        assert markdown.read(f)["id"] == "a"
    assert "title: A" in markdown.dry_run(markdown.parsed(spark.createDataFrame([(str(path), path.read_text())], "path string, text string"))).first()["text"]


def test_embedding_and_enriching_a_folder(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.md").write_text("---\nid: a\ntitle: A\nentity-type: concept\nconfidence: 1\n---\nbody of a\n")
    (root / "b.md").write_text("---\ntitle: B\n---\nbody #tag\n")
    engine, kb = Engine.open(spark, str(root)), store.Store(spark, f"file://{tmp_path}/store")
    assert sorted((r["id"], r["error"]) for r in engine.embed_all(kb).collect()) == [("a", ""), ("b", "")]
    assert engine.embed_all(kb).count() == 0 and kb.vectors("hash-64", 64).count() == 2
    found = engine.enrich()
    assert engine.enrich_totals(found).first().asDict() == {"enriched": 1, "skipped": 1, "recovered": 0, "failed": 0}
    markdown.write_files(engine.enriched_files(found), "/")
    page = markdown.read_file(str(root / "b.md"))
    assert (page["id"], page["entity_type"], list(page["tags"])) == ("b", "document", ["tag"]) and "body of a" in (root / "a.md").read_text()
