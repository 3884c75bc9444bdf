"""Identity, resolution, traversal, search and merges on small pages."""

import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import enrich, search, traverse, validation
from quillmesh.operators.graph import KnowledgeGraph, common_items, postings, with_ids
from quillmesh.operators.models import overlap_reranker
from quillmesh.schema import PAGE, conform

NOW = "2026-06-01"


def pages(spark, *rows):
    return conform(spark.read.schema(PAGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])))


def rel(target, kind="t", strength=0.5):
    return {"target": target, "type": kind, "strength": strength}


@pytest.fixture(scope="module")
def graph(spark):
    return KnowledgeGraph.build(pages(
        spark,
        {"id": "a", "title": "Alpha", "entity_type": "person", "confidence": 0.9, "tags": ["x", "y"], "relationships": [rel("b", "knows"), rel("b", "knows"), rel("Gamma Ray", "uses"), rel("nowhere")], "entities": [{"name": "Al", "aliases": ["The A"], "role": "r"}], "body": "works on rings", "semantic_relationships": [rel("the a", "self"), rel("")]},
        {"id": "b", "title": "Beta", "entity_type": "concept", "tags": ["x"], "relationships": [rel("c", "knows"), rel("a", "back", 0.1), rel("a", "again", 0.2)], "confidence": 0.5, "temporal": {"last_verified": "2026-05-02", "decay_rate": 0.01}},
        {"id": "c", "title": "Gamma Ray", "entity_type": "concept", "relationships": [rel("d")], "confidence": 0.0},
        {"id": "d", "title": "Delta", "relationships": [rel("a")]}, {"id": "日", "title": "日本", "relationships": [rel("日")]},
    ))


def test_ids(spark):
    rows = [{"id": "docs-api", "source_path": "/kb/x.md"}, {"source_path": "/kb/docs/api.md"}, {"source_path": "/kb/docs/API.txt"}, {"source_path": "/other/z.md"}, {"title": "Just Title"}, {"source_path": "/kb/日.md"}]
    got = {r["source_path"] or r["title"]: r["id"] for r in with_ids(pages(spark, *rows), "/kb").collect()}
    assert got["/kb/x.md"] == "docs-api" and got["/other/z.md"] == "z" and got["Just Title"] == "just-title" and got["/kb/日.md"] == "untitled"
    assert got["/kb/docs/api.md"].startswith("docs-api-") and got["/kb/docs/API.txt"].startswith("docs-api-") and len(set(got.values())) == 6


def test_ids_do_not_depend_on_order(spark):
    rows = [{"source_path": p} for p in ("/kb/a.md", "/kb/a.txt", "/kb/A.md")]
    one, two = ({(r["source_path"], r["id"]) for r in with_ids(pages(spark, *x), "/kb").collect()} for x in (rows, rows[::-1]))
    assert one == two


def test_resolution(graph):
    got = {(r["src"], r["written"], r["type"]): (r["target"], r["resolved"]) for r in graph.declared.collect()}
    assert got["a", "Gamma Ray", "uses"] == ("c", True) and got["a", "nowhere", "t"] == ("nowhere", False) and got["a", "the a", "self"] == ("a", True)
    assert got["日", "日", "t"] == ("日", False)  # no key names it
    assert graph.edges.where("src = 'a'").count() == 4 and graph.dangling.count() == 2
    assert graph.semantic_stats().first().asDict() == {"total": 1, "resolved": 1}
    assert [tuple(r) for r in graph.stats().collect()] == [(5, 1, 10, 2)]


def test_summary(graph):
    row = graph.summary_stats(entity_type="person").first()
    assert (row["pages"], row["relationships"], row["semantic_edges"], row["semantic_edges_resolved"], row["dangling_target_names"], row["tags"]) == (1, 4, 2, 1, ["nowhere"], ["x", "y"])
    assert graph.summary_stats(page_ids=[]).first()["pages"] == 5  # an empty list is no filter
    assert [r["id"] for r in graph.filtered(max_pages=2).collect()] == ["a", "b"]
    node = graph.summary_nodes(temporal=True, page_ids=["b"]).first()
    assert node["last_verified"] == "2026-05-02" and [r["target"] for r in node["relationships"]] == ["c", "a", "a"]
    assert graph.lookup("c").first()["title"] == "Gamma Ray" and json.loads(graph.export().first()["json"])["id"] == "a"


def test_breadth_first(graph):
    nodes, edges = traverse.breadth_first(graph, "a", 2)
    assert {tuple(r) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert edges.count() == 4 + 3 + 1
    nodes, edges = traverse.breadth_first(graph, "a", 1, "reverse")
    assert {tuple(r) for r in nodes.collect()} == {("a", 0), ("b", 1), ("d", 1)}
    assert sorted(r["type"] for r in edges.where("edge_from = 'b'").collect()) == ["back", "back"]  # the first edge, once for each
    assert traverse.breadth_first(graph, "a", 1, "reverse", ["again"])[0].count() == 1
    assert traverse.max_depth(nodes).first()["max_depth"] == 1
    with pytest.raises(KeyError):
        traverse.breadth_first(graph, "nobody")


def wide(spark, n=140):
    """A graph with branches, cycles, edges to nothing and a hub."""
    import random

    r = random.Random(4)
    rows = [{"id": f"p{i}", "title": f"P{i}", "relationships": [rel(f"p{r.choice([0, r.randrange(n)])}", r.choice("tu")) for _ in range(r.randint(0, 3))] + [rel("nothing")] * (i % 9 == 0)} for i in range(n)]
    return KnowledgeGraph.build(pages(spark, *rows))


@pytest.mark.parametrize(("direction", "types"), [("forward", None), ("both", ["t"]), ("reverse", None)])
def test_many_roots_are_single_ones_at_once(spark, direction, types):
    g = wide(spark)
    asked = [f"p{i}" for i in range(0, 140, 2)]  # more than a word
    roots = spark.createDataFrame([(i,) for i in [*asked, "p0", "no page", None]], "id string").repartition(3)
    nodes, edges = traverse.breadth_first_many(g, roots, 3, direction, types)
    got = {i: (set(), []) for i in asked}
    for r in nodes.collect():
        got[r["root"]][0].add((r["id"], r["depth"]))
    for r in edges.collect():
        got[r["root"]][1].append(tuple(r)[1:])
    assert nodes.count() == sum(len(a) for a, _ in got.values())
    steps = [tuple(r) for r in traverse.oriented(g, direction, types).select("node", "visit", "edge_from", "edge_to", "type", "strength").collect()]
    ids = {r["id"] for r in g.pages.select("id").collect()}
    for root, (ns, es) in got.items():
        depth, front = {root: 0}, [root]
        for d in range(1, 4):
            front = list({v for n, v, *_ in steps if n in front and v in ids and v not in depth})
            depth |= dict.fromkeys(front, d)
        assert ns == set(depth.items())
        assert sorted(es) == sorted(tuple(e[2:]) for e in steps if depth.get(e[0], 3) < 3)


def test_no_roots(spark, graph):
    nodes, edges = traverse.breadth_first_many(graph, graph.pages.where("id = 'nobody'"))
    assert nodes.count() == 0 and edges.count() == 0


def test_ids_under_a_hot_slug(spark):
    """Pages whose names have no letter that a slug keeps: all have one slug, and equal paths one hash."""
    import hashlib

    rows = [{"source_path": f"/kb/{chr(0x4E00 + i)}.md", "title": f"t{i}"} for i in range(150)] + [{"source_path": "/kb/語.md", "title": f"{i % 40:02}"} for i in range(120)] + [{"id": "untitled-" + hashlib.sha256("/kb/語.md".encode()).hexdigest()[:8]}]
    got = with_ids(pages(spark, *rows).repartition(7), "/kb")
    ids = [r["id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == 271
    first = min(r["source_path"] for r in rows if "source_path" in r)
    by = {r["source_path"]: r["id"] for r in got.where("source_path <> '/kb/語.md'").collect()}
    assert by[first] == "untitled" and all(v == f"untitled-{hashlib.sha256(p.encode()).hexdigest()[:8]}" for p, v in by.items() if p not in (first, ""))
    many = sorted((r["title"], int(r["id"].split("-")[2])) for r in got.where("source_path = '/kb/語.md'").collect())
    assert [n for _, n in sorted((n, t) for t, n in many)] == sorted(t for t, _ in many) and [n for _, n in many] == list(range(2, 122))


def test_postings(spark):
    import random

    r = random.Random(6)
    held = [("hot", f"i{n:04}") for n in range(500)] + [("hot", "i0100")] * 9 + [(r.choice("abc"), f"i{r.randrange(900):04}") for _ in range(60)] + [("a", "i0007"), ("c", "i0007")]
    blocks = postings(spark.createDataFrame(held, "k string, i string").repartition(6), "k", "i", 16)
    rows = blocks.orderBy("k", "block").collect()
    assert max(x["n"] for x in rows) <= 16 and all((x["first"], x["last"], x["n"]) == (x["items"][0], x["items"][-1], len(x["items"])) for x in rows)
    for k in {k for k, _ in held}:
        assert [i for x in rows if x["k"] == k for i in x["items"]] == sorted(i for kk, i in held if kk == k)
        assert [x["block"] for x in rows if x["k"] == k] == list(range(len([x for x in rows if x["k"] == k])))
    sets = lambda *ks: sorted(set.intersection(*({i for kk, i in held if kk == k} for k in ks)))
    for ks in (["hot", "a"], ["a", "c"], ["a", "b", "c", "hot"], ["hot"]):
        assert sorted(x["item"] for x in common_items(blocks, "k", ks).collect()) == sets(*ks)
    assert common_items(blocks, "k", ["a", "none"]).count() == 0 and common_items(blocks, "k", []).count() == 0


def test_depth_first(graph):
    got = [tuple(r) for r in traverse.depth_first(graph, "a", 2).orderBy("n").select("id", "depth").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def walk(ahead: dict, root, depth: int) -> list:
    """Depth first over lists of next nodes, step by step."""
    found, stack = {root: 0}, [root]
    while stack:
        here = stack.pop()
        if found[here] < depth:
            for there in ahead.get(here, ()):
                if there not in found:
                    found[there] = found[here] + 1
                    stack.append(there)
    return list(found.items())


@pytest.mark.parametrize("direction", ["forward", "reverse", "both"])
def test_depth_first_with_branches_and_cycles(spark, direction, monkeypatch):
    monkeypatch.setattr(traverse, "BLOCK", 2)
    rng = random.Random(3)
    names = [f"p{i}" for i in range(40)]
    targets = {x: [rng.choice([*names, "nowhere"]) for _ in range(rng.randrange(5))] for x in names}
    targets["p0"] = names[39:10:-1] + ["p0", "p5", "p5"]
    held = KnowledgeGraph.build(pages(spark, *({"id": x, "title": f"Title {x}", "relationships": [rel(t) for t in to]} for x, to in targets.items())))
    back = {x: sorted(s for s in names if x in targets[s]) for x in names}
    ahead = {x: [t for t in targets[x] if t in targets] for x in names}
    ways = {"forward": ahead, "reverse": back, "both": {x: ahead[x] + back[x] for x in names}}[direction]
    for depth in (2, 50):
        got = [(r["id"], r["depth"]) for r in traverse.depth_first(held, "p0", depth, direction).orderBy("n").collect()]
        assert got == walk(ways, "p0", depth)
    alone = KnowledgeGraph.build(pages(spark, {"id": "x", "title": "X", "relationships": [rel("x"), rel("nowhere")]}))
    assert [tuple(r) for r in traverse.depth_first(alone, "x", 3, direction).collect()] == [(0, "x", 0)]


def test_a_walk_over_a_million_steps_holds_only_numbers():
    rng, n, each = np.random.default_rng(1), 200_000, 5
    visits = rng.integers(0, n, (n, each), dtype=np.int32)
    batches = [pa.RecordBatch.from_pydict({"at": pa.array(np.arange(a, a + 1000, dtype=np.int32)), "block": pa.array(np.zeros(1000, np.int32)), "visits": pa.array(list(visits[a : a + 1000]), pa.list_(pa.int32()))}) for a in range(0, n, 1000)]
    first = {i: list(dict.fromkeys(v)) for i, v in enumerate(visits.tolist())}
    distinct = [pa.RecordBatch.from_pydict({"at": b["at"], "block": b["block"], "visits": pa.array([first[i] for i in b["at"].to_pylist()], pa.list_(pa.int32()))}) for b in batches]
    n_steps = sum(map(len, first.values()))
    tracemalloc.start()
    order, depths = traverse.walked(*traverse.adjacency(iter(distinct), n, n_steps), 0, 1 << 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(int(i), int(depths[i])) for i in order] == walk(first, 0, 1 << 30)
    assert n_steps > 990_000 and peak < 4 * n_steps + 20 * n + (1 << 20)


def test_neighbours(graph):
    assert {tuple(r) for r in traverse.neighbourhood(graph, "a").collect()} == {("b", "knows"), ("c", "uses"), ("d", "t")}
    assert {r["id"] for r in traverse.grown(graph, graph.get("c")).collect()} == {"a", "b", "c", "d"}
    assert traverse.grown(graph, graph.get("nobody")).count() == 0


def test_search(graph):
    now = F.lit(NOW).cast("timestamp")
    got = search.search(graph.pages, " ALPHA ", now).collect()
    assert [r["id"] for r in got] == ["a"] and got[0]["keyword"] == 7.0 and got[0]["score"] == pytest.approx(6.3)
    assert [(m["field"], m["type"]) for m in got[0]["matches"]] == [("title", "exact")]
    assert search.search(graph.pages, "", now).count() == 0
    assert search.search(graph.pages, "ring", now).first()["matches"][-1]["value"] == "rings"
    beta = search.search(graph.pages, "beta", now).where("id = 'b'").first()
    assert beta["score"] == pytest.approx(7 * 0.5 * 2.718281828459045 ** (-0.3))
    texts = search.for_llm(search.search(graph.pages, "alpha", now)).first()["text"]
    assert texts.startswith("# Alpha (person)\nConfidence: 0.90\nRelationships: b (knows)")
    ranked = search.search(graph.pages, "rings", now, reranker=overlap_reranker).collect()
    assert ranked[0]["id"] == "a" and ranked[0]["score"] == 1.0 and ranked[0]["matches"] == []


def test_batches_reranked_and_blended(spark):
    held = pages(spark, *({"id": f"p{i}", "title": f"ring {i}", "body": "x" * i, "confidence": 0.5} for i in range(30)))
    asked = spark.createDataFrame([(1, "ring", [1.0, 0.0]), (2, "ring", None), (3, "zzzzzz", [0.0, 1.0])], "query_id long, query string, embedding array<double>")
    now = F.lit(NOW).cast("timestamp")
    plain = {(r["query_id"], r["rank"]): r["id"] for r in search.search_many(held, asked, now).collect()}

    def reranker(query, ids, texts, scores):
        if fails:
            raise RuntimeError("no model")
        return [(i, 9.0) for i in reversed(range(len(ids))) if i % 2]

    fails = True
    assert {(r["query_id"], r["rank"]): r["id"] for r in search.search_many(held, asked, now, reranker=reranker).collect()} == plain
    fails = False
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.search_many(held, asked, now, reranker=reranker).collect()}
    assert [got[1, n] for n in range(1, 11)] == [plain[1, n] for n in range(20, 0, -2)] and [got[1, n] for n in range(11, 21)] == [plain[1, n] for n in range(21, 31)]
    hashed = held.withColumn("content_hash", F.lit("h"))
    vectors = spark.createDataFrame([(f"p{i}", "h" if i else "old", [float(i), 5.0]) for i in (0, 1, 2, 2, 7)], "id string, content_hash string, embedding array<double>")
    got = search.search_many(hashed, asked, now, per_query=4, vectors=vectors).collect()
    for q, text, v in ((1, "ring", [1.0, 0.0]), (2, "ring", None), (3, "zzzzzz", [0.0, 1.0])):
        one = search.search(hashed, text, now, limit=4, vectors=vectors if v else None, query_vector=v).collect()
        assert [(r["id"], round(r["score"], 9)) for r in one] == [(r["id"], round(r["score"], 9)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
    with pytest.raises(ValueError):
        search.search_many(hashed, asked, now, vectors=vectors)


def test_validation(spark):
    bad = pages(spark, {"confidence": 1.5, "relationships": [rel("", "", 2.0)], "temporal": {"valid_from": "2024-13-01", "last_verified": "2024-02-30", "decay_rate": -1.0}, "entities": [{"name": ""}]}, {"id": "i", "title": "t", "entity_type": "e"})
    found = [r["field"] for r in validation.issues(bad).orderBy("n").collect()]
    assert found == ["id", "title", "entity-type", "confidence", "relationships[0].target", "relationships[0].type", "relationships[0].strength", "temporal.valid-from", "entities[0].name", "temporal.decay-rate"]
    assert tuple(validation.check_totals(bad).first()) == (2, 10, 1)
    assert validation.issues(bad).where("field = 'confidence'").first()["message"] == "a confidence lies between 0 and 1, not at 1.5"


def test_merge_is_idempotent(spark):
    start = pages(spark, {"title": "Kept", "tags": ["A"], "source_path": "/kb/d/f.md", "body": "# T\n#a #b [[x]] https://u.org"})
    for force in (False, True):
        once = enrich.enrich_pages(start, "/kb", force)
        twice = enrich.enrich_pages(once.drop("delta"), "/kb", force)
        assert once.drop("delta").collect() == twice.drop("delta").collect()
        assert once.first()["delta"]["changed"] and not twice.first()["delta"]["changed"]
        assert once.first()["title"] == ("T" if force else "Kept")
        assert once.first()["tags"] == (["a", "b", "d"] if force else ["A", "b", "d"])


def test_model_merge(spark):
    start = pages(spark, {"id": "1", "entity_type": "tool"}, {"id": "2", "entity_type": "Document", "summary": "s"}, {"id": "3"})
    model = F.struct(F.lit("location").alias("entity_type"), F.lit("new").alias("summary"), F.array().cast("array<struct<name:string,aliases:array<string>,role:string>>").alias("entities"), F.array(F.struct(F.lit("x").alias("target"), F.lit("t").alias("type"), F.lit(0.7).alias("strength"))).alias("relationships"), F.array(F.lit("h"), F.lit("H")).alias("semantic_hints"), F.array().cast("array<string>").alias("possible_questions"))
    got = {r["id"]: r for r in enrich.merge_model(start.withColumn("model", model)).collect()}
    assert [got[i]["entity_type"] for i in "123"] == ["tool", "place", "place"] and [got[i]["summary"] for i in "123"] == ["new", "s", "new"]
    assert got["1"]["semantic_hints"] == ["h"] and got["1"]["semantic_relationships"][0]["target"] == "x" and got["1"]["relationships"] == []
    kinds = spark.createDataFrame([("TECHNOLOGY",), ("",), ("paper",), ("DATE",)], "k string")
    assert [r[0] for r in kinds.select(enrich.is_residual(F.col("k"))).collect()] == [True, False, False, False]


def test_roots_with_the_same_next_pages_walk_as_one(spark):
    rows = [{"id": "hub", "title": "Hub"}, {"id": "other", "title": "Other"}]
    rows += [{"id": f"leaf{i}", "title": f"Leaf {i}", "relationships": [rel("hub", "t"), *([rel(f"leaf{i}", "self")] if i == 3 else []), *([rel("other", "t")] if i == 5 else [])]} for i in range(90)]
    g = KnowledgeGraph.build(pages(spark, *rows))
    ids = g.pages.select("id")
    hops = traverse.oriented(g, "both").where("node <> visit").select("node", "visit").distinct()
    classes = traverse.classed(ids, ids, hops)
    assert classes.count() == 92 and classes.select("class").distinct().count() == 4  # hub, other, leaf5, the other leaves
    nodes, edges = traverse.breadth_first_many(g, ids.where("id LIKE 'leaf%'"), 2, "both")
    for root in ("leaf0", "leaf3", "leaf5"):
        one, its = traverse.breadth_first(g, root, 2, "both")
        assert sorted(map(tuple, nodes.where(F.col("root") == root).select("id", "depth").collect())) == sorted(map(tuple, one.collect()))
        assert sorted(map(tuple, edges.where(F.col("root") == root).drop("root").collect())) == sorted(map(tuple, its.collect()))
    assert traverse.breadth_first_many(g, ids, 0)[0].count() == 92


@pytest.mark.parametrize(("direction", "types"), [("forward", None), ("both", ["t"])])
def test_many_roots_in_small_tiles(spark, monkeypatch, direction, types):
    for name, size in (("ROOTS", 3), ("ROWS", 5), ("TILES", 2)):
        monkeypatch.setattr(traverse, name, size)
    g = wide(spark, 40)
    roots = g.pages.select("id")
    nodes, edges = traverse.breadth_first_many(g, roots, 2, direction, types)
    got, scanned = [tuple(r) for r in nodes.collect()], [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(map(tuple, traverse.breadth_first_many_nodes(g, roots, 2, direction, types).collect()))
    assert sorted(scanned) == sorted(map(tuple, traverse.breadth_first_many_edges(g, roots, 2, direction, types).collect()))
    steps = [tuple(r) for r in traverse.oriented(g, direction, types).select("node", "visit", "edge_from", "edge_to", "type", "strength").collect()]
    ids, want, passed = {r["id"] for r in roots.collect()}, set(), []
    for root in ids:
        depth, front = {root: 0}, {root}
        for d in (1, 2):
            front = {v for n, v, *_ in steps if n in front and v in ids and v not in depth}
            depth |= dict.fromkeys(front, d)
        want |= {(root, i, d) for i, d in depth.items()}
        passed += [(root, *e[2:]) for e in steps if depth.get(e[0], 2) < 2]
    assert set(got) == want and sorted(scanned) == sorted(passed)


def test_files_of_many_roots_hold_few_distinct_ids(spark, tmp_path):
    """Told root by root, every file had all roots, more than a dictionary holds in a large table; and a row then takes the bytes of its texts."""
    rows = [{"id": f"hub{h}", "title": f"Hub {h}"} for h in range(12)]
    rows += [{"id": f"leaf{h}-{i}", "title": f"Leaf {h} {i}", "relationships": [rel(f"hub{h}", "t")]} for h in range(12) for i in range(200)]
    g = KnowledgeGraph.build(pages(spark, *rows))
    nodes, _ = traverse.breadth_first_many(g, g.pages.where("id LIKE 'leaf%'").select("id"), 2, "both")
    nodes.write.parquet(str(tmp_path / "nodes"))
    told = spark.read.parquet(str(tmp_path / "nodes")).where("depth = 2")
    assert told.count() == 12 * 200 * 199
    # 2,400 roots in tiles of 1,024: no file of rows two steps off has them all.
    files = told.groupBy(F.input_file_name().alias("file")).agg(F.count_distinct("root").alias("roots"), F.count(F.lit(1)).alias("n"))
    assert files.agg(F.max("roots")).first()[0] < 2400
