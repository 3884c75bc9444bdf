"""Ranked search: weighted fuzzy matches over seven fields, decay, embeddings and reranking.

A query is a column expression over the pages, so a search is one scan: filter and top-k are
Catalyst's. The fields' matches are one expression, which the optimizer copies once, into the
filter above the scan. A batch of queries meets the distinct values of all pages by the keys of
`matchindex`, and the matches meet the pages by value.
"""

from __future__ import annotations

import logging
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.matching import best_match, code_score, code_type, distinct_words
from quillmesh.functions.temporal import multiplier
from quillmesh.functions.text import trimmed
from quillmesh.functions.vectors import blended, cosine, unit_score
from quillmesh.operators.matchindex import value_matches
from quillmesh.operators.nearest import top_k
from quillmesh.schema import MATCH
from quillmesh.sources.shared import written

#: Weight of a match in each field, in the order in which they are added up.
WEIGHTS = {"title": 7, "entity-name": 10, "alias": 8, "tag": 5, "semantic-hint": 3, "relationship-target": 2, "body": 1}
RERANKED = 20
EMBEDDING_WEIGHT = 0.3


def normalised(query: str) -> str:
    return query.strip().lower()


def field_values() -> dict[str, Column]:
    """The values of each field."""
    return {
        "title": F.array("title"), "entity-name": F.col("entities.name"), "alias": F.flatten("entities.aliases"), "tag": F.col("tags"),
        "semantic-hint": F.col("semantic_hints"), "relationship-target": F.col("relationships.target"), "body": distinct_words(F.col("body")),
    }


def keyword_score(code_of) -> Column:
    """The weighted sum of the fields' matches, added up in the fields' order. code_of(field): the code of its best match."""
    return reduce(lambda total, f: total + F.lit(float(WEIGHTS[f])) * code_score(code_of(f)), WEIGHTS, F.lit(0.0))


def scored(pages: DataFrame, query: Column) -> DataFrame:
    """pages with `keyword` (weighted sum) and `matches` (field, value, type of each field that matches)."""
    best = F.struct(*(best_match(query, values).alias(f"m{i}") for i, values in enumerate(field_values().values())))
    place = {f: f"m{i}" for i, f in enumerate(WEIGHTS)}

    def told(b: Column) -> Column:
        parts = [F.when(b[m].isNotNull(), F.struct(F.lit(f).alias("field"), b[m]["value"].alias("value"), code_type(b[m]["code"]).alias("type"))) for f, m in place.items()]
        return F.struct(keyword_score(lambda f: b[place[f]]["code"]).alias("keyword"), F.array_compact(F.array(*parts)).cast(f"array<{MATCH.simpleString()}>").alias("matches"))

    # The matches are bound as an element, so that every use of one is the same comparison.
    found = pages.withColumn("__found", F.transform(F.array(best), told)[0])
    return found.withColumns({"keyword": F.col("__found.keyword"), "matches": F.col("__found.matches")}).drop("__found")


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("score"), "title", "id")


def search(pages: DataFrame, query: str, now: Column, limit: int = 0, min_score: float = 0.0, vectors: DataFrame | None = None, query_vector: list[float] | None = None, embedding_weight: float = EMBEDDING_WEIGHT, reranker=None) -> DataFrame:
    """Results, best first, as pages' columns with keyword, matches and score.

    vectors: (id, content_hash, embedding); pages then need content_hash. limit 0: all.
    """
    if query == "":
        return scored(pages, F.lit("")).withColumn("score", F.lit(0.0)).where(F.lit(False))
    found = scored(pages, F.lit(normalised(query)))
    t = F.col("temporal")
    found = found.withColumn("score", F.col("keyword") * multiplier(F.col("confidence"), t["decay_rate"], t["last_verified"], now))
    if vectors is not None and query_vector is not None:
        held = vectors.select("id", "content_hash", "embedding").dropDuplicates(["id", "content_hash"])  # a vector that is saved twice counts once
        emb = unit_score(cosine(F.col("embedding"), F.array(*map(F.lit, query_vector))))
        found = found.join(held, ["id", "content_hash"], "left").withColumn("__emb", F.when(F.col("embedding").isNotNull(), emb))
        found = found.where((F.col("keyword") > 0) | (F.col("__emb") >= 0.5)).withColumn("score", F.when(F.col("__emb").isNotNull(), blended(F.col("score"), F.col("__emb"), embedding_weight)).otherwise(F.col("score"))).drop("embedding", "__emb")
    else:
        found = found.where("keyword > 0")
    if min_score > 0:
        found = found.where(F.col("score") >= min_score)
    if reranker is not None:
        found = reranked(found, query, reranker)
        return found.orderBy("place", F.desc("score"), "title", "id").limit(limit) if limit else found.orderBy("place", F.desc("score"), "title", "id")
    return ordered(found).limit(limit) if limit else ordered(found)


def reranked(found: DataFrame, query: str, reranker, top: int = RERANKED) -> DataFrame:
    """The first `top` results in the reranker's order (place) and with its scores, then the rest as they were.

    reranker(query, ids, texts, scores) gives (index, score) pairs, best first; what it leaves out is dropped.
    Where it fails, the failure is logged and the results stay as they were. The head is at most
    `top` rows, so it fits one task.
    """
    found = written(found)  # one scoring for the head, its rows and the rest
    head = ordered(found).limit(top)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["score", "title", "id"], ascending=[False, True, True], kind="stable")
        try:
            order = reranker(query, batch["id"].tolist(), batch["body"].tolist(), batch["score"].tolist())
            order, failed = [(int(i), float(s)) for i, s in order], False
        except Exception as e:  # noqa: BLE001  whatever a model does, the search still has its results
            logging.getLogger(__name__).warning("the reranker failed, results stay as they were: %s", e)
            order, failed = list(enumerate(batch["score"].tolist())), True
        return pd.DataFrame({"id": pd.Series([batch["id"].iloc[i] for i, _ in order], dtype=object), "__score": [s for _, s in order], "place": range(len(order)), "__failed": failed})

    ranks = head.select("id", "title", "body", "score").groupBy().applyInPandas(run, "id string, __score double, place int, __failed boolean")
    no_matches = F.array().cast(f"array<{MATCH.simpleString()}>")
    top_rows = found.join(ranks, "id").withColumns({"score": F.col("__score"), "matches": F.when(F.col("__failed"), F.col("matches")).otherwise(no_matches)}).drop("__score", "__failed")
    rest = found.join(head.select("id"), "id", "left_anti").withColumn("place", F.lit(top))
    return top_rows.select(*rest.columns).unionByName(rest)


def search_many(
    pages: DataFrame, queries: DataFrame, now: Column, per_query: int = 0, vectors: DataFrame | None = None, embedding_weight: float = EMBEDDING_WEIGHT, reranker=None, top: int = RERANKED
) -> DataFrame:
    """queries: (query_id, query). query_id, rank, id, title, score, best first within each query. Pages are told apart by id.

    With vectors (id, content_hash, embedding), queries that have an `embedding` blend their
    similarity in, as search does; pages then need content_hash, and per_query must be given: pages
    without a matching word come from an exact search for the nearest per_query vectors. A reranker
    orders the first `top` of each query anew, a call for each, and the rest follows.
    """
    asked = queries.where("query <> ''").select("query_id", F.lower(trimmed(F.col("query"))).alias("q"))
    t = F.col("temporal")
    about = pages.select("id", "title", multiplier(F.col("confidence"), t["decay_rate"], t["last_verified"], now).alias("decay"))

    def numbered(field: int):
        return lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("place"), F.lower(x).alias("value"))

    values = F.concat(*(F.transform(v, numbered(f)) for f, v in enumerate(field_values().values())))
    held = written(pages.select("id", F.inline(values)))
    distinct = written(held.select("value").where("value IS NOT NULL").distinct())
    found = held.join(value_matches(distinct, asked), "value")
    best = found.groupBy("query_id", "id").agg(*(F.min(F.when(F.col("field") == i, F.col("code"))).alias(f"__{i}") for i in range(len(WEIGHTS))))
    place = {f: F.col(f"__{i}") for i, f in enumerate(WEIGHTS)}
    results = best.select("query_id", "id", keyword_score(place.__getitem__).alias("keyword"))
    if vectors is None:
        results = results.join(about, "id").withColumn("score", F.col("keyword") * F.col("decay"))
    else:
        if not per_query:
            raise ValueError("a batch with vectors takes per_query")
        results = _with_vectors(results, pages, queries, vectors, about, per_query if reranker is None else max(per_query, top), embedding_weight)
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "id"))).select("query_id", "rank", "id", "title", "score")
    if reranker is not None:
        ranked = _reranked_many(ranked, pages, queries, reranker, top)
    return ranked.where(F.col("rank") <= per_query) if per_query else ranked


def _with_vectors(results: DataFrame, pages: DataFrame, queries: DataFrame, vectors: DataFrame, about: DataFrame, k: int, weight: float) -> DataFrame:
    """query_id, id, title, score: the keyword matches and, of all others, those that can be among the first k."""
    current = vectors.select("id", "content_hash", "embedding").dropDuplicates(["id", "content_hash"]).join(pages.select("id", "content_hash", "title"), ["id", "content_hash"])
    current = written(current.select("id", "embedding", F.concat("title", F.lit("\0"), "id").alias("tie")))
    asked = queries.where("query <> ''").where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    matched = results.join(about, "id").join(current.select("id", F.col("embedding").alias("__v")), "id", "left").join(asked.withColumnRenamed("embedding", "__q"), "query_id", "left")
    emb = F.when(F.col("__v").isNotNull() & F.col("__q").isNotNull(), unit_score(cosine(F.col("__v"), F.col("__q"))))
    plain = F.col("keyword") * F.col("decay")
    matched = matched.withColumn("__emb", emb).select("query_id", "id", "title", F.when(F.col("__emb").isNotNull(), blended(plain, F.col("__emb"), weight)).otherwise(plain).alias("score"), (F.col("keyword") > 0).alias("__found"))
    near = top_k(current, asked, k)[0].withColumn("__emb", unit_score(F.col("similarity"))).where("__emb >= 0.5").join(about.select("id", "title"), "id")
    rescued = near.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "title", blended(F.lit(0.0), F.col("__emb"), weight).alias("score"))
    return matched.where("__found").drop("__found").unionByName(rescued)


def _reranked_many(ranked: DataFrame, pages: DataFrame, queries: DataFrame, reranker, top: int) -> DataFrame:
    """The first `top` of each query in the reranker's order; what it leaves out is dropped, and where it fails the order stays."""
    held = written(ranked)
    head = held.where(F.col("rank") <= top).join(pages.select("id", "body"), "id").join(queries.select("query_id", "query"), "query_id")
    kind = ranked.schema["query_id"].dataType.simpleString()

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("rank")
        try:
            order = [(int(i), float(s)) for i, s in reranker(batch["query"].iloc[0], batch["id"].tolist(), batch["body"].tolist(), batch["score"].tolist())]
        except Exception as e:  # noqa: BLE001  one query's failure leaves the others' results
            logging.getLogger(__name__).warning("the reranker failed, results stay as they were: %s", e)
            order = list(enumerate(batch["score"].tolist()))
        picked = batch.iloc[[i for i, _ in order]]
        return pd.DataFrame({"query_id": picked["query_id"], "rank": range(1, len(order) + 1), "id": picked["id"], "title": picked["title"], "score": [s for _, s in order]})

    first = written(head.groupBy("query_id").applyInPandas(run, f"query_id {kind}, rank int, id string, title string, score double"))
    kept = first.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("__kept"))
    moved = F.col("rank") - F.lit(top) + F.coalesce("__kept", F.lit(0))
    rest = held.where(F.col("rank") > top).join(kept, "query_id", "left").select("query_id", moved.alias("rank"), "id", "title", "score")
    return first.unionByName(rest)


def for_llm(results: DataFrame) -> DataFrame:
    """results with `text`: title, confidence, edges, hints and the start of the body, for a prompt."""
    from quillmesh.functions.text import first_bytes

    kind = F.when(F.col("entity_type") == "", "").otherwise(F.format_string(" (%s)", "entity_type"))
    edges = F.array_join(F.transform("relationships", lambda r: F.concat(r["target"], F.lit(" ("), r["type"], F.lit(")"))), ", ")
    hints = F.array_join("semantic_hints", ", ")
    body = trimmed(F.col("body"))
    excerpt = first_bytes(body, 500)
    text = F.concat(
        F.lit("# "), F.col("title"), kind, F.lit("\n"), F.format_string("Confidence: %.2f\n", "confidence"),
        F.when(F.size("relationships") > 0, F.concat(F.lit("Relationships: "), edges, F.lit("\n"))).otherwise(""),
        F.when(F.size("semantic_hints") > 0, F.concat(F.lit("Semantic hints: "), hints, F.lit("\n"))).otherwise(""),
        F.when(body != "", F.concat(F.lit("\n"), F.when(F.octet_length(body) > 500, excerpt).otherwise(body), F.lit("\n"))).otherwise(""),
    )
    return results.withColumn("text", text)
