"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import collections as C
from quillmesh.functions import temporal as T
from quillmesh.functions import text as X
from quillmesh.functions import vectors as V
from quillmesh.operators import enrich, handoff, models, nearest, traverse, validation
from quillmesh.operators import search as S
from quillmesh.operators.graph import KnowledgeGraph, common_items, with_ids
from quillmesh.operators.incremental import GraphTables
from quillmesh.plans import oracle as O
from quillmesh.plans.datasets import QUERY_VECTOR, ROOT, company, notes, parts, table, vectors
from quillmesh.schema import conform
from quillmesh.sources import datasource, markdown, store
from quillmesh.sources.shared import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def now():
    return F.lit(O.NOW).cast("timestamp")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def joined(x, by: str = "|"):
    return F.array_join(x, by)


def edge_text(r):
    return F.concat_ws(":", r["target"], r["type"], r["strength"].cast("string"))


def edges_text(x):
    return joined(F.transform(x, edge_text))


# Search

_SEARCH = f"WITH {O.PARTS}, scored AS (SELECT *, {{kw}} AS keyword FROM parts) SELECT id, title, round(keyword, 6) AS keyword, round(keyword * ({O.multiplier()}), 6) AS score FROM scored WHERE keyword > 0"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", "title", F.round("keyword", 6).alias("keyword"), F.round("score", 6).alias("score"))


@query(_SEARCH.format(kw=O.keyword("'ring'")))
def search_keyword(spark, sf_dir):
    return _ranked(S.search(parts(spark, sf_dir), "ring", now()))


@query(_SEARCH.format(kw=O.keyword("'brand#1'")))
def search_typo(spark, sf_dir):
    return _ranked(S.search(parts(spark, sf_dir), " Brand#1 ", now()))


@query(_SEARCH.format(kw=O.keyword("'economy'")) + f" AND keyword * ({O.multiplier()}) >= 5")
def search_min_score(spark, sf_dir):
    return _ranked(S.search(parts(spark, sf_dir), "economy", now(), min_score=5.0))


@query(_SEARCH.format(kw=O.keyword("'small ring'")) + " ORDER BY score DESC, title, id LIMIT 25")
def search_topk(spark, sf_dir):
    return _ranked(S.search(parts(spark, sf_dir), "small ring", now(), limit=25))


@query(f"WITH {O.PARTS}, f AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {v} AS vals FROM parts" for f, v in O.FIELDS.items()) + f"), b AS (SELECT id, field, vals, {O.best('vals', chr(39) + 'ring' + chr(39))} AS s FROM f) SELECT id, field, list_filter(vals, lambda x: ({O.score('x', chr(39) + 'ring' + chr(39))}) = s)[1] AS value, CASE s WHEN 1.0 THEN 'exact' WHEN 0.8 THEN 'prefix' WHEN 0.5 THEN 'contains' ELSE 'fuzzy' END AS type FROM b WHERE s > 0")
def search_match_evidence(spark, sf_dir):
    found = S.search(parts(spark, sf_dir), "ring", now())
    return found.select("id", F.explode("matches").alias("m")).select("id", "m.field", "m.value", "m.type")


_MANY = ["ring", "widget", "brand#2", "promo", "shop3"]


@query(f"WITH {O.PARTS}, q AS (SELECT unnest({_MANY}) AS query, unnest(range({len(_MANY)})) AS query_id), scored AS (SELECT query_id, id, title, confidence, decay_rate, last_verified, {O.keyword('query')} AS keyword FROM parts, q), r AS (SELECT query_id, id, title, keyword * ({O.multiplier()}) AS score FROM scored WHERE keyword > 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM r) SELECT query_id, rank, id, round(score, 6) AS score FROM n WHERE rank <= 10")
def search_multi_query(spark, sf_dir):
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(_MANY)], "query_id long, query string")
    return S.search_many(parts(spark, sf_dir), asked, now(), per_query=10).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


_QV = f"{QUERY_VECTOR}::DOUBLE[]"


@query(f"WITH {O.PARTS}, {O.VECTORS}, scored AS (SELECT p.*, {O.keyword(chr(39) + 'ring' + chr(39))} AS keyword, CASE WHEN v.id IS NULL THEN NULL ELSE ({O.cosine('v.embedding', _QV)} + 1) / 2 END AS emb FROM parts p LEFT JOIN vectors v ON v.id = p.id AND v.content_hash = 'h-' || p.k), f AS (SELECT id, keyword, emb, keyword * ({O.multiplier()}) AS kw FROM scored WHERE keyword > 0 OR emb >= 0.5) SELECT id, round(keyword, 6) AS keyword, round(CASE WHEN emb IS NULL THEN kw ELSE 0.7 * kw + 0.3 * emb END, 6) AS score FROM f")
def search_hybrid(spark, sf_dir):
    pages = parts(spark, sf_dir).withColumn("content_hash", F.regexp_replace("id", "^part", "h"))
    found = S.search(pages, "ring", now(), vectors=vectors(spark, sf_dir), query_vector=QUERY_VECTOR)
    return found.select("id", F.round("keyword", 6).alias("keyword"), F.round("score", 6).alias("score"))


_VECTORS_OF = [[((i * (7 + q)) % 11 - 5) / 10 for i in range(64)] for q in range(len(_MANY))]


@query(f"WITH {O.PARTS}, {O.VECTORS}, q AS (SELECT unnest({_MANY}) AS query, unnest(range({len(_MANY)})) AS query_id, unnest({_VECTORS_OF})::DOUBLE[] AS qv), scored AS (SELECT query_id, p.*, {O.keyword('query')} AS keyword, CASE WHEN v.id IS NULL THEN NULL ELSE ({O.cosine('v.embedding', 'qv')} + 1) / 2 END AS emb FROM q, parts p LEFT JOIN vectors v ON v.id = p.id AND v.content_hash = 'h-' || p.k), f AS (SELECT query_id, id, title, emb, keyword * ({O.multiplier()}) AS kw FROM scored WHERE keyword > 0 OR emb >= 0.5), r AS (SELECT query_id, id, title, CASE WHEN emb IS NULL THEN kw ELSE 0.7 * kw + 0.3 * emb END AS score FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM r) SELECT query_id, rank, id, round(score, 6) AS score FROM n WHERE rank <= 100")
def search_multi_hybrid(spark, sf_dir):
    pages = parts(spark, sf_dir).withColumn("content_hash", F.regexp_replace("id", "^part", "h"))
    asked = spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(zip(_MANY, _VECTORS_OF, strict=True))], "query_id long, query string, embedding array<double>")
    found = S.search_many(pages, asked, now(), per_query=100, vectors=vectors(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {O.cosine('q.e', 'v.e')} AS similarity FROM v q, v WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10")
def nearest_vectors(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lpad(F.col("vec_id").cast("string"), 20, "0").alias("tie"), "embedding")
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest.top_k(held, asked, 10)[0]
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"), F.round("similarity", 6).alias("similarity"))


def _by_length(q, ids, texts, scores):
    """A stand-in reranker: shorter texts first; leaves out texts of 29 characters or more."""
    return sorted(((i, 100.0 - len(t)) for i, t in enumerate(texts) if len(t) < 29), key=lambda x: (-x[1], x[0]))


@query(f"WITH {O.PARTS}, scored AS (SELECT *, {O.keyword(chr(39) + 'ring' + chr(39))} AS keyword FROM parts), r AS (SELECT id, title, body, keyword * ({O.multiplier()}) AS score, row_number() OVER (ORDER BY keyword * ({O.multiplier()}) DESC, title, id) AS n FROM scored WHERE keyword > 0), h AS (SELECT id, (100 - length(body))::DOUBLE AS score, row_number() OVER (ORDER BY length(body), n) - 1 AS place FROM r WHERE n <= 20 AND length(body) < 29) SELECT id, round(score, 6) AS score, place FROM h UNION ALL SELECT id, round(score, 6), 20 FROM r WHERE n > 20")
def rerank_topn(spark, sf_dir):
    found = S.search(parts(spark, sf_dir), "ring", now(), reranker=_by_length)
    return found.select("id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {O.PARTS}, q AS (SELECT unnest({_MANY}) AS query, unnest(range({len(_MANY)})) AS query_id), scored AS (SELECT query_id, id, title, body, confidence, decay_rate, last_verified, {O.keyword('query')} AS keyword FROM parts, q), r AS (SELECT query_id, id, title, body, keyword * ({O.multiplier()}) AS score, row_number() OVER (PARTITION BY query_id ORDER BY keyword * ({O.multiplier()}) DESC, title, id) AS n FROM scored WHERE keyword > 0), h AS (SELECT query_id, id, (100 - length(body))::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY length(body), n) AS rank FROM r WHERE n <= 20 AND length(body) < 29), k AS (SELECT query_id, count(*) AS kept FROM h GROUP BY 1) SELECT query_id, rank, id, round(score, 6) AS score FROM h UNION ALL SELECT query_id, n - 20 + coalesce(kept, 0), id, round(score, 6) FROM r LEFT JOIN k USING (query_id) WHERE n > 20")
def rerank_many(spark, sf_dir):
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(_MANY)], "query_id long, query string")
    return S.search_many(parts(spark, sf_dir), asked, now(), reranker=_by_length).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(f"WITH {O.PARTS} SELECT id, '# ' || title || ' (tool)' || {O.NL} || 'Confidence: ' || printf('%.2f', confidence) || {O.NL} || 'Relationships: ' || targets[1] || ' (made-by)' || {O.NL} || 'Semantic hints: ' || hints[1] || {O.NL} || {O.NL} || body || {O.NL} AS text FROM parts")
def format_for_llm(spark, sf_dir):
    return S.for_llm(parts(spark, sf_dir)).select("id", "text")


@query(f"WITH {O.VECTORS} SELECT vec_id, round({O.cosine('embedding', _QV)}, 6) AS similarity FROM vectors ORDER BY {O.cosine('embedding', _QV)} DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    sim = V.cosine(F.col("embedding"), F.array(*map(F.lit, QUERY_VECTOR)))
    return table(spark, sf_dir, "embeddings").select("vec_id", sim.alias("s")).orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("similarity"))


# Time

_DAYS = "greatest((epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE, 0.0)"
_BASE, _RATE = "(o_totalprice / 812345.678::DOUBLE)", "((o_orderkey % 4) * 0.001::DOUBLE)"
_DECAY = f"CASE WHEN {_RATE} = 0 THEN greatest(0.0, least(1.0, {_BASE})) ELSE greatest(0.0, least(1.0, {_BASE} * exp(-{_RATE} * {_DAYS}))) END"
_VALID = "TIMESTAMP '1998-01-01' >= o_orderdate - INTERVAL 300 DAY AND (o_orderkey % 5 = 0 OR TIMESTAMP '1998-01-01' <= o_orderdate + INTERVAL 400 DAY)"


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    until = F.when(F.col("o_orderkey") % 5 != 0, F.expr("d + INTERVAL 400 DAY"))
    return o.select("o_orderkey", "d", (F.col("o_totalprice") / 812345.678).alias("base"), ((F.col("o_orderkey") % 4) * F.lit(0.001)).alias("rate"), F.expr("d - INTERVAL 300 DAY").alias("valid_from"), until.alias("valid_until")), F.lit("1998-01-01").cast("timestamp")


@query(f"SELECT o_orderkey, round({_DECAY}, 6) AS confidence FROM orders")
def temporal_decay(spark, sf_dir):
    o, now = _orders(spark, sf_dir)
    return o.select("o_orderkey", F.round(T.decayed(F.col("base"), F.col("rate"), F.col("d"), now), 6).alias("confidence"))


@query(f"SELECT o_orderkey, CASE WHEN {_VALID} THEN round({_DECAY}, 6) ELSE 0.0 END AS confidence FROM orders")
def effective_confidence(spark, sf_dir):
    o, now = _orders(spark, sf_dir)
    return o.select("o_orderkey", F.round(T.effective_confidence(F.col("base"), F.col("rate"), F.col("d"), F.col("valid_from"), F.col("valid_until"), now), 6).alias("confidence"))


@query(f"SELECT o_orderkey FROM orders WHERE {_VALID}")
def validity_window(spark, sf_dir):
    o, now = _orders(spark, sf_dir)
    return o.where(T.is_valid(F.col("valid_from"), F.col("valid_until"), now)).select("o_orderkey")


# Text


@query(f"SELECT p_partkey, {O.slug('p_name || p_brand')} AS slug FROM part")
def slugify_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.concat("p_name", "p_brand")).alias("slug"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_type || ' '), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM part")
def reconcile_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.reconcile_key(F.concat("p_brand", F.lit(" / "), "p_type", F.lit(" "))).alias("key"))


@query(f"SELECT doc_id, sha256(lang || {O.NL} || text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("lang"), F.col("text")).alias("hash"))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, CASE WHEN len({_WORDS}) <= 20 THEN text ELSE array_to_string({_WORDS}[1:20], ' ') END AS preview FROM documents")
def body_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.body_preview(F.col("text"), 20).alias("preview"))


@query(f"SELECT doc_id, len({_WORDS}) * 13 // 10 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {O.NOTES} SELECT k, head || 'Use ' || tail || {O.NL} AS clean FROM notes")
def strip_code(spark, sf_dir):
    return notes(spark, sf_dir).select("k", X.strip_code(F.col("body")).alias("clean"))


@query(f"WITH {O.NOTES} SELECT k, CASE WHEN k % 3 = 0 THEN replace(replace(stem, '-', ' '), '_', ' ') ELSE p_name || ' notes' END AS title FROM notes")
def extract_titles(spark, sf_dir):
    return notes(spark, sf_dir).select("k", X.extract_title(F.col("body"), X.stem(F.col("source_path"))).alias("title"))


@query(f"WITH {O.NOTES} SELECT k, 'tag' || (k % 5) || '|' || lower(p_type) AS tags FROM notes")
def extract_hashtags(spark, sf_dir):
    return notes(spark, sf_dir).select("k", joined(X.extract_hashtags(F.col("body"))).alias("tags"))


@query(f"WITH {O.NOTES} SELECT k, 'supplier-' || (k % 17) || ':related-to:0.5|' || {O.slug('p_brand')} || ':related-to:0.5' AS links FROM notes")
def extract_wikilinks(spark, sf_dir):
    return notes(spark, sf_dir).select("k", edges_text(X.extract_wikilinks(F.col("body"))).alias("links"))


@query(f"WITH {O.NOTES} SELECT k, 'https://example.com/p/' || (k % 9) || '|https://example.com/b' AS urls FROM notes")
def extract_urls(spark, sf_dir):
    return notes(spark, sf_dir).select("k", joined(X.extract_urls(F.col("body"))).alias("urls"))


@query(f"WITH {O.NOTES} SELECT k, lower(p_type) AS tags FROM notes")
def directory_tags(spark, sf_dir):
    return notes(spark, sf_dir).select("k", joined(X.directory_tags(F.col("source_path"), "/kb")).alias("tags"))


@query(f"WITH {O.NOTES} SELECT k, {O.slug('stem')} AS id, CASE WHEN k % 3 = 0 THEN replace(replace(stem, '-', ' '), '_', ' ') ELSE p_name || ' notes' END AS title, 'document' AS entity_type, 0.7::DOUBLE AS confidence, 'tag' || (k % 5) || '|' || lower(p_type) AS tags, 'supplier-' || (k % 17) || '|' || {O.slug('p_brand')} AS targets, 'https://example.com/p/' || (k % 9) || '|https://example.com/b' AS sources FROM notes")
def tier1_extract(spark, sf_dir):
    x = F.col("extracted")
    found = enrich.tier1(notes(spark, sf_dir), "/kb")
    return found.select("k", x["id"].alias("id"), x["title"].alias("title"), x["entity_type"].alias("entity_type"), x["confidence"].alias("confidence"), joined(x["tags"]).alias("tags"), joined(x["relationships"]["target"]).alias("targets"), joined(x["provenance"]["sources"]).alias("sources"))


# Merges and what they change


def _drafts(spark, sf_dir) -> DataFrame:
    """Notes with some fields filled in already."""
    k = F.col("k")
    some = F.array(F.struct(F.concat(F.lit("supplier-"), (k % 17).cast("string")).alias("target"), F.when(k % 2 == 0, "related-to").otherwise("buys").alias("type"), F.lit(0.9).alias("strength")))
    entities = F.array(*(F.struct(n.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(r).alias("role")) for n, r in ((F.col("p_brand"), "a"), (F.upper("p_brand"), "b"))))
    pages = notes(spark, sf_dir).select(F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("own-"), k.cast("string"))).alias("id"), F.when(k % 5 == 0, F.col("p_name")).otherwise("").alias("title"), F.when(k % 4 == 0, "tool").otherwise("").alias("entity_type"), F.when(k % 3 == 0, 0.5).otherwise(0.0).alias("confidence"), F.array(F.lit("TAG1"), F.col("p_type"), F.lit("Tag1")).alias("tags"), entities.alias("entities"), some.alias("relationships"), F.when(k % 7 == 0, "kept").otherwise("").alias("summary"), "body", "source_path")
    return conform(pages).withColumn("k", F.regexp_extract("source_path", r"-(\d+)\.md$", 1).cast("long"))


_DRAFTS = f"""{O.NOTES}, drafts AS (SELECT *, CASE WHEN k % 2 = 0 THEN '' ELSE 'own-' || k END AS id0, CASE WHEN k % 5 = 0 THEN p_name ELSE '' END AS title0, CASE WHEN k % 4 = 0 THEN 'tool' ELSE '' END AS type0, CASE WHEN k % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS conf0,
  {O.slug('stem')} AS id1, CASE WHEN k % 3 = 0 THEN replace(replace(stem, '-', ' '), '_', ' ') ELSE p_name || ' notes' END AS title1,
  CASE WHEN lower(p_type) = 'tag1' THEN 'TAG1' ELSE 'TAG1|' || p_type END || CASE WHEN k % 5 = 1 THEN '' ELSE '|tag' || (k % 5) END AS tags2, 'tag' || (k % 5) || '|' || lower(p_type) AS tags1,
  'supplier-' || (k % 17) || ':' || CASE WHEN k % 2 = 0 THEN 'related-to' ELSE 'buys' END || ':0.9' || CASE WHEN k % 2 = 0 THEN '' ELSE '|supplier-' || (k % 17) || ':related-to:0.5' END || '|' || {O.slug('p_brand')} || ':related-to:0.5' AS rels2,
  'supplier-' || (k % 17) || ':related-to:0.5|' || {O.slug('p_brand')} || ':related-to:0.5' AS rels1 FROM notes)"""


def _merged(df: DataFrame) -> DataFrame:
    return df.select("k", "id", "title", "entity_type", "confidence", joined("tags").alias("tags"), edges_text("relationships").alias("relationships"), joined(F.col("entities.role")).alias("roles"))


@query(f"WITH {_DRAFTS} SELECT k, CASE WHEN id0 = '' THEN id1 ELSE id0 END AS id, CASE WHEN title0 = '' THEN title1 ELSE title0 END AS title, CASE WHEN type0 = '' THEN 'document' ELSE type0 END AS entity_type, CASE WHEN conf0 = 0 THEN 0.7::DOUBLE ELSE conf0 END AS confidence, tags2 AS tags, rels2 AS relationships, 'a' AS roles FROM drafts")
def merge_default(spark, sf_dir):
    return _merged(enrich.merge_frontmatter(enrich.tier1(_drafts(spark, sf_dir), "/kb")))


@query(f"WITH {_DRAFTS} SELECT k, id1 AS id, title1 AS title, 'document' AS entity_type, 0.7::DOUBLE AS confidence, tags1 AS tags, rels1 AS relationships, 'a' AS roles FROM drafts")
def merge_force(spark, sf_dir):
    return _merged(enrich.merge_frontmatter(enrich.tier1(_drafts(spark, sf_dir), "/kb"), force=True))


_KINDS = ["PERSON", "LOCATION", "technology", "Software", "", "OTHER"]


def _model():
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("k") % len(_KINDS) + 1).cast("int"))
    entity = F.array(F.struct(F.lower("title").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("m").alias("role")))
    edges = F.array(*(F.struct(F.lit("x").alias("target"), F.lit(t).alias("type"), F.lit(0.7).alias("strength")) for t in ("uses", "uses", "has")))
    return F.struct(kind.alias("entity_type"), F.concat(F.lit("about "), F.col("k").cast("string")).alias("summary"), entity.alias("entities"), edges.alias("relationships"), F.array(F.lit("Hint"), F.lit("hint")).alias("semantic_hints"), F.array().cast("array<string>").alias("possible_questions"))


_KIND = f"{_KINDS}[k % {len(_KINDS)} + 1]"
_NORMAL = f"CASE upper({_KIND}) WHEN 'PERSON' THEN 'person' WHEN 'LOCATION' THEN 'place' WHEN 'OTHER' THEN 'document' WHEN 'SOFTWARE' THEN 'software' ELSE '' END"


@query(f"WITH {_DRAFTS} SELECT k, CASE WHEN type0 = '' AND {_NORMAL} <> '' THEN {_NORMAL} ELSE type0 END AS entity_type, CASE WHEN k % 7 = 0 THEN 'kept' ELSE 'about ' || k END AS summary, 'x:uses:0.7|x:has:0.7' AS semantic, 'Hint' AS hints, 'supplier-' || (k % 17) AS targets FROM drafts")
def merge_model_sticky_type(spark, sf_dir):
    done = enrich.merge_model(_drafts(spark, sf_dir).withColumn("model", _model()))
    return done.select("k", "entity_type", "summary", edges_text("semantic_relationships").alias("semantic"), joined("semantic_hints").alias("hints"), joined("relationships.target").alias("targets"))


@query(f"WITH {O.NOTES} SELECT count(*) FILTER (WHERE {_KIND} = 'technology') AS residual, count(*) AS total FROM notes")
def residual_types(spark, sf_dir):
    kind = _model()["entity_type"]
    return _drafts(spark, sf_dir).agg(F.count_if(enrich.is_residual(kind)).alias("residual"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {O.NOTES} SELECT count(*) FILTER (WHERE k % 2 = 1 AND k % 5 = 0 AND k % 4 = 0 AND k % 3 = 0) AS tier1, count(*) FILTER (WHERE k % 7 = 0) AS tier2, count(*) AS pending FROM notes")
def completeness(spark, sf_dir):
    d = _drafts(spark, sf_dir)
    return d.agg(F.count_if(enrich.tier1_complete()).alias("tier1"), F.count_if(enrich.tier2_complete()).alias("tier2"), F.count_if(enrich.needs_enrichment(tier2=True)).alias("pending"))


@query("SELECT p_partkey, 'new' AS added, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS removed FROM part")
def delta_strings(spark, sf_dir):
    a, b = F.array("p_brand", "p_type"), F.concat(F.array(F.upper("p_brand"), F.lit("new")), F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("p_type"))))
    return table(spark, sf_dir, "part").select("p_partkey", joined(C.without(b, a, F.lower)).alias("added"), joined(C.without(a, b, F.lower)).alias("removed"))


@query("SELECT p_partkey, 'c:t:1.0' AS added, 'b:t:1.0' AS removed, CASE WHEN p_partkey % 2 = 0 THEN 'a:t:0.5' ELSE '' END AS modified FROM part")
def delta_edges(spark, sf_dir):
    def rels(*items):
        return F.array(*(F.struct(F.lit(t).alias("target"), F.lit("t").alias("type"), s.alias("strength")) for t, s in items))

    a = rels(("a", F.lit(1.0)), ("b", F.lit(1.0)))
    b = rels(("a", F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(1.0)), ("c", F.lit(1.0)))
    key, body = (lambda r: r["target"]), (lambda r: F.struct(r["type"], r["strength"]))
    return table(spark, sf_dir, "part").select("p_partkey", edges_text(C.without(b, a, key)).alias("added"), edges_text(C.without(a, b, key)).alias("removed"), edges_text(C.modified(a, b, key, body)).alias("modified"))


@query("SELECT p_partkey, 'tier' AS added, p_type AS removed, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS modified FROM part")
def delta_entities(spark, sf_dir):
    entity = lambda n, al: F.struct(n.alias("name"), F.array(al).alias("aliases"), F.lit("r").alias("role"))
    a = F.array(entity(F.col("p_brand"), F.lit("x")), entity(F.col("p_type"), F.lit("x")))
    b = F.array(entity(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, "y").otherwise("x")), entity(F.lit("tier"), F.lit("x")))
    key, body = (lambda e: e["name"]), (lambda e: F.struct(e["role"], e["aliases"]))
    names = lambda x: joined(x["name"])
    return table(spark, sf_dir, "part").select("p_partkey", names(C.without(b, a, key)).alias("added"), names(C.without(a, b, key)).alias("removed"), names(C.modified(a, b, key, body)).alias("modified"))


@query(f"WITH {_DRAFTS} SELECT k, true AS changed, k % 2 = 0 AS id_changed, k % 5 <> 0 AS title_changed, CASE WHEN k % 5 = 1 THEN '' ELSE 'tag' || (k % 5) END AS tags_added, '' AS tags_removed FROM drafts")
def enrich_delta(spark, sf_dir):
    d = enrich.enrich_pages(_drafts(spark, sf_dir), "/kb").select("k", "delta.*")
    return d.select("k", "changed", "id_changed", "title_changed", joined("tags_added").alias("tags_added"), joined("tags_removed").alias("tags_removed"))


# Ordered sets


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS tags FROM part")
def union_tags_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", joined(C.union_strings(F.array("p_brand", F.upper("p_brand"), "p_type"), F.array(F.lower("p_type"), "p_name", "p_brand"))).alias("tags"))


def _line_edges(spark, sf_dir) -> DataFrame:
    """An edge list of each order: part brand and return flag, in line order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct("l_linenumber", F.struct(F.col("p_brand").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("strength")).alias("e"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items")).select("l_orderkey", F.col("items.e").alias("edges"))


_LINES = "lines AS (SELECT l_orderkey, l_linenumber AS n, p_brand AS target, l_returnflag AS type, l_discount AS strength FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, target, type ORDER BY n, strength) AS r FROM lines) SELECT l_orderkey, string_agg(target || ':' || type, '|' ORDER BY n, target, type, strength) AS edges FROM f WHERE r = 1 GROUP BY 1")
def dedupe_edges_pair(spark, sf_dir):
    first = C.distinct_edges(F.col("edges"))
    return _line_edges(spark, sf_dir).select("l_orderkey", joined(F.transform(first, lambda r: F.concat_ws(":", r["target"], r["type"]))).alias("edges"))


@query(f"WITH {_LINES}, placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, target, type, strength) - 1 AS place FROM lines) SELECT 'order-' || l_orderkey AS src, target, type, strength, min(place)::INTEGER AS ord FROM placed GROUP BY 1, 2, 3, 4")
def dedupe_edges_triple(spark, sf_dir):
    """The graph's edges of pages that declare an order's lines as theirs."""
    orders = _line_edges(spark, sf_dir).select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("id"), F.col("edges").alias("relationships"))
    return KnowledgeGraph.build(conform(orders)).edges.select("src", "target", "type", "strength", "ord")


@query("SELECT p_partkey, p_brand || '|' || p_type AS names, p_brand || ':a|' || upper(p_brand) || ':b|' || p_type || ':a' AS by_role FROM part")
def dedupe_entities(spark, sf_dir):
    items = F.array(*(F.struct(n.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(r).alias("role")) for n, r in ((F.col("p_brand"), "a"), (F.upper("p_brand"), "b"), (F.col("p_type"), "a"), (F.lower("p_type"), "A"))))
    by_role = C.distinct_by(items, C.entity_role_key)
    return table(spark, sf_dir, "part").select("p_partkey", joined(C.distinct_entities(items)["name"]).alias("names"), joined(F.transform(by_role, lambda e: F.concat_ws(":", e["name"], e["role"]))).alias("by_role"))


# Validation


def _flawed(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    edges = F.array(F.struct(F.when(k % 4 == 0, "").otherwise("x").alias("target"), F.when(k % 6 == 0, "").otherwise("t").alias("type"), ((k % 8) / 5).alias("strength")))
    temporal = F.struct(F.when(k % 9 == 0, "2024-13-01").otherwise("2024-01-31").alias("valid_from"), F.lit("").alias("valid_until"), F.lit("2024-02-30").alias("last_verified"), F.when(k % 10 == 0, -0.5).otherwise(0.0).alias("decay_rate"))
    entity = F.array(F.struct(F.when(k % 11 == 0, "").otherwise("n").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("role")))
    pages = table(spark, sf_dir, "part").select(F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("id"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("title"), F.lit("tool").alias("entity_type"), (F.col("p_size") / 40).alias("confidence"), edges.alias("relationships"), temporal.alias("temporal"), entity.alias("entities"), k.cast("string").alias("source_path"))
    return conform(pages)


_ISSUES = """issues AS (SELECT p_partkey AS k, 'id' AS field, 'the page has no id' AS message FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'title', 'the page has no title' FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 'confidence', 'a confidence lies between 0 and 1, not at ' || regexp_replace((p_size / 40.0::DOUBLE)::VARCHAR, '\\.0$', '') FROM part WHERE p_size > 40
  UNION ALL SELECT p_partkey, 'relationships[0].target', 'this edge has no target' FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 'relationships[0].type', 'this edge has no type' FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT p_partkey, 'relationships[0].strength', 'an edge''s strength lies between 0 and 1, not at ' || ((p_partkey % 8) / 5.0::DOUBLE)::VARCHAR FROM part WHERE p_partkey % 8 > 5
  UNION ALL SELECT p_partkey, 'temporal.valid-from', 'no date (year-month-day): 2024-13-01' FROM part WHERE p_partkey % 9 = 0
  UNION ALL SELECT p_partkey, 'entities[0].name', 'this entity has no name' FROM part WHERE p_partkey % 11 = 0
  UNION ALL SELECT p_partkey, 'temporal.decay-rate', 'a rate of decay is not below 0: -0.5' FROM part WHERE p_partkey % 10 = 0)"""


@query(f"WITH {_ISSUES} SELECT k::VARCHAR AS source_path, field, message FROM issues")
def validate_pages(spark, sf_dir):
    return validation.issues(_flawed(spark, sf_dir)).select("source_path", "field", "message")


@query(f"WITH {_ISSUES} SELECT (SELECT count(*) FROM part) AS pages, (SELECT count(*) FROM issues) AS errors, (SELECT count(DISTINCT k) FROM issues) AS files")
def check_totals(spark, sf_dir):
    return validation.check_totals(_flawed(spark, sf_dir))


# Identity and the graph


@query("WITH p AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'economy-' || (p_partkey % 3) ELSE '' END AS id, '/kb/' || p_type || '/' || (p_partkey % 300) || CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '.txt' END AS path, p_partkey AS k FROM part), s AS (SELECT *, trim(regexp_replace(lower(regexp_replace(path[5:], '\\.[^./]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p WHERE id = ''), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY path) AS r, slug IN (SELECT id FROM p) AS taken FROM s), l AS (SELECT path, CASE WHEN taken OR r > 1 THEN slug || '-' || sha256(path)[1:8] ELSE slug END AS id FROM n), m AS (SELECT *, row_number() OVER (PARTITION BY id) AS nth FROM l) SELECT path AS source_path, id || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS id FROM m")
def derived_ids(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/kb/"), F.col("p_type"), F.lit("/"), (k % 300).cast("string"), F.when(k % 2 == 0, ".md").otherwise(".txt"))
    pages = table(spark, sf_dir, "part").select(F.when(k % 10 == 0, F.concat(F.lit("economy-"), (k % 3).cast("string"))).otherwise("").alias("id"), F.lit("").alias("title"), path.alias("source_path"))
    return with_ids(conform(pages), "/kb").where("id_derived").select("source_path", "id")


def _graph(spark, sf_dir) -> KnowledgeGraph:
    return KnowledgeGraph.build(company(spark, sf_dir))


@query(f"WITH {O.COMPANY} SELECT src, written, target, type, resolved FROM declared")
def resolve_targets(spark, sf_dir):
    return _graph(spark, sf_dir).declared.select("src", "written", "target", "type", "resolved")


def _updated(spark, sf_dir) -> KnowledgeGraph:
    """The company's graph by an update: first without customers, with suppliers under other names and a page too many."""
    pages = company(spark, sf_dir).withColumn("source_path", F.concat(F.lit("/kb/"), F.col("id"), F.lit(".md")))
    supplier = F.col("entity_type") == "organization"
    before = pages.where("entity_type <> 'person'").withColumn("title", F.when(supplier, F.concat(F.lit("Planet "), F.col("title"))).otherwise(F.col("title")))
    extra = conform(spark.range(1).select(F.lit("aaa").alias("id"), F.lit("Planet 3").alias("title"), F.lit("/kb/old.md").alias("source_path")))
    tables = GraphTables(spark, shared_dir(spark), "/kb")
    tables.build(before.unionByName(extra))
    return tables.update(pages.where(supplier | (F.col("entity_type") == "person")), extra.select("source_path"))


@query(f"WITH {O.COMPANY} SELECT src, written, target, type, strength, semantic, resolved, ord FROM declared")
def incremental_graph(spark, sf_dir):
    return _updated(spark, sf_dir).declared.select("src", "written", "target", "type", "strength", "semantic", "resolved", "ord")


@query(f"WITH {O.COMPANY} SELECT target, src, semantic FROM declared WHERE NOT resolved")
def dangling_refs(spark, sf_dir):
    return _graph(spark, sf_dir).dangling


@query("WITH claims AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS key, id FROM (SELECT 'part-' || p_partkey AS id, unnest(['part-' || p_partkey, p_name, p_brand, lower(p_type), 'item ' || (p_partkey % 10)]) AS name FROM part)) SELECT key, min(id) AS page_id, count(*) AS owners FROM claims GROUP BY key HAVING count(*) > 1")
def ambiguous_aliases(spark, sf_dir):
    return KnowledgeGraph.build(parts(spark, sf_dir)).ambiguous.select("key", "page_id", F.size("owners").cast("long").alias("owners"))


@query(f"WITH {O.COMPANY} SELECT count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved FROM declared WHERE semantic")
def semantic_edge_stats(spark, sf_dir):
    return _graph(spark, sf_dir).semantic_stats()


@query(f"WITH {O.COMPANY} SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT title) FROM pages) AS entities, (SELECT count(*) FROM edges) AS relationships, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM pages)) AS tags")
def graph_stats(spark, sf_dir):
    return _graph(spark, sf_dir).stats()


@query(f"WITH {O.COMPANY}, t AS (SELECT unnest(tags) AS tag, id FROM pages) SELECT tag, string_agg(id, '|' ORDER BY id) AS ids FROM t GROUP BY tag")
def tag_index(spark, sf_dir):
    return _graph(spark, sf_dir).tag_index().select("tag", joined("ids").alias("ids"))


def _postings_sql(pairs: str, key: str, item: str) -> str:
    return f"WITH {O.COMPANY}, p AS ({pairs}), n AS (SELECT *, (row_number() OVER (PARTITION BY {key} ORDER BY {item}) - 1) // 64 AS block FROM p) SELECT {key}, block, min({item}) AS first, max({item}) AS last, count(*)::INTEGER AS n, string_agg({item}, '|' ORDER BY {item}) AS items FROM n GROUP BY 1, 2"


@query(_postings_sql("SELECT unnest(tags) AS tag, id FROM pages", "tag", "id"))
def tag_postings(spark, sf_dir):
    return _graph(spark, sf_dir).tag_postings(64).withColumn("items", joined("items"))


@query(_postings_sql("SELECT target, src FROM edges", "target", "src"))
def reverse_postings(spark, sf_dir):
    return _graph(spark, sf_dir).reverse_postings(64).withColumn("items", joined("items"))


@query(f"WITH {O.COMPANY} SELECT id AS item FROM pages WHERE list_contains(tags, 'supplier') AND list_contains(tags, 'tier-1')")
def tags_in_common(spark, sf_dir):
    return common_items(_graph(spark, sf_dir).tag_postings(64), "tag", ["supplier", "tier-1"])


@query(f"WITH {O.COMPANY}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM pages) SELECT tag FROM t ORDER BY tag")
def distinct_tags(spark, sf_dir):
    return _graph(spark, sf_dir).tag_index().select("tag").orderBy("tag")


@query(f"WITH {O.COMPANY} SELECT src, string_agg(target || ':' || type, '|' ORDER BY ord) AS edges FROM edges GROUP BY src")
def forward_adjacency(spark, sf_dir):
    return _graph(spark, sf_dir).forward().select("src", joined(F.transform("edges", lambda e: F.concat_ws(":", e["target"], e["type"]))).alias("edges"))


@query(f"WITH {O.COMPANY} SELECT target, string_agg(src, '|' ORDER BY src) AS srcs FROM edges GROUP BY target")
def reverse_refs(spark, sf_dir):
    return _graph(spark, sf_dir).reverse().select("target", joined("srcs").alias("srcs"))


@query(f"WITH {O.COMPANY} SELECT id, title, entity_type, confidence, array_to_string(tags, '|') AS tags FROM pages WHERE id = 'nation-3'")
def page_lookup(spark, sf_dir):
    return _graph(spark, sf_dir).get("nation-3").select("id", "title", "entity_type", "confidence", joined("tags").alias("tags"))


@query(f"WITH {O.COMPANY} SELECT id FROM pages WHERE list_contains(tags, 'tier-1')")
def tag_filter(spark, sf_dir):
    return _graph(spark, sf_dir).by_tag("tier-1").select("id")


def _summary_sql(where: str, limit: str = "") -> str:
    return f"""WITH {O.COMPANY}, f AS (SELECT * FROM pages WHERE {where} ORDER BY id {limit})
SELECT (SELECT count(*) FROM f) AS pages, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM f)) AS relationships, (SELECT string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) FROM f) AS entity_types,
(SELECT string_agg(DISTINCT t, '|' ORDER BY t) FROM (SELECT unnest(tags) AS t FROM f)) AS tags, (SELECT count(DISTINCT target) FROM declared WHERE NOT resolved AND src IN (SELECT id FROM f)) AS dangling_targets,
(SELECT coalesce(sum(CASE WHEN entity_type = 'organization' THEN 2 ELSE 0 END), 0)::BIGINT FROM f) AS semantic_edges, (SELECT count(*) FROM declared WHERE semantic AND resolved AND src IN (SELECT id FROM f)) AS semantic_edges_resolved, 0::BIGINT AS derived_ids"""


def _summary(df: DataFrame) -> DataFrame:
    return df.select("pages", "relationships", joined("entity_types").alias("entity_types"), joined("tags").alias("tags"), F.col("dangling_targets").cast("long").alias("dangling_targets"), "semantic_edges", "semantic_edges_resolved", "derived_ids")


@query(_summary_sql("true"))
def compact_summary_stats(spark, sf_dir):
    return _summary(_graph(spark, sf_dir).summary_stats())


@query(_summary_sql("entity_type = 'organization' AND list_contains(tags, 'tier-2')", "LIMIT 7"))
def summary_filtered(spark, sf_dir):
    return _summary(_graph(spark, sf_dir).summary_stats(entity_type="organization", tag="tier-2", max_pages=7))


@query(f"WITH {O.COMPANY}, r AS (SELECT src, string_agg(target || ':' || type, '|' ORDER BY ord) AS rels FROM edges GROUP BY src) SELECT id, title, entity_type, array_to_string(tags, '|') AS tags, confidence, coalesce(rels, '') AS relationships FROM (SELECT * FROM pages WHERE id IN ('nation-1', 'supplier-5', 'region-0', 'nope')) LEFT JOIN r ON src = id")
def compact_summary_nodes(spark, sf_dir):
    nodes = _graph(spark, sf_dir).summary_nodes(page_ids=["nation-1", "supplier-5", "region-0", "nope"])
    return nodes.select("id", "title", "entity_type", joined("tags").alias("tags"), "confidence", F.coalesce(joined(F.transform("relationships", lambda e: F.concat_ws(":", e["target"], e["type"]))), F.lit("")).alias("relationships"))


# Traversal

_AHEAD = "SELECT src AS node, target AS visit, src AS edge_from, target AS edge_to, type, strength FROM edges"
_BACK = "SELECT target, src, src, target, first_value(type) OVER w, first_value(strength) OVER w FROM edges WINDOW w AS (PARTITION BY src, target ORDER BY ord)"


def _bfs_sql(root: str, steps: str, depth: int, what: str) -> str:
    return f"""WITH RECURSIVE {O.COMPANY}, steps AS ({steps}), hop AS (SELECT DISTINCT node, visit FROM steps),
walk AS (SELECT '{root}' AS id, 0 AS depth UNION SELECT h.visit, w.depth + 1 FROM walk w JOIN hop h ON h.node = w.id JOIN pages p ON p.id = h.visit WHERE w.depth < {depth}),
nodes AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) {what}"""


_NODES = "SELECT id, depth FROM nodes"
_EDGES = "SELECT edge_from, edge_to, type, strength FROM nodes JOIN steps ON node = id WHERE depth < {}"


@query(_bfs_sql("customer-100", _AHEAD, 3, _NODES))
def bfs_forward(spark, sf_dir):
    return traverse.breadth_first(_graph(spark, sf_dir), "customer-100", 3)[0]


@query(_bfs_sql(ROOT, f"SELECT * FROM ({_AHEAD} WHERE false UNION ALL {_BACK})", 2, _NODES))
def bfs_reverse(spark, sf_dir):
    return traverse.breadth_first(_graph(spark, sf_dir), ROOT, 2, "reverse")[0]


@query(_bfs_sql("supplier-5", f"{_AHEAD} UNION ALL {_BACK}", 2, _NODES))
def bfs_both(spark, sf_dir):
    return traverse.breadth_first(_graph(spark, sf_dir), "supplier-5", 2, "both")[0]


@query(_bfs_sql(ROOT, f"SELECT * FROM ({_AHEAD} WHERE false UNION ALL {_BACK}) WHERE type IN ('located_in', 'based_in')", 3, _NODES))
def bfs_type_filter(spark, sf_dir):
    return traverse.breadth_first(_graph(spark, sf_dir), ROOT, 3, "reverse", ["located_in", "based_in"])[0]


@query(_bfs_sql("supplier-5", f"{_AHEAD} UNION ALL {_BACK}", 2, _EDGES.format(2)))
def bfs_edges(spark, sf_dir):
    return traverse.breadth_first(_graph(spark, sf_dir), "supplier-5", 2, "both")[1]


def _bfs_many_sql(roots: str, steps: str, depth: int, what: str) -> str:
    return f"""WITH RECURSIVE {O.COMPANY}, steps AS ({steps}), hop AS (SELECT DISTINCT node, visit FROM steps),
walk AS (SELECT id AS root, id, 0 AS depth FROM pages WHERE {roots} UNION SELECT w.root, h.visit, w.depth + 1 FROM walk w JOIN hop h ON h.node = w.id JOIN pages p ON p.id = h.visit WHERE w.depth < {depth}),
nodes AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY 1, 2) {what}"""


@query(_bfs_many_sql("entity_type = 'organization'", f"{_AHEAD} UNION ALL {_BACK}", 2, "SELECT root, id, depth FROM nodes"))
def bfs_many_roots(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return traverse.breadth_first_many_nodes(g, g.pages.where("entity_type = 'organization'"), 2, "both")


@query(_bfs_many_sql("entity_type = 'organization'", _AHEAD, 3, "SELECT root, edge_from, edge_to, type, strength FROM nodes JOIN steps ON node = id WHERE depth < 3"))
def bfs_many_edges(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return traverse.breadth_first_many_edges(g, g.pages.where("entity_type = 'organization'"), 3)


@query(_bfs_sql("customer-100", _AHEAD, 3, "SELECT max(depth) AS max_depth FROM nodes"))
def bfs_max_depth(spark, sf_dir):
    return traverse.max_depth(traverse.breadth_first(_graph(spark, sf_dir), "customer-100", 3)[0])


@query(_bfs_sql("customer-100", _AHEAD, 3, "SELECT depth::INTEGER AS n, id, depth FROM nodes"))
def dfs_forward(spark, sf_dir):
    return traverse.depth_first(_graph(spark, sf_dir), "customer-100", 3)


def _dfs_sql(root: str, steps: str, depth: int, what: str) -> str:
    """The walk as rows of (stack, found), one for each node that is taken from the stack."""
    return f"""WITH RECURSIVE {O.COMPANY}, steps AS ({steps}),
tries AS (SELECT node, visit, row_number() OVER (PARTITION BY node ORDER BY way, place, ord) AS k FROM steps JOIN pages ON id = visit),
adj AS (SELECT node, list(visit ORDER BY k) AS visits FROM (SELECT node, visit, min(k) AS k FROM tries GROUP BY 1, 2) GROUP BY node),
walk AS (SELECT 0 AS i, [{{'id': '{root}', 'd': 0}}] AS stack, [{{'id': '{root}', 'd': 0}}] AS found UNION ALL
  SELECT i + 1, list_concat(stack[1:len(stack) - 1], new), list_concat(found, new) FROM (SELECT i, stack, found,
    list_transform(list_filter(coalesce(visits, []), lambda v: NOT list_contains(list_transform(found, lambda f: f.id), v)), lambda v: {{'id': v, 'd': stack[-1].d + 1}}) AS new
    FROM walk LEFT JOIN adj ON node = stack[-1].id AND stack[-1].d < {depth} WHERE len(stack) > 0)),
told AS (SELECT unnest(range(len(found))) AS n, unnest(found) AS f FROM (SELECT found FROM walk ORDER BY i DESC LIMIT 1)),
nodes AS (SELECT n::INTEGER AS n, f.id AS id, f.d::INTEGER AS depth FROM told) {what}"""


_AHEAD_IN_ORDER = "SELECT src AS node, target AS visit, 0 AS way, '' AS place, ord, src AS edge_from, target AS edge_to, type, strength FROM edges"
_BACK_IN_ORDER = "SELECT target, src, 1, src, ord, src, target, first_value(type) OVER w, first_value(strength) OVER w FROM edges WINDOW w AS (PARTITION BY src, target ORDER BY ord)"


@query(_dfs_sql("supplier-5", f"{_AHEAD_IN_ORDER} UNION ALL {_BACK_IN_ORDER}", 4, "SELECT n, id, depth FROM nodes"))
def dfs_both(spark, sf_dir):
    return traverse.depth_first(_graph(spark, sf_dir), "supplier-5", 4, "both")


@query(_dfs_sql(ROOT, f"SELECT * FROM ({_AHEAD_IN_ORDER} WHERE false UNION ALL {_BACK_IN_ORDER})", 2, "SELECT n, id, depth FROM nodes"))
def dfs_reverse(spark, sf_dir):
    return traverse.depth_first(_graph(spark, sf_dir), ROOT, 2, "reverse")


@query(_dfs_sql("supplier-5", f"{_AHEAD_IN_ORDER} UNION ALL {_BACK_IN_ORDER}", 2, "SELECT edge_from, edge_to, type, strength FROM nodes JOIN steps ON node = id WHERE depth < 2"))
def dfs_edges(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return traverse.depth_first_edges(g, traverse.depth_first(g, "supplier-5", 2, "both"), 2, "both")


@query(f"WITH {O.COMPANY}, near AS (SELECT target AS id, type, ord, 0 AS way FROM edges WHERE src = 'nation-3' UNION ALL SELECT src, type, ord, 1 FROM edges WHERE target = 'nation-3') SELECT id, arg_min(type, way * 1000 + ord) AS type FROM near WHERE id IN (SELECT id FROM pages) GROUP BY id")
def neighbourhood_1hop(spark, sf_dir):
    return traverse.neighbourhood(_graph(spark, sf_dir), "nation-3")


@query(f"WITH {O.COMPANY}, seeds AS (SELECT id FROM pages WHERE title = 'NATION_3' OR title = 'ASIA'), g AS (SELECT id FROM seeds UNION SELECT target FROM edges WHERE src IN (SELECT id FROM seeds) UNION SELECT src FROM edges WHERE target IN (SELECT id FROM seeds)) SELECT id FROM g WHERE id IN (SELECT id FROM pages)")
def seeded_subgraph(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return traverse.grown(g, g.pages.where(F.col("title").isin("NATION_3", "ASIA")))


# What is out of date


@query("WITH c AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), o AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 4 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 5) SELECT coalesce(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM c FULL JOIN o ON c.path = o.path WHERE o.path IS NULL OR c.path IS NULL OR c.h <> o.h")
def staleness_diff(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id"), F.col("doc_id") % 10
    cached = store.checksums(d.where(k != 5).withColumn("text", F.col("text"))).join(d.where(k == 4).select("path", F.lit("x").alias("x")), "path", "left").select("path", F.coalesce("x", "sha256").alias("sha256"))
    return store.stale(store.checksums(d.where(k != 3)), cached)


_PENDING = f"WITH {O.VECTORS}, p AS (SELECT 'part-' || p_partkey AS id, 'h-' || p_partkey AS content_hash FROM part)"


def _hashed(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.regexp_replace("id", "^part", "h").alias("content_hash"))


@query(f"{_PENDING} SELECT id, content_hash FROM p WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.id = p.id AND v.content_hash = p.content_hash)")
def pending_embeddings(spark, sf_dir):
    return store.pending(_hashed(spark, sf_dir), vectors(spark, sf_dir))


@query(f"{_PENDING} SELECT count(*) AS total, count(v.id) AS embedded, count(*) - count(v.id) AS pending FROM p LEFT JOIN vectors v ON v.id = p.id AND v.content_hash = p.content_hash")
def embed_status(spark, sf_dir):
    return store.embed_status(_hashed(spark, sf_dir), vectors(spark, sf_dir))


# Models


@query("WITH r AS (SELECT c_nationkey, ['PERSON', 'TOOL', 'OTHER', 'GADGET'][c_custkey % 4 + 1] AS role FROM customer), n AS (SELECT c_nationkey, role, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, CASE role WHEN 'OTHER' THEN 0 WHEN 'PERSON' THEN 1 WHEN 'TOOL' THEN 8 ELSE 1000 END, role) AS k FROM n) SELECT c_nationkey, lower(role) AS entity_type FROM o WHERE k = 1".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def type_vote_mode(spark, sf_dir):
    roles = F.array(*map(F.lit, ("PERSON", "TOOL", "OTHER", "GADGET")))
    return enrich.vote(table(spark, sf_dir, "customer").select("c_nationkey", F.element_at(roles, (F.col("c_custkey") % 4 + 1).cast("int")).alias("role")), "c_nationkey")


@query("SELECT s_suppkey, s_name AS target, 'sells' AS type, 0.8::DOUBLE AS strength FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'Nation ' || s_nationkey, 'near', 0.8 FROM supplier")
def triplex_resolve(spark, sf_dir):
    k = F.col("s_suppkey")
    items = F.array(F.concat(F.lit("[1], ORGANIZATION:"), "s_name"), F.concat(F.lit("[2], LOCATION: Nation "), F.col("s_nationkey").cast("string")), F.when(k % 3 == 0, "(2, sells, 9)").otherwise("(2, sells, 1)"), F.lit("(1, near, 2)"), F.lit("(1, broken)"), F.lit("noise"))
    return enrich.triples(table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(items).alias("item")), "s_suppkey")


@query("SELECT s_suppkey, 'nation-' || s_nationkey || ':in:0.7' AS edges FROM supplier")
def spo_edges(spark, sf_dir):
    spo = F.array(F.struct(F.col("s_name").alias("subject"), F.lit(" in ").alias("predicate"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("object")), F.struct(F.lit("").alias("subject"), F.lit("").alias("predicate"), F.lit("x").alias("object")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", edges_text(enrich.edges_of_spo(spo)).alias("edges"))


def _answer(prompt: str, body: str) -> str:
    """A stand-in model: answers about half of all texts in broken JSON that can be mended, some beyond repair."""
    n = len(body) % 4
    name = body.split()[0] if body.split() else "nobody"
    whole = '{"entities": [{"name": "%s", "type": "PERSON"}], "relationships": [{"subject": "a", "predicate": "knows", "object": "%s"}]}' % (name, name.upper())
    return [whole, whole.replace('"entities":', '"entities"', 1), whole[:-1], "no answer"][n]


@query(f"WITH {O.PARTS}, p AS (SELECT id, length(body) % 4 = 3 AS broken, split_part(body, ' ', 1) AS w FROM parts) SELECT id, CASE WHEN broken THEN 'parse-error' ELSE 'ok' END AS status, CASE WHEN broken THEN '' ELSE 'person' END AS entity_type, CASE WHEN broken THEN 0 ELSE 1 END::INTEGER AS n_entities, CASE WHEN broken THEN '' ELSE w END AS targets FROM p")
def json_repair_parse(spark, sf_dir):
    docs = parts(spark, sf_dir).select("id", "body")
    return models.extracted(docs, _answer).select("id", "status", "entity_type", F.size("entities").alias("n_entities"), joined("relationships.target").alias("targets"))


@query(f"WITH {O.PARTS} SELECT k AS ord, id, true AS recovered, 'person' AS entity_type, (len(string_split(body, ' ')) * 13 // 10)::BIGINT AS input_tokens FROM parts WHERE length(body) % 4 = 3 ORDER BY k LIMIT 50")
def fallback_recover(spark, sf_dir):
    docs = parts(spark, sf_dir).select("id", "body")
    failed = models.extracted(docs, _answer).where("status = 'parse-error'").select("id").join(docs, "id").withColumn("ord", F.regexp_extract("id", r"(\d+)", 1).cast("long"))
    return models.recovered(failed, lambda prompt, body: _answer(prompt, body + " " * (-len(body) % 4)), max_files=50).select("ord", "id", "recovered", "entity_type", "input_tokens")


@query(f"WITH {O.PARTS} SELECT id, title, confidence, array_to_string(tags, '|') AS tags, array_to_string(targets, '|') AS targets, '' AS error FROM parts")
def page_files(spark, sf_dir):
    """Every part's page written as a file by the data source, and read back by it."""
    datasource.register(spark)
    root = shared_dir(spark)
    parts(spark, sf_dir).withColumn("source_path", F.concat("id", F.lit(".md"))).write.format(datasource.FORMAT).mode("append").save(root)
    return spark.read.format(datasource.FORMAT).load(root).select("id", "title", "confidence", joined("tags").alias("tags"), joined("relationships.target").alias("targets"), "error")


@query(f"WITH {O.PARTS} SELECT id, true AS same FROM parts")
def page_roundtrip(spark, sf_dir):
    """Pages rendered as files and parsed again; `same` tells whether nothing was lost."""
    pages = parts(spark, sf_dir).withColumn("source_path", F.concat("id", F.lit(".md")))
    back = markdown.parsed(markdown.rendered(pages))
    told = lambda df: df.select("id", F.sha2(F.to_json(F.struct("title", "entity_type", F.round("confidence", 6), "tags", "entities", F.col("relationships"), "semantic_hints")), 256).alias("h"))
    return told(pages).join(told(back).withColumnRenamed("h", "h2"), "id").select("id", (F.col("h") == F.col("h2")).alias("same"))


@query(f"WITH {O.PARTS} SELECT id, sha256(title || {O.NL} || {O.NL} || body) AS content_hash, 16::INTEGER AS dims, '' AS error FROM parts")
def embed_texts(spark, sf_dir):
    pages = parts(spark, sf_dir).select("id", X.embedding_text(F.col("title"), F.col("body")).alias("text"))
    texts = pages.withColumn("content_hash", F.sha2("text", 256))
    return models.embedded(texts, models.HashEmbedder(16), "hash-16").select("id", "content_hash", "dims", "error")


@query(f"WITH {O.COMPANY} SELECT id, id AS json_id, title AS json_title FROM pages")
def export_pages(spark, sf_dir):
    return _graph(spark, sf_dir).export().select("id", F.get_json_object("json", "$.id").alias("json_id"), F.get_json_object("json", "$.title").alias("json_title"))


_RESULTS = """r AS (SELECT k, k % 30 <> 0 AND k % 20 <> 0 AS good, CASE WHEN k % 30 = 0 THEN ' ' WHEN k % 20 = 0 THEN 'gone.md' ELSE id || '.md' END AS path, tags[1] AS brand FROM parts WHERE k % 10 = 0)"""


@query(f"WITH {O.PARTS}, {_RESULTS} SELECT k::INTEGER AS ord, path, good AS applied, CASE WHEN good THEN '' WHEN path = ' ' THEN 'the entry has no path' ELSE 'the file is not there' END AS error, CASE WHEN good THEN 'about ' || k ELSE '' END AS summary, CASE WHEN good THEN brand || ':fits' ELSE '' END AS edges FROM r")
def apply_results(spark, sf_dir):
    """Results brought from elsewhere, joined to the pages' files; the new files are parsed again."""
    pages = parts(spark, sf_dir).withColumn("source_path", F.concat("id", F.lit(".md")))
    k = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    path = F.when(k % 30 == 0, " ").when(k % 20 == 0, "gone.md").otherwise(F.col("source_path"))
    entity = F.struct(F.concat(F.lit(" "), F.col("tags")[0]).alias("name"), F.lit("MAKER").alias("type"))
    edge_of = lambda predicate: F.struct(F.col("title").alias("subject"), F.lit(predicate).alias("predicate"), F.upper(F.col("tags")[0]).alias("object"))
    results = pages.where(k % 10 == 0).select(k.alias("ord"), path.alias("path"), F.lit("TECHNOLOGY").alias("entity_type"), F.concat(F.lit("about "), k.cast("string")).alias("summary"), F.array(entity).alias("entities"), F.array(edge_of(" fits"), edge_of(" ")).alias("relationships"))
    told = written(handoff.apply_results(markdown.rendered(pages), results))
    again = markdown.parsed(told.where("applied").select("path", "text")).select(F.col("source_path").alias("path"), "summary", joined(F.transform("semantic_relationships", lambda e: F.concat_ws(":", e["target"], e["type"]))).alias("edges"))
    return told.select("ord", "path", "applied", "error").join(again, "path", "left").select("ord", "path", "applied", "error", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("edges", F.lit("")).alias("edges"))
