"""SQL of the datasets and of single functions, from which the catalogue's SQL is put together."""

from __future__ import annotations

from quillmesh.operators.search import WEIGHTS

NL = "chr(10)"

PARTS = """parts AS (SELECT 'part-' || p_partkey AS id, p_name AS title, p_size / 50.0::DOUBLE AS confidence, [p_brand, p_type] AS tags, [p_brand] AS names,
  [lower(p_type), 'item ' || (p_partkey % 10)] AS aliases, ['supplier-' || (p_partkey % 100)] AS targets, [p_brand || ' ' || p_type] AS hints,
  '2024-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS last_verified, (p_partkey % 3) * 0.001::DOUBLE AS decay_rate,
  p_name || ' made as ' || lower(p_type) || ' for shop' || (p_partkey % 7) AS body, p_partkey AS k FROM part)"""

NOTES = f"""notes AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, '/kb/' || p_type || '/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.md' AS source_path,
  replace(p_name, ' ', '_') || '-' || p_partkey AS stem,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '# ' || p_name || ' notes' || {NL} END || 'Made by [[Supplier ' || (p_partkey % 17) || ']] and [[supplier ' || (p_partkey % 17) || ']], see [[' || p_brand || ']].' || {NL} AS head,
  '```' || {NL} || '#hidden [[Nope]]' || {NL} || '```' || {NL} AS fence, '`[[code]]`' AS code,
  ' here #Tag' || (p_partkey % 5) || ' #' || lower(p_type) || ' #tag' || (p_partkey % 5) || ' x' || {NL} || 'See https://example.com/p/' || (p_partkey % 9) || '. or (https://example.com/b)' || {NL} AS tail,
  head || fence || 'Use ' || code || tail AS body FROM part)"""

COMPANY = """pages AS (
  SELECT 'region-' || r_regionkey AS id, r_name AS title, 'place' AS entity_type, 0.9::DOUBLE AS confidence, ['region'] AS tags FROM region UNION ALL
  SELECT 'nation-' || n_nationkey, n_name, 'place', 0.8, ['nation', 'group-' || (n_nationkey % 2)] FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT 'supplier-' || s_suppkey, s_name, 'organization', 0.5::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE, ['supplier', 'tier-' || (s_suppkey % 4)] FROM supplier UNION ALL
  SELECT 'customer-' || c_custkey, c_name, 'person', 0.6, [lower(c_mktsegment)] FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw AS (
  SELECT 'nation-' || n_nationkey AS src, r_name AS written, 'located_in' AS type, 0.9::DOUBLE AS strength, false AS semantic, 0 AS ord FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'based_in', 0.7, false, 0 FROM supplier UNION ALL
  SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'based_in', 0.7, false, 1 FROM supplier UNION ALL
  SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'ships_to', 0.2, false, 2 FROM supplier UNION ALL
  SELECT 'supplier-' || s_suppkey, 'Region ' || (s_suppkey % 5), 'mentions', 0.5, true, 3 FROM supplier UNION ALL
  SELECT 'supplier-' || s_suppkey, 'Planet ' || (s_suppkey % 7), 'mentions', 0.5, true, 4 FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL
  SELECT 'customer-' || c_custkey, n_name, 'lives_in', 0.6, false, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
  SELECT 'customer-' || c_custkey, 'Unknown Corp ' || (c_custkey % 7), 'works_for', 0.3, false, 1 FROM customer WHERE c_custkey % 50 = 0),
claims AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS key, id FROM (SELECT id, unnest([id, title]) AS name FROM pages)),
aliases AS (SELECT key, min(id) AS page_id, list_sort(list(id)) AS owners FROM claims WHERE key <> '' GROUP BY key),
declared AS (SELECT src, written, coalesce(p.id, a.page_id, written) AS target, type, strength, semantic, coalesce(p.id, a.page_id) IS NOT NULL AS resolved, ord
  FROM raw LEFT JOIN pages p ON p.id = written LEFT JOIN aliases a ON a.key = trim(regexp_replace(lower(written), '[^a-z0-9]+', '-', 'g'), '-')),
edges AS (SELECT src, target, type, strength, arg_min(semantic, ord) AS semantic, bool_or(resolved) AS resolved, min(ord) AS ord FROM declared GROUP BY ALL)"""
COMPANY = COMPANY.replace("min(ord) AS ord FROM declared GROUP BY ALL", "min(ord) AS ord FROM declared GROUP BY src, target, type, strength")

VECTORS = "vectors AS (SELECT 'part-' || vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'old' ELSE 'h-' || vec_id END AS content_hash, embedding::DOUBLE[] AS embedding, vec_id FROM embeddings)"


def score(v: str, q: str) -> str:
    """Class score of a value for a query (SQL expressions; the query is in lower case)."""
    v = f"lower({v})"
    return f"CASE WHEN {v} = {q} THEN 1.0::DOUBLE WHEN starts_with({v}, {q}) THEN 0.8::DOUBLE WHEN contains({v}, {q}) THEN 0.5::DOUBLE WHEN abs(strlen({v}) - strlen({q})) <= 2 AND levenshtein({v}, {q}) <= 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"


def best(items: str, q: str) -> str:
    return f"coalesce(list_max(list_transform({items}, lambda x: {score('x', q)})), 0.0::DOUBLE)"


FIELDS = {"title": "[title]", "entity-name": "names", "alias": "aliases", "tag": "tags", "semantic-hint": "hints", "relationship-target": "targets", "body": r"list_filter(string_split_regex(lower(body), '\s+'), lambda w: w <> '')"}


def keyword(q: str) -> str:
    return " + ".join(f"{w}::DOUBLE * {best(FIELDS[f], q)}" for f, w in WEIGHTS.items())


#: The fixed time of the registered queries.
NOW = "2026-06-01 00:00:00"


def multiplier() -> str:
    days = f"greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(last_verified AS TIMESTAMP))) / 86400000000.0::DOUBLE, 0.0)"
    return f"CASE WHEN decay_rate = 0 THEN CASE WHEN confidence = 0 THEN 1.0 ELSE confidence END ELSE greatest(0.0, least(1.0, confidence * exp(-decay_rate * {days}))) END"


def slug(x: str) -> str:
    key = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"CASE WHEN {key} = '' THEN 'untitled' ELSE {key} END"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
