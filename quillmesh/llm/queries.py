"""The corpus queries: one for each operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import shared_dir, table


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmesh.llm.bitplanes import SHARDS, read_documents, write_shards

    path = shared_dir(spark)
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_documents(spark.read.schema(SHARDS).parquet(path))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


def op3_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.fm_index import word_dedup

    return word_dedup(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.secrets import scan

    # Two versions of the corpus, first its English part and then all of it: the second scan reads
    # only blobs that the ledger lacks, and every row gets its findings from either.
    documents, ledger = table(spark, sf_dir, "documents"), shared_dir(spark)
    scan(documents.where(F.col("lang") == "en"), ledger, path="doc_id", label="first")
    found = scan(documents, ledger, path="doc_id", label="second")
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "blob", "scan")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.repetition import repetition_stats

    return repetition_stats(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.pseudonyms import pseudonyms

    return pseudonyms(table(spark, sf_dir, "documents"), key="the key of this query")


def op8_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.ctw import scores

    return scores(table(spark, sf_dir, "documents"))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.mixing import draws

    return draws(table(spark, sf_dir, "documents"), max_repeats=2.0)


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.suffixes import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op11_kd_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.kmeans import clusters

    return clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, salt="3")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), most=8)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmesh.llm.token_counts import count_tokens

    # Two versions of the corpus, first its English part and then all of it: the second run encodes
    # only texts that the cache lacks, and every row gets its count from either.
    documents, cache, tokenizer = table(spark, sf_dir, "documents"), shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json")
    count_tokens(documents.where(F.col("lang") == "en"), cache, tokenizer, run="first")
    return count_tokens(documents, cache, tokenizer, run="second")


QUERIES = {f.__name__: f for f in (op1_bitplane_ids, op2_decontaminate, op3_fm_dedup, op4_blob_ledger, op5_repetition, op6_simhash, op7_pseudonyms, op8_ctw_scores, op9_temperature_mix, op10_suffix_arrays, op11_kd_kmeans, op12_whitening, op13_token_counts)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM win))),
hits AS (SELECT doc_id, s, size, item_id FROM dw JOIN win USING (win, size)), p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS q FROM hits) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
first AS (SELECT win, min(doc_id) AS low FROM win GROUP BY 1), gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest(range(s, s + 13)) AS q FROM win JOIN first USING (win) WHERE low < doc_id) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i)), ' ') END) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""


def _op5() -> str:
    from quillmesh.llm.repetition import LIMITS, MAX_DUP_LINE_CHARS, MAX_REPEAT_WORDS_PCT, MIN_WORDS

    parts, joins = [], []
    for k in LIMITS:
        parts.append(f"g{k} AS (SELECT doc_id, list(s) AS ss FROM (SELECT doc_id, s, array_to_string(w[s:s + {k - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS s FROM d)) GROUP BY doc_id, win HAVING count(*) > 1), c{k} AS (SELECT doc_id, count(*) AS words, sum(length(w[q])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(s, s + {k})) AS q FROM (SELECT doc_id, unnest(ss) AS s FROM g{k})) JOIN d USING (doc_id) GROUP BY 1)")
        joins.append(f"LEFT JOIN c{k} USING (doc_id)")
    told = ", ".join(f"coalesce(c{k}.chars, 0)::BIGINT AS dup_chars_{k}" for k in LIMITS)
    verdict = " AND ".join(f"dup_chars_{k} <= {share} * word_chars" for k, share in LIMITS.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents), {", ".join(parts)},
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS dup_line_chars FROM lines WHERE r > 1 GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c5.words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {told} FROM d LEFT JOIN dup USING (doc_id) {" ".join(joins)}),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS_PCT} * n_words AS base_failed FROM m) SELECT *, NOT base_failed AND dup_line_chars <= {MAX_DUP_LINE_CHARS} * word_chars AND {verdict} AS kept FROM f""".replace("\\\\", "\\")


def _op11(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """A chain of rounds: near gives each vector its nearest centroid, means each centroid its floor of sum / count."""
    off = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda r: f"SELECT v.n, v.vec_id, min({{'d': {off}::BIGINT, 'c': c.c}}) AS best FROM v, c{r} c GROUP BY 1, 2"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, q) - 1)::INTEGER AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(f"n{r} AS MATERIALIZED ({near(r)})")
        parts.append(f"m{r} AS (SELECT c, i, (s - (s % n + n) % n) // n AS x FROM (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT n{r}.best, unnest(v.q) AS x, unnest(range({dims})) AS i FROM n{r} JOIN v USING (n)) GROUP BY 1, 2))")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, c{r}.q) AS q FROM c{r} LEFT JOIN (SELECT c, list(x::BIGINT ORDER BY i) AS q FROM m{r} GROUP BY 1) m USING (c))")
    return f"""WITH {", ".join(parts)}, f AS MATERIALIZED ({near(rounds)}) SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON best.c = c"""


#: The other operators hash, encode, search by position or iterate beyond SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": _OP2, "op3_fm_dedup": _OP3, "op5_repetition": _op5(), "op11_kd_kmeans": _op11()}
