"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is an item's run of `n` consecutive words (all words of a shorter item). As a set it
holds its shingles of `k` words with their offsets; a text holds the window exactly if it holds
all of them at consecutive places. Full containment needs every shingle, so the necessary
prefix is the single rarest one, by its count over the documents. A first pass over the texts'
words counts the benchmark's shingles, of which only the counts are kept. In a second one the
rarest shingle of each window alone gives candidates; they pass the length and positional bounds
(the window lies inside the text) and are verified by the words at their place: strings, not hashes.

The benchmark's shingles, and then the rarest ones, are broadcast if the former are BROADCAST_ROWS
at most; beyond, the joins shuffle. Results are keyed by the text's SHA-256.

Null and empty texts have no words and are clean; null, empty or wordless items have no
windows. A null item_id can't be named and is left out. Repeated items count once; repeated
documents give repeated rows. Texts of any length are read whole. Without documents there are no
rows, without items nothing is contaminated. Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import written

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A row is a shingle of at most three words; a hundred thousand take some tens of MB at most.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    """The lower-cased words (A-Z only) of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN_WORDS), "")


def shingles(words: Column, size: Column, k: int) -> Column:
    """All runs of k words, space-joined, in order; none if there are fewer."""
    one = lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(k)))
    return F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), one)).otherwise(F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """item_id, window (space-joined words), words, size."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("words"))
    return cut.select("item_id", F.concat_ws(" ", "words").alias("window"), "words", F.size("words").alias("size")).distinct()


def digest_of(text: Column) -> Column:
    """What tells texts apart; null and empty ones are one text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def places(source: DataFrame, k: int) -> DataFrame:
    """source (with n_words and the words w) and for each run of k words its pos and shingle.

    The words are exploded and not the runs: a shingle is then put together in compiled code, and w
    is at hand for what follows in the same stage.
    """
    run = F.concat_ws(" ", *(F.get("w", F.col("pos") + j) for j in range(k)))
    return source.select("*", F.posexplode("w").alias("pos", "word")).drop("word").where(F.col("pos") <= F.col("n_words") - k).withColumn("shingle", run)


def occurrences(source: DataFrame, rarest: DataFrame, k: int, small: bool) -> DataFrame:
    """digest, window, size, start: where the texts of source hold a window, from the places of its rarest shingle (k words)."""
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    held = F.concat_ws(" ", F.slice("w", F.col("start") + 1, F.col("size"))) == F.col("window")
    if small:
        near = places(source, k).join(F.broadcast(rarest), "shingle").where(inside).withColumn("start", start)
        return near.where(held).select("digest", "window", "size", "start").distinct()
    # Many windows: places meet them in a shuffle without the words, which come back by the text's digest.
    met = places(source, k).select("digest", "n_words", "pos", "shingle").join(rarest, "shingle").where(inside)
    near = met.select("digest", "window", "size", start.alias("start")).distinct()
    return near.join(source.select("digest", "w"), "digest").where(held).select("digest", "window", "size", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, digest (SHA-256 of the text) of every row."""
    windows = written(windows_of(benchmark, n, item_id, item_text))
    kinds = windows.select("window", "words", "size").distinct()
    # The shingles of each window with their offsets; a window shorter than k is one shingle.
    parts = reduce(DataFrame.union, [kinds.where((F.col("size") == j) if j < k else (F.col("size") >= k)).select("window", "size", F.lit(j).alias("k"), F.posexplode(shingles(F.col("words"), F.col("size"), j)).alias("off", "shingle")) for j in range(1, k + 1)])
    parts = written(parts)
    lengths = sorted(r["k"] for r in parts.select("k").distinct().collect())  # at most k values
    # Texts are cut into words once.
    source = written(docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias("digest"), words_of(F.col(text)).alias("w")).withColumn("n_words", F.size("w").cast("int")))
    if lengths:
        wanted = parts.select("k", "shingle").distinct()
        small = wanted.count() <= broadcast_rows
        mine = {j: wanted.where(F.col("k") == j).select("shingle") for j in lengths}
        # Only counts are kept of the places of all shingles.
        count = F.count(F.lit(1)).alias("n_seen")
        counted = [places(source, j).join(F.broadcast(mine[j]), "shingle").groupBy("shingle").agg(count) if small else places(source, j).groupBy("shingle").agg(count).join(mine[j], "shingle") for j in lengths]
        rarity = written(reduce(DataFrame.union, counted))
        # A window with a shingle that no document has can't occur.
        ranked = parts.join(rarity, "shingle", "left").groupBy("window", "size", "k").agg(F.min(F.struct(F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "shingle", "off")).alias("r"))
        rarest = written(ranked.where("r.n_seen > 0").select("window", "size", "k", "r.shingle", "r.off"))
        small = small and rarest.count() <= broadcast_rows
        hits = written(reduce(DataFrame.union, [occurrences(source, rarest.where(F.col("k") == j).drop("k"), j, small) for j in lengths]))
        n_hit = hits.select("digest", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_hit"))
        items = hits.select("digest", "window").distinct().join(windows.select("window", "item_id"), "window").groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        held = n_hit.join(items, "digest")
    else:
        held = docs.sparkSession.createDataFrame([], "digest string, n_hit long, items array<string>")
    joined = source.select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words")).join(held, "digest", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "digest")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs without any item's window, with all their columns."""
    bad = contamination(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark, **options).where("contaminated").select("digest").distinct()
    return docs.join(bad, digest_of(docs[text]) == bad["digest"], "left_anti")
