"""Token counts through the cache, against one call of the library for each text."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import token_counts
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, digest string, n_bytes long, n_tokens long, run string, tokenizer string"


def texts():
    r = random.Random(5)
    out = [" ".join(r.choice(["ab", "dé", "日本", "don't", "x", "1234", "\n", "  ", "🙂"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    out += [None, "", " ", "\x00", "a<|endoftext|>b <|endoftext|>", "word " * 1500, "a" * 30_000, "日" * 5000, out[0], out[0]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, "en" if i % 2 else "de", "d", 1, 2, "r", "t") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA).repartition(4)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_counts(spark, docs, tmp_path, monkeypatch, name, broadcast):
    monkeypatch.setattr(token_counts, "BROADCAST", broadcast)
    path = public_tokenizers.path(name)
    want = brute.op13(texts(), path)
    want = [(i if i % 9 else None, *w) for i, w in enumerate(want)]
    want += [want[3], want[3]]
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(docs.where("lang = 'en'"), cache, path, run="first")
    found = token_counts.count_tokens(docs, cache, path, run="second")
    assert sorted((tuple(r) for r in found.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == sorted(want, key=str)
    assert {r["run"] for r in found.select("run").collect()} == {"first", "second"}


def test_pieces_give_the_library_s_counts(monkeypatch):
    """Texts cut at white space, of all kinds and in all mixtures, beside special tokens and at both ends."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.by_pieces(path) and not token_counts.by_pieces(public_tokenizers.path("word_bpe_49k.json")) and not token_counts.by_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "don't", "'s", "'", "don", "é", "日本", "1", "12", "...", "<|endoftext|>", "<|endof", "text|>", "🙂", "\x00", "A", "_"]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    want = [n for _, n, _ in brute.op13(some, path)]
    assert token_counts.Counter(path).counts(some).tolist() == want
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    counter = token_counts.Counter(path)
    assert [n for t in range(0, 6000, 100) for n in counter.counts(some[t : t + 100]).tolist()] == want


def test_cache(spark, docs, tmp_path, monkeypatch):
    """Each distinct text is encoded once for a tokenizer; a repeated run encodes none; another tokenizer has rows of its own."""
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    distinct = len({t or "" for t in texts()})
    token_counts.count_tokens(docs, cache, path, run="a")
    assert spark.read.schema(token_counts.CACHE).parquet(cache).count() == distinct
    again = token_counts.count_tokens(docs, cache, path, run="b")
    assert spark.read.schema(token_counts.CACHE).parquet(cache).count() == distinct and {r["run"] for r in again.select("run").collect()} == {"a"}
    token_counts.count_tokens(docs, cache, public_tokenizers.path("word_bpe_49k.json"), run="c")
    held = spark.read.schema(token_counts.CACHE).parquet(cache)
    assert held.count() == 2 * distinct and held.select("tokenizer").distinct().count() == 2
    # A digest that two runs have appended is read once.
    held.where("run = 'a'").withColumn("run", F.lit("z")).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(docs, cache, path).count() == docs.count()


def test_normalised(spark, tmp_path):
    """A tokenizer that drops white space and case: texts that differ in those only share an entry."""
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    some = spark.createDataFrame([(1, "A  b\n"), (2, "a b"), (3, None)], "doc_id long, text string")
    found = token_counts.count_tokens(some, cache, path, normalise=F.lower(F.regexp_replace("text", r"\s+", " ")))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found.collect()) == [(1, 5, 2), (2, 3, 2), (3, 0, 0)]
    assert spark.read.schema(token_counts.CACHE).parquet(cache).count() == 3  # "a b ", "a b", ""


def test_empty(spark, tmp_path):
    found = token_counts.count_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json"))
    assert found.count() == 0 and found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "digest", "run"]
