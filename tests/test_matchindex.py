"""The match index against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.matching import match_code
from quillmesh.operators import matchindex
from quillmesh.operators.search import search_many
from quillmesh.schema import conform


def edited(r, text, n):
    for _ in range(n):
        i = r.randint(0, len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + r.choice("abé日-") + text[i:], text[:i] + "x" + text[i + 1 :]])
    return text


def strings():
    r = random.Random(9)
    words = ["ring", "widget", "brand#2", "promo", "shop3", "economy burnished", "größe", "日本語テスト", "a", "ab", "", "x" * 40, "supplier-17 of the northern region", "aaaaaaaaaaaa", "abcabcabcabc"]
    values = {edited(r, w, r.randint(0, 4)) for w in words for _ in range(25)} | set(words)
    queries = {edited(r, w, r.randint(0, 3)) for w in words for _ in range(8)} | set(words) | {w[1:4] for w in words}
    return sorted(values), sorted(queries)


@pytest.fixture(scope="module")
def frames(spark):
    values, queries = strings()
    return spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([*enumerate(queries), (-1, None)], "query_id long, q string")


@pytest.mark.parametrize(("short", "gram"), [(10, 3), (4, 2)])
def test_all_matches(frames, monkeypatch, short, gram):
    monkeypatch.setattr(matchindex, "SHORT", short)
    monkeypatch.setattr(matchindex, "GRAM", gram)
    values, queries = frames
    want = values.crossJoin(queries).select("query_id", "value", match_code(F.col("q"), F.col("value")).alias("code")).where("code IS NOT NULL")
    found = matchindex.value_matches(values, queries).distinct()
    rows = lambda df: sorted(map(tuple, df.select("query_id", "value", "code").collect()))
    assert rows(found) == rows(want) and {c for _, _, c in rows(want)} == {0, 1, 2, 3}


def test_plan_has_no_nested_loop(frames):
    plan = matchindex.value_matches(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_queries_and_no_values(spark, frames):
    values, queries = frames
    assert matchindex.value_matches(values.limit(0), queries).count() == 0 and matchindex.value_matches(values, queries.limit(0)).count() == 0


def test_queries_with_any_white_space(spark):
    page = conform(spark.createDataFrame([("p", "Golden ring", "a ring")], "id string, title string, body string"))
    asked = spark.createDataFrame([(1, "\tring\n"), (2, " "), (3, ""), (4, "nothing"), (5, None)], "query_id long, query string")
    found = search_many(page, asked, F.lit("2026-01-01").cast("timestamp"))
    assert sorted(r["query_id"] for r in found.collect()) == [1, 2]
