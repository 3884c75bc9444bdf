"""Functions against tables of cases, in one Spark job each."""

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import collections as C
from quillmesh.functions import matching as M
from quillmesh.functions import temporal as T
from quillmesh.functions import text as X
from quillmesh.functions import vectors as V


def evaluate(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_match_type(spark):
    cases = [("ring", "Ring", "exact"), ("ring", "Rings", "prefix"), ("ring", "string", "contains"), ("ring", "rung", "fuzzy"), ("ring", "rug", "fuzzy"), ("ring", "wrought", None), ("ring", "", None), ("ab", "", "fuzzy"), ("", "anything", "prefix"), ("", "", "exact"), ("日本", "日", None)]
    assert evaluate(spark, [c[:2] for c in cases], "q string, v string", M.match_type(F.col("q"), F.col("v"))) == [c[2] for c in cases]


def test_best_of(spark):
    cases = [(["rung", "Ring x", "RING", "ring"], ("RING", "exact")), (["xx", "rang", "rung"], ("rang", "fuzzy")), (["nothing-like"], None), ([], None)]
    got = evaluate(spark, [(c[0],) for c in cases], "v array<string>", M.best_of(F.lit("ring"), F.col("v")))
    assert [g and tuple(g) for g in got] == [c[1] for c in cases]


def test_decay(spark):
    cases = [(0.9, 0.0, "2024-01-01", 0.9), (1.5, 0.0, "2024-01-01", 1.0), (1.0, 0.1, "2024-01-11", 1.0), (1.0, 0.1, "2024-01-01", 0.36787944117144233), (-1.0, 0.0, "", 0.0), (0.8, 0.1, "", 0.8), (0.8, 0.1, "2024-02-30", 0.8), (0.8, 0.1, "2024-1-3", 0.8)]
    now = F.lit("2024-01-11").cast("timestamp")
    got = evaluate(spark, [c[:3] for c in cases], "b double, r double, d string", T.decayed(F.col("b"), F.col("r"), T.strict_date(F.col("d")), now))
    assert got == pytest.approx([c[3] for c in cases])


def test_multiplier_keeps_the_plain_confidence(spark):
    cases = [(0.0, 0.0, "", 1.0), (1.7, 0.0, "", 1.7), (0.0, 0.1, "2024-01-01", 0.0), (0.0, 0.1, "nope", 1.0)]
    got = evaluate(spark, [c[:3] for c in cases], "c double, r double, d string", T.multiplier(F.col("c"), F.col("r"), F.col("d"), F.lit("2024-01-11").cast("timestamp")))
    assert got == pytest.approx([c[3] for c in cases])


def test_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    assert evaluate(spark, [c[:2] for c in cases], "a array<float>, b array<float>", V.cosine(F.col("a"), F.col("b"))) == pytest.approx([c[2] for c in cases])


def test_text(spark):
    code = "a\n```py\n# no [[x]]\n```\nb `[[c]]` and ` tail"
    cases = {
        "  Neo4j Graph! ": (X.reconcile_key, "neo4j-graph"), "日本": (X.slugify, "untitled"), "a/b/My-File.tar.md": (X.stem, "My-File.tar"), code: (X.strip_code, "a\nb  and  tail\n"), "x\n## Related\n\n- y": (X.strip_related, "x"),
        "one two  three": (lambda c: X.body_preview(c, 2), "one two"), "one  two": (lambda c: X.body_preview(c, 2), "one  two"), "a\nb": (X.one_line, "a b"), "```json\n{}\n```": (X.strip_fence, "{}"), "error raw: {x}": (X.raw_of_error, "{x}"),
    }
    for text, (f, want) in cases.items():
        assert evaluate(spark, [(text,)], "t string", f(F.col("t"))) == [want], text


def test_extraction(spark):
    body = "intro\n#  A Title \nSee [[Graph DB]], [[graph db]] and [[a|b]] #One #two #ONE\n```\n#three [[four]]\n```\nhttps://x.org/a. (http://y.org)"
    pick = F.struct(X.extract_title(F.col("t"), F.lit("my-file")), X.extract_hashtags(F.col("t")), X.extract_wikilinks(F.col("t"))["target"], X.extract_urls(F.col("t")))
    (got,) = evaluate(spark, [(body,)], "t string", pick)
    assert tuple(got) == ("A Title", ["one", "two"], ["graph-db", "a-b"], ["https://x.org/a", "http://y.org"])
    (got,) = evaluate(spark, [("no heading",)], "t string", X.extract_title(F.col("t"), F.lit("my-file_x")))
    assert got == "my file x"


def test_ordered_sets(spark):
    a, b = F.col("a"), F.col("b")
    row = [(["A", "b", "a"], ["B", "c", "C"])]
    schema = "a array<string>, b array<string>"
    assert evaluate(spark, row, schema, C.union_strings(a, b)) == [["A", "b", "c"]]
    assert evaluate(spark, row, schema, C.distinct_strings(a)) == [["A", "b"]]
    assert evaluate(spark, row, schema, C.without(b, a, F.lower)) == [["c", "C"]]
    assert evaluate(spark, [([], [])], schema, C.union_strings(a, b)) == [[]]


def test_distinct_by_long_arrays_and_null_keys(spark):
    """The first of equal keys stays in its place; a null key goes; 50,000 items take no square of steps."""
    import time

    rows = spark.createDataFrame([(["b", "A", "a", None, "B", "c"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in rows.select(C.distinct_strings(F.col("x"))).collect()] == [["b", "A", "c"], [], None]
    long = spark.createDataFrame([([f"k{i % 40_000}" for i in range(50_000)],)], "x array<string>")
    began = time.time()
    assert long.select(F.size(C.distinct_strings(F.col("x")))).first()[0] == 40_000 and time.time() - began < 20


def test_exp_is_rounded_correctly(spark):
    from decimal import Decimal, localcontext

    from quillmesh.functions.exponential import exp

    xs = [-r * d for r in (0.001, 0.002, 0.0173) for d in range(1, 1400, 3)] + [i / 7 - 60 for i in range(800)] + [-699.99, 699.5, 0.0, -0.0, -1e-300, 2.0**-60]
    rows = spark.createDataFrame([(x,) for x in [*xs, None, float("-inf"), float("inf"), -745.0]], "x double").select("x", exp(F.col("x")).alias("y"), F.exp("x").alias("plain")).collect()
    with localcontext() as c:
        c.prec = 60
        right = {x: float(Decimal(x).exp()) for x in xs}
    off = [r["x"] for r in rows if r["x"] in right and r["y"] != right[r["x"]]]
    assert len(off) <= 2 and sum(r["plain"] != right[r["x"]] for r in rows if r["x"] in right) > 100
    assert all(r["y"] == r["plain"] for r in rows if r["x"] not in right)
