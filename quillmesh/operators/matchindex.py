"""Fuzzy matches of many queries with many values by equi-joins, without comparing all pairs.

A value that contains a query contains all of its grams (three characters; the whole query if it is
shorter), so it meets the query by the one gram that the fewest values hold. Strings within two edits of each other meet by

* a string that both become when up to two characters are deleted, for queries of up to SHORT
  characters, or
* one of three segments of the query, which stands in the value at the same place give or take two
  characters: two edits leave one of three segments as it was.

Whatever meets is verified by `match_code`, so the keys are hashes where they would be long.
A query or value is a lower-case string; nulls match nothing. A pair may come more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.matching import MAX_EDITS, match_code

GRAM = 3
#: Queries of up to so many characters meet by deletions, of which such a one has 56.
SHORT = 10


def _places(first: Column, last: Column, of) -> Column:
    """of(i) for first <= i <= last; empty if there is none."""
    return F.transform(F.filter(F.sequence(F.least(first, last), last), lambda i: i >= first), of)


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of these lengths; every text has the one of length 0."""

    def of(n: int) -> Column:
        return _places(F.lit(1), F.length(text) - n + 1, lambda i: F.substring(text, i, F.lit(n))) if n else F.array(F.lit(""))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _shorter(text: Column) -> Column:
    return _places(F.lit(1), F.length(text), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def deletions(text: Column) -> Column:
    """What is left of a text without up to two of its characters, as distinct hashes."""
    once = _shorter(text)
    return F.array_distinct(F.transform(F.concat(F.array(text), once, F.flatten(F.transform(once, _shorter))), lambda x: F.xxhash64(x)))


def _segment(size: Column, j: int) -> tuple[Column, Column]:
    """Start and length of the j-th of three segments of a text of this size."""
    edge = lambda k: F.floor(size * k / (MAX_EDITS + 1)).cast("int")
    return edge(j) + 1, edge(j + 1) - edge(j)


def segments(query: Column) -> Column:
    size = F.length(query)

    def one(j: int) -> Column:
        start, n = _segment(size, j)
        return F.xxhash64(size, F.lit(j), F.substring(query, start, n))

    return F.array(*map(one, range(MAX_EDITS + 1)))


def segment_probes(value: Column) -> Column:
    """The hashes of all segments that a query within two edits of the value may share with it."""

    def of(gap: int, j: int, shift: int) -> Column:
        size = F.length(value) + gap
        start, n = _segment(size, j)
        return F.when((start + shift >= 1) & (size > SHORT), F.xxhash64(size, F.lit(j), F.substring(value, start + shift, n)))

    span = range(-MAX_EDITS, MAX_EDITS + 1)
    return F.array_distinct(F.array_compact(F.array(*(of(g, j, s) for g in span for j in range(MAX_EDITS + 1) for s in span))))


def containing(values: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, q, value) of values that hold the query's rarest gram."""
    sizes = sorted(r[0] for r in queries.select(F.least(F.length("q"), F.lit(GRAM)).alias("n")).distinct().collect())  # at most four
    if not sizes:
        return queries.select("query_id", "q", F.lit("").alias("value")).limit(0)
    own = queries.select("query_id", "q", F.explode(F.when(F.length("q") >= GRAM, grams(F.col("q"), [GRAM])).otherwise(F.array("q"))).alias("gram"))
    held = values.select("value", F.explode(grams(F.col("value"), sizes)).alias("gram"))
    common = held.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no value holds has no count: its query is contained in nothing.
    rarest = own.join(common, "gram", "left").groupBy("query_id", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, "gram").select("query_id", "q", "value")


def within_two_edits(values: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, q, value) of values that share a deletion or a segment with the query."""
    short, long = queries.where(F.length("q") <= SHORT), queries.where(F.length("q") > SHORT)
    near = lambda df, key: df.select("query_id", "q", F.explode(key).alias("key"))
    by_deletion = values.where(F.length("value") <= SHORT + MAX_EDITS).select("value", F.explode(deletions(F.col("value"))).alias("key"))
    by_segment = values.where(F.length("value") > SHORT - MAX_EDITS).select("value", F.explode(segment_probes(F.col("value"))).alias("key"))
    met = [near(short, deletions(F.col("q"))).join(by_deletion, "key"), near(long, segments(F.col("q"))).join(by_segment, "key")]
    return reduce(DataFrame.unionByName, (m.select("query_id", "q", "value") for m in met))


def value_matches(values: DataFrame, queries: DataFrame) -> DataFrame:
    """values: (value), distinct; queries: (query_id, q). query_id, value, code of every match."""
    met = containing(values, queries).unionByName(within_two_edits(values, queries))
    return met.select("query_id", "value", match_code(F.col("q"), F.col("value")).alias("code")).where("code IS NOT NULL")
