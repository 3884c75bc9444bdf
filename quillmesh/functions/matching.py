"""Fuzzy matching: exact, prefix, contained and within two edits.

Matches are compared as codes, 0 for the best class, so that each value is looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of each class of match, best first.
SCORES = {"exact": 1.0, "prefix": 0.8, "contains": 0.5, "fuzzy": 0.3}
MAX_EDITS = 2


def near(query: Column, value: Column) -> Column:
    """At most two edits; a larger gap in bytes rules it out at once."""
    gap = F.abs(F.octet_length(query) - F.octet_length(value))
    short = (F.length(query) == 0) | (F.length(value) == 0)
    return (gap <= MAX_EDITS) & (short | F.levenshtein(query, value, MAX_EDITS).between(0, MAX_EDITS))


def match_code(query: Column, value: Column) -> Column:
    """Place in SCORES of the best match of a lower-case query in a lower-case value; null if none."""
    return F.when(value == query, 0).when(value.startswith(query), 1).when(value.contains(query), 2).when(near(query, value), 3)


def match_type(query: Column, value: Column) -> Column:
    """Class of the best match of a lower-case query in a value; null if none."""
    return code_type(match_code(query, F.lower(value)))


def code_type(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, SCORES)), code)


def code_score(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SCORES.values())), code), F.lit(0.0))


def type_score(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(s)) for k, s in SCORES.items()), F.lit(0.0))


def best_match(query: Column, values: Column) -> Column:
    """struct(code, place, value) of the first value of the highest class; null if none matches."""
    coded = F.transform(values, lambda v, i: F.struct(match_code(query, F.lower(v)).alias("code"), i.alias("place"), v.alias("value")))
    return F.array_min(F.filter(coded, lambda m: m["code"].isNotNull()))


def best_of(query: Column, values: Column) -> Column:
    """struct(value, type) of the first value of the highest class; null if none matches."""
    found = best_match(query, values)
    return F.when(found.isNotNull(), F.struct(found["value"].alias("value"), code_type(found["code"]).alias("type")))


def distinct_words(body: Column) -> Column:
    """The distinct lower-case words in order of first use."""
    return F.array_distinct(F.filter(F.split(F.lower(body), r"(?U)\s+"), lambda w: w != ""))


def best_word(query: Column, body: Column) -> Column:
    """best_of over the body's distinct words."""
    return best_of(query, distinct_words(body))
