"""Ordered set operations on arrays: the first of equal keys stays, in its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = Callable[[Column], Column]


def _same(x: Column) -> Column:
    return x


def _bound(value: Column, use: Key) -> Column:
    """use(value), with value bound as an element, so that it is made once."""
    return F.transform(F.array(value), use)[0]


def distinct_by(items: Column, key: Key) -> Column:
    """An item stays if its key's first place in the array is its own; items whose key is null go. Sorts, so long arrays may come."""

    def first_places(placed: Column) -> Column:
        heads = F.filter(placed, lambda s, i: (i == 0) | ~F.get(placed, i - 1)["key"].eqNullSafe(s["key"]))
        return F.array_sort(F.transform(F.filter(heads, lambda s: s["key"].isNotNull()), lambda s: s["place"]))

    def kept(held: Column) -> Column:
        placed = F.array_sort(F.transform(held, lambda x, i: F.struct(key(x).alias("key"), i.alias("place"))))
        return F.transform(_bound(placed, first_places), lambda i: F.get(held, i))

    return _bound(items, kept)


def union_by(a: Column, b: Column, key: Key) -> Column:
    return distinct_by(F.concat(a, b), key)


def edge_key(r: Column) -> Column:
    return F.struct(r["target"], r["type"])


def folded_edge_key(r: Column) -> Column:
    return F.concat(F.lower(r["target"]), F.lit("|"), F.lower(r["type"]))


def entity_key(e: Column) -> Column:
    return F.lower(e["name"])


def entity_role_key(e: Column) -> Column:
    return F.concat(F.lower(e["name"]), F.lit("|"), F.lower(e["role"]))


def distinct_strings(a: Column) -> Column:
    return distinct_by(a, F.lower)


def union_strings(a: Column, b: Column) -> Column:
    return union_by(a, b, F.lower)


def distinct_edges(a: Column) -> Column:
    return distinct_by(a, edge_key)


def union_edges(a: Column, b: Column) -> Column:
    return union_by(a, b, edge_key)


def distinct_entities(a: Column) -> Column:
    return distinct_by(a, entity_key)


def union_entities(a: Column, b: Column) -> Column:
    return union_by(a, b, entity_key)


def without(a: Column, b: Column, key: Key = _same) -> Column:
    """Items of a whose key no item of b has."""
    keys = F.transform(b, key)
    return F.filter(a, lambda x: ~F.array_contains(keys, key(x)))


def last_by(items: Column, key: Key, wanted: Column) -> Column:
    """The last item with that key, or null."""
    return F.try_element_at(F.filter(items, lambda y: key(y) == wanted), F.lit(-1))


def modified(before: Column, after: Column, key: Key, body: Key) -> Column:
    """Items of after whose key before has with another body; of equal keys in before the last counts."""
    held = F.transform(before, key)
    return F.filter(after, lambda x: F.array_contains(held, key(x)) & (body(last_by(before, key, key(x))) != body(x)))
