"""Validation rules: each gives an array of issues, and a page's issues are all of them in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.schema import ISSUE

Rule = Callable[[], Column]
#: Fixed value: which strings count as dates.
DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"


def issue(field: Column, message: Column, fix: str) -> Column:
    return F.struct(field.alias("field"), message.alias("message"), F.lit(fix).alias("fix"))


def only(*checks: tuple[Column, Column]) -> Column:
    """The issues of the checks that hold."""
    return F.array_compact(F.array(*(F.when(bad, found) for bad, found in checks))).cast(f"array<{ISSUE.simpleString()}>")


def number(x: Column) -> Column:
    """A double in its shortest form: 1 and not 1.0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def required_fields() -> Column:
    names = (("id", "id"), ("title", "title"), ("entity_type", "entity-type"))
    return only(*((F.col(c) == "", issue(F.lit(n), F.lit(f"the page has no {n}"), f"give the page's header a {n}")) for c, n in names))


def confidence_range() -> Column:
    c = F.col("confidence")
    return only(((c < 0) | (c > 1), issue(F.lit("confidence"), F.concat(F.lit("a confidence lies between 0 and 1, not at "), number(c)), "choose a share from 0 to 1")))


def relationships() -> Column:
    def of(r: Column, i: Column) -> Column:
        at = lambda part: F.concat(F.lit("relationships["), i.cast("string"), F.lit(f"].{part}"))
        missing = [(r[p] == "", issue(at(p), F.lit(f"this edge has no {p}"), f"name the edge's {p} or drop the edge")) for p in ("target", "type")]
        s = r["strength"]
        return only(*missing, ((s < 0) | (s > 1), issue(at("strength"), F.concat(F.lit("an edge's strength lies between 0 and 1, not at "), number(s)), "choose a share from 0 to 1")))

    return F.flatten(F.transform("relationships", of))


def temporal_dates() -> Column:
    def of(column: str) -> tuple[Column, Column]:
        name, value = column.replace("_", "-"), F.col(f"temporal.{column}")
        return (value != "") & ~value.rlike(DATE), issue(F.lit(f"temporal.{name}"), F.concat(F.lit("no date (year-month-day): "), value), "write the day like 2024-01-31, or nothing")

    return only(*map(of, ("valid_from", "valid_until", "last_verified")))


def entity_names() -> Column:
    of = lambda e, i: only((e["name"] == "", issue(F.concat(F.lit("entities["), i.cast("string"), F.lit("].name")), F.lit("this entity has no name"), "name the entity or drop it")))
    return F.flatten(F.transform("entities", of))


def decay_rate() -> Column:
    r = F.col("temporal.decay_rate")
    return only((r < 0, issue(F.lit("temporal.decay-rate"), F.concat(F.lit("a rate of decay is not below 0: "), number(r)), "use 0 for what does not age")))


RULES: list[Rule] = [required_fields, confidence_range, relationships, temporal_dates, entity_names, decay_rate]


def validated(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """pages with a column `issues`."""
    return pages.withColumn("issues", F.concat(*(rule() for rule in rules or RULES)))


def issues(pages: DataFrame) -> DataFrame:
    """id, source_path, n, field, message, fix of every issue."""
    return validated(pages).select("id", "source_path", F.posexplode("issues").alias("n", "i")).select("id", "source_path", "n", "i.*")


def check_totals(pages: DataFrame) -> DataFrame:
    """pages, errors, and pages with errors."""
    n = F.size("issues")
    return validated(pages).agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(n), F.lit(0)).alias("errors"), F.count_if(n > 0).alias("files"))
