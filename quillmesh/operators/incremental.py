"""A graph kept as tables that an update changes where it must.

Tables of a version: pages (with ids), claims, owners (the lowest page of each key) and declared
(resolved edges). An update takes changed pages and the paths of removed ones and works out

* which slugs lost or gained a page or an explicit id: only pages of those get their ids anew,
* which keys and ids lost or gained a claim: only their owners are recomputed,
* which texts name such a key or id, or are new: only they are resolved again, each once for all edges.

All else is copied without a shuffle, as what has changed is written first and is small enough to be broadcast where
its size on disk says so. What follows from a table reads it as the version holds it. A version is read once its last
table is whole, so an update that fails leaves the one before.

Pages are told apart by source_path; of several changed pages with one path that with the greatest
content stays. Pages without a path are left out. An update without changes makes no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.graph import DECLARED, KnowledgeGraph, claims_of, derived_slug, edges_of, named_by, resolved, targets, with_derived, with_given, with_ids
from quillmesh.schema import conform
from quillmesh.sources.shared import written
from quillmesh.sources.versions import Versions

PATH = "source_path"
TABLES = ("pages", "claims", "owners", "declared")


def _slugged(pages: DataFrame, root: str) -> DataFrame:
    return pages.withColumn("slug", F.when(F.col("id_derived"), derived_slug(root)))


def _owners(claims: DataFrame) -> DataFrame:
    return claims.groupBy("key").agg(F.min("page_id").alias("page_id"))


class GraphTables:
    def __init__(self, spark: SparkSession, path: str, root: str = ""):
        self.spark, self.root, self.versions = spark, root, Versions(spark, path, TABLES)

    def graph(self) -> KnowledgeGraph:
        """The newest version; what it holds is read and not worked out again."""
        return self._graph(self.versions.read())

    def _graph(self, held: dict[str, DataFrame]) -> KnowledgeGraph:
        graph = KnowledgeGraph(held["pages"].drop("slug"))
        graph.__dict__["claims"] = held["claims"].select("key", "page_id").distinct()
        graph.__dict__["declared"] = held["declared"].select(*DECLARED)
        return graph

    def build(self, pages: DataFrame) -> KnowledgeGraph:
        n, new = self.versions.begin(), {}
        put = lambda table, df: new.setdefault(table, self.versions.put(n, table, df))
        named = put("pages", _slugged(with_ids(written(_one_each(pages)), self.root), self.root))
        claims = put("claims", claims_of(named, PATH))
        owners = put("owners", _owners(claims))
        put("declared", resolved(written(edges_of(named, PATH)), claims.select(F.col("page_id").alias("id")), owners))
        self.versions.finish()
        return self._graph(new)

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> KnowledgeGraph:
        """changed: pages that are new or have another content; removed: (source_path)."""
        if not self.versions.current():
            return self.build(changed)
        held, fresh = self.versions.read(), written(_one_each(changed))
        paths = fresh.select(PATH)
        paths = written(paths if removed is None else paths.union(removed.where(F.col(PATH).isNotNull()).select(PATH)))
        if paths.isEmpty():
            return self._graph(held)
        n, new, pages = self.versions.begin(), {}, held["pages"]
        put = lambda table, df: new.setdefault(table, self.versions.put(n, table, df))
        gone, stay = pages.join(paths, PATH, "left_semi"), pages.join(paths, PATH, "left_anti")

        # Identity. An explicit id can be in the way of a slug, or of a slug with a path's hash.
        ways = F.array(F.col("id"), F.regexp_replace("id", "-[0-9a-f]{8}$", ""))
        slugs = gone.select(F.explode(F.when(F.col("id_derived"), F.array("slug")).otherwise(ways)).alias("slug")).union(fresh.select(F.explode(F.when(F.col("id") == "", F.array(derived_slug(self.root))).otherwise(ways))))
        behind = stay.where("id_derived")
        mates = behind.limit(0) if pages.where("id_derived").isEmpty() else written(behind.join(slugs, "slug", "left_semi"))
        plain = mates.withColumn("id", F.lit("")).select(*fresh.columns)
        given = with_given(fresh)
        derived = with_derived(fresh.where("id = ''").unionByName(plain), given.select("id").union(stay.where("NOT id_derived").select("id")), self.root)
        was = mates.select(PATH, F.col("id").alias("__was"))
        derived = written(_slugged(derived, self.root).join(was, PATH, "left").where("__was IS NULL OR __was <> id").drop("__was"))
        named, moved = _slugged(given, self.root).unionByName(derived), written(paths.union(derived.select(PATH)))
        put("pages", pages.join(moved, PATH, "left_anti").unionByName(named))

        # Names. Keys and ids that lose or gain a claim may resolve otherwise.
        lost, won = written(held["claims"].join(moved, PATH, "left_semi")), written(claims_of(named, PATH))
        touched = lost.select("key", "page_id").union(won.select("key", "page_id"))
        claims = put("claims", held["claims"].join(moved, PATH, "left_anti").unionByName(won))
        keys = touched.select("key")
        owners = put("owners", held["owners"].join(keys, "key", "left_anti").unionByName(_owners(claims.join(keys, "key", "left_semi"))))

        # Edges of moved pages, and texts that name what was touched: a page's id is one of its keys, but for an id without letters and digits.
        edges = held["declared"].join(moved, PATH, "left_anti").select(*DECLARED, PATH)
        fresh_edges = written(edges_of(named, PATH))
        bare = touched.where(~F.lower("page_id").rlike("[a-z0-9]")).select(F.concat(F.lit("="), "page_id"))
        name = F.when(F.col("key") == "", F.concat(F.lit("="), "written")).otherwise(F.col("key"))
        again = named_by(edges).withColumn("name", name).join(keys.union(bare).toDF("name"), "name", "left_semi")
        names = written(again.select("written", "key").union(named_by(fresh_edges)).distinct())
        found = written(targets(names, claims.select(F.col("page_id").alias("id")), owners))
        now = found.select("written", F.col("target").alias("__target"), F.col("resolved").alias("__resolved"))
        edges = edges.join(now, "written", "left").withColumns({"target": F.coalesce("__target", "target"), "resolved": F.coalesce("__resolved", "resolved")}).drop("__target", "__resolved")
        put("declared", edges.unionByName(fresh_edges.join(found, "written")))
        self.versions.finish()
        return self._graph(new)


def _one_each(pages: DataFrame) -> DataFrame:
    pages = conform(pages).where(F.col(PATH) != "")
    rest = [c for c in pages.columns if c != PATH]
    return pages.groupBy(PATH).agg(F.max(F.struct(*rest)).alias("p")).select(*(F.col(PATH) if c == PATH else F.col(f"p.{c}").alias(c) for c in pages.columns))
