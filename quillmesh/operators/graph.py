"""Building and summarising the graph: identity, alias resolution, edges, statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import base_name, reconcile_key, stem
from quillmesh.sources.shared import written


#: Ids in a block of a posting list.
POSTINGS = 1024
#: Columns of resolved edges.
DECLARED = ["src", "written", "target", "type", "strength", "semantic", "resolved", "ord"]


def derived_slug(root: str) -> Column:
    """Slug of the path below root without its extension; of the file's name elsewhere; of the title without a path."""
    path, title = F.col("source_path"), F.col("title")
    prefix = root.rstrip("/") + "/"
    below = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(base_name(path)) if root else base_name(path)
    source = F.when(path == "", title).otherwise(below)
    key = reconcile_key(F.regexp_replace(source, r"\.[^./]*$", ""))
    return F.when(key == "", "untitled").otherwise(key)


def with_ids(pages: DataFrame, root: str = "", taken: DataFrame | None = None) -> DataFrame:
    """pages with an id in every row, and `id_derived`. taken: (id) of explicit ones elsewhere.

    Explicit ids come first. The pages without one take their slug in order of path; whoever
    finds it taken adds eight hex digits of the path's SHA-256, then a number.
    """
    given = with_given(pages)
    explicit = given.select("id")
    return given.unionByName(with_derived(pages.where("id = ''"), explicit if taken is None else explicit.union(taken.select("id")), root))


def with_given(pages: DataFrame) -> DataFrame:
    """Those of the pages that have an id, and `id_derived`."""
    return pages.where("id <> ''").withColumn("id_derived", F.lit(False))


def with_derived(pages: DataFrame, taken: DataFrame, root: str = "") -> DataFrame:
    """pages, none with an id, with a derived one and `id_derived`. taken: (id) of all explicit ones."""
    rest = written(pages.withColumns({"__slug": derived_slug(root), "__row": F.monotonically_increasing_id()}))
    if rest.isEmpty():
        return rest.limit(0).select(*pages.columns, F.lit(True).alias("id_derived"))
    explicit = taken.select(F.col("id").alias("__taken")).distinct()
    lowest = rest.groupBy("__slug").agg(F.min(F.struct("source_path", "title", "__row")).alias("f"))
    first = lowest.join(explicit, F.col("__slug") == F.col("__taken"), "left_anti").select("f.__row")
    plain = rest.join(first, "__row", "left_semi").withColumn("id", F.col("__slug"))
    late = rest.join(first, "__row", "left_anti").withColumn("__id", F.concat("__slug", F.lit("-"), F.substring(F.sha2("source_path", 256), 1, 8)))
    late = numbered(late, "__id", ["source_path", "title"], "__row")
    # Ids are numbered from 2 on where an explicit one is in the way.
    late = late.join(explicit, late["__id"] == explicit["__taken"], "left").withColumn("n", F.col("n") + F.col("__taken").isNotNull().cast("int"))
    late = late.withColumn("id", F.when(F.col("n") > 1, F.concat_ws("-", "__id", F.col("n").cast("string"))).otherwise(F.col("__id")))
    return plain.select(*pages.columns).unionByName(late.select(*pages.columns)).withColumn("id_derived", F.lit(True))


def numbered(rows: DataFrame, key: str, order: list[str], row: str) -> DataFrame:
    """rows with n, their number from 1 on within the key in this order; `row` tells equal ones apart.

    No task holds a key: rows are sorted by range, so a frequent key lies in several parts, and are
    numbered in each part; a part's first number comes from the counts of the parts before it.
    """
    cut = written(rows.repartitionByRange(key, *order, row).withColumn("__part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__part", key).orderBy(*order, row))
    before = F.sum("count").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = cut.groupBy(key, "__part").count().select(key, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return cut.withColumn("__inside", inside).join(parts, [key, "__part"]).withColumn("n", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def postings(pairs: DataFrame, key: str, item: str, size: int = POSTINGS) -> DataFrame:
    """(key, block, first, last, n, items): the items of each key in ascending order, `size` to a block.

    Blocks of a key follow each other, so an item is in at most one whose first and last enclose it
    (equal items may run on into the next). A frequent key has many rows and is in no task as a whole.
    """
    placed = numbered(pairs.select(key, item).withColumn("__row", F.monotonically_increasing_id()), key, [item], "__row")
    block = F.floor((F.col("n") - 1) / size).cast("long")
    held = placed.groupBy(key, block.alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return held.select(key, "block", F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"), F.size("items").alias("n"), "items")


def common_items(blocks: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(item) of those that all keys have, from posting blocks.

    The rarest key's blocks stand for it; blocks of the others that no such block overlaps are not opened.
    """
    mine = blocks.where(F.col(key).isin(keys))
    sizes = {r[0]: r[1] for r in mine.groupBy(key).agg(F.sum("n").alias("n")).collect()}
    if not keys or set(sizes) != set(keys):
        return blocks.select(F.explode("items").alias("item")).limit(0)
    rarest, *others = sorted(set(keys), key=lambda k: (sizes[k], k))
    base = mine.where(F.col(key) == rarest)
    found, ends = base.select(F.explode("items").alias("item")).distinct(), base.agg(F.min("first").alias("a"), F.max("last").alias("b")).first()
    for other in others:
        near = mine.where((F.col(key) == other) & (F.col("last") >= ends["a"]) & (F.col("first") <= ends["b"]))
        found = found.join(near.select(F.explode("items").alias("item")), "item", "left_semi")
    return found


def claims_of(pages: DataFrame, *more: str) -> DataFrame:
    """(key, page_id, more): what each page can be called, no key of a page twice."""
    entities = F.flatten(F.transform("entities", lambda e: F.concat(F.array(e["name"]), e["aliases"])))
    names = F.array_distinct(F.concat(F.array("id", "title", stem(F.col("source_path"))), entities))
    keys = F.array_distinct(F.transform(names, reconcile_key))
    return pages.select(F.explode(keys).alias("key"), F.col("id").alias("page_id"), *more).where("key <> ''")


def edges_of(pages: DataFrame, *more: str) -> DataFrame:
    """src, written, type, strength, semantic, ord, more: edges as the pages declare them."""
    told = lambda name, semantic: F.transform(name, lambda r: F.struct(r["target"].alias("target"), r["type"].alias("type"), r["strength"].alias("strength"), F.lit(semantic).alias("semantic")))
    both = F.concat(told("relationships", False), told("semantic_relationships", True))
    edges = pages.select(F.col("id").alias("src"), *more, F.posexplode(both).alias("ord", "e")).select("src", F.col("e.target").alias("written"), "e.type", "e.strength", "e.semantic", "ord", *more)
    return edges.where("written <> ''")


def named_by(edges: DataFrame) -> DataFrame:
    """(written, key): the texts that edges name their targets by, each once."""
    return edges.select("written").distinct().withColumn("key", reconcile_key(F.col("written")))


def targets(names: DataFrame, ids: DataFrame, owners: DataFrame) -> DataFrame:
    """(written, target, resolved) of each of the names. ids: (id) of pages that a key names; owners: (key, page_id). An id goes before a key."""
    known = ids.join(names.select(F.col("written").alias("id")), "id", "left_semi").distinct()
    wanted = owners.join(names, "key", "left_semi")
    by_id = names.join(known.select(F.col("id").alias("__id")), F.col("written") == F.col("__id"), "left")
    both = by_id.join(wanted.select("key", F.col("page_id").alias("__alias")), "key", "left")
    target = F.coalesce("__id", "__alias")
    return both.select("written", F.coalesce(target, "written").alias("target"), target.isNotNull().alias("resolved"))


def resolved(edges: DataFrame, ids: DataFrame, owners: DataFrame) -> DataFrame:
    """edges with target and resolved. Each text is resolved once, however many edges name it; few texts are broadcast, so that edges to a popular target stay where they are."""
    return edges.join(written(targets(written(named_by(edges)), ids, owners)), "written")


@dataclass(frozen=True)
class KnowledgeGraph:
    """pages with ids; everything else follows from them, as plans that Spark runs when asked.

    What all else is made of, the names that pages claim and the resolved edges, is written to the
    shared folder at its first use, once for a graph.
    """

    pages: DataFrame

    @classmethod
    def build(cls, pages: DataFrame, root: str = "") -> KnowledgeGraph:
        return cls(with_ids(pages, root))

    @cached_property
    def claims(self) -> DataFrame:
        """(key, page_id): what each page can be called."""
        return written(claims_of(self.pages).distinct())

    @cached_property
    def aliases(self) -> DataFrame:
        """(key, page_id, owners): the lowest owner of each key."""
        return self.claims.groupBy("key").agg(F.min("page_id").alias("page_id"), F.sort_array(F.collect_set("page_id")).alias("owners"))

    @cached_property
    def ambiguous(self) -> DataFrame:
        return self.aliases.where(F.size("owners") > 1)

    @cached_property
    def declared(self) -> DataFrame:
        """Edges as the pages declare them, resolved: src, written, target, type, strength, semantic, resolved, ord.

        An exact id goes before an alias; an edge to nothing known keeps its text. A page that no
        key names can't be resolved to, not even by its id.
        """
        ids = self.claims.select(F.col("page_id").alias("id"))
        return written(resolved(written(edges_of(self.pages)), ids, self.aliases.select("key", "page_id")).select(*DECLARED))

    @cached_property
    def edges(self) -> DataFrame:
        """declared, without the later of equal (src, target, type, strength)."""
        first = self.declared.groupBy("src", "target", "type", "strength").agg(F.min(F.struct("ord", "semantic", "resolved")).alias("e"))
        return first.select("src", "target", "type", "strength", "e.semantic", "e.resolved", "e.ord")

    @cached_property
    def dangling(self) -> DataFrame:
        """Unresolved edges: target, src, semantic."""
        return self.declared.where(~F.col("resolved")).select("target", "src", "semantic").orderBy("target", "src")

    def get(self, page_id: str) -> DataFrame:
        return self.pages.where(F.col("id") == page_id)

    def all(self) -> DataFrame:
        return self.pages.orderBy("id")

    def by_tag(self, tag: str) -> DataFrame:
        return self.pages.where(F.array_contains("tags", tag))

    def tag_index(self) -> DataFrame:
        """All ids of a tag in one row; tag_postings has them in blocks."""
        return self.pages.select(F.explode("tags").alias("tag"), "id").groupBy("tag").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def tag_postings(self, size: int = POSTINGS) -> DataFrame:
        """tag_index in blocks, for tags that many pages have."""
        return postings(self.pages.select(F.explode("tags").alias("tag"), "id"), "tag", "id", size)

    def reverse_postings(self, size: int = POSTINGS) -> DataFrame:
        """reverse in blocks, for targets of many edges."""
        return postings(self.edges.select("target", "src"), "target", "src", size)

    def forward(self) -> DataFrame:
        """src, edges in the order they are declared in."""
        return self.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "target", "type", "strength"))).alias("edges"))

    def reverse(self) -> DataFrame:
        """target, srcs: one for each edge, all in one row; reverse_postings has them in blocks."""
        return self.edges.groupBy("target").agg(F.sort_array(F.collect_list("src")).alias("srcs"))

    def semantic_stats(self) -> DataFrame:
        return self.declared.where("semantic").agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("resolved"))

    def stats(self) -> DataFrame:
        """One row: pages, distinct entity names, edges, distinct tags."""
        names = self.pages.select(F.explode("entities.name").alias("n")).agg(F.count_distinct("n").alias("entities"))
        tags = self.pages.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("tags"))
        edges = self.edges.agg(F.count(F.lit(1)).alias("relationships"))
        return self.pages.agg(F.count(F.lit(1)).alias("pages")).crossJoin(names).crossJoin(edges).crossJoin(tags)

    def filtered(self, page_ids: list[str] | DataFrame | None = None, entity_type: str = "", tag: str = "", max_pages: int = 0) -> DataFrame:
        """Pages that pass all filters (an empty one is off, but for a frame of ids), then the first max_pages by id."""
        pages = self.pages
        if isinstance(page_ids, DataFrame):
            pages = pages.join(page_ids.select("id").distinct(), "id", "left_semi")
        elif page_ids:
            pages = pages.where(F.col("id").isin(page_ids))
        if entity_type:
            pages = pages.where(F.col("entity_type") == entity_type)
        if tag:
            pages = pages.where(F.array_contains("tags", tag))
        return pages.orderBy("id").limit(max_pages) if max_pages > 0 else pages

    def summary_stats(self, **filters) -> DataFrame:
        """One row of nine measures over the filtered pages."""
        pages = self.filtered(**filters)
        ids = pages.select(F.col("id").alias("src"))
        own = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size("semantic_relationships")), F.lit(0)).alias("semantic_edges"), F.count_if("id_derived").alias("derived_ids"), F.array_sort(F.collect_set(F.nullif("entity_type", F.lit("")))).alias("entity_types"))
        tags = pages.select(F.explode("tags").alias("t")).agg(F.array_sort(F.collect_set("t")).alias("tags"))
        edges = self.edges.join(ids, "src", "left_semi").agg(F.count(F.lit(1)).alias("relationships"))
        declared = self.declared.join(ids, "src", "left_semi").agg(F.count_if(F.col("semantic") & F.col("resolved")).alias("semantic_edges_resolved"), F.array_sort(F.collect_set(F.when(~F.col("resolved"), F.col("target")))).alias("dangling_target_names"))
        row = own.crossJoin(tags).crossJoin(edges).crossJoin(declared)
        return row.withColumn("dangling_targets", F.size("dangling_target_names"))

    def summary_nodes(self, relationships: bool = True, temporal: bool = False, **filters) -> DataFrame:
        pages = self.filtered(**filters)
        columns = ["id", "title", "summary", "entity_type", "tags", "confidence"]
        if temporal:
            pages = pages.withColumns({c: F.col("temporal")[c] for c in ("valid_from", "valid_until", "last_verified")})
            columns += ["valid_from", "valid_until", "last_verified"]
        nodes = pages.select(*columns)
        if relationships:
            held = self.forward().select(F.col("src").alias("id"), F.transform("edges", lambda e: F.struct(e["target"].alias("target"), e["type"].alias("type"), e["strength"].alias("strength"))).alias("relationships"))
            nodes = nodes.join(held, "id", "left")
        return nodes

    def lookup(self, path_or_id: str) -> DataFrame:
        return self.pages.where((F.col("source_path") == path_or_id) | (F.col("id") == path_or_id)).orderBy("id").limit(1)

    def export(self, body: bool = False) -> DataFrame:
        """One JSON object for each page, in id order."""
        return self.pages.orderBy("id").select("id", F.to_json(F.struct(*(c for c in self.pages.columns if body or c != "body"))).alias("json"))
