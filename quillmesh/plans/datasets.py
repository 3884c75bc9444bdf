"""Pages, edges and vectors out of relational tables, for the registered queries.

The same rows are told in SQL in `oracle.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores: tables of few bytes are read by a task or two, whatever is made of each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def text(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def edge(target: Column, kind: str, strength: float) -> Column:
    return F.struct(target.alias("target"), F.lit(kind).alias("type"), F.lit(strength).alias("strength"))


def two(x: Column) -> Column:
    return F.lpad(text(x), 2, "0")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, with every field that search looks at."""
    k = F.col("p_partkey")
    temporal = F.struct(F.concat(F.lit("2024-"), two(k % 12 + 1), F.lit("-"), two(k % 28 + 1)).alias("last_verified"), ((k % 3) * F.lit(0.001)).alias("decay_rate"), F.lit("").alias("valid_from"), F.lit("").alias("valid_until"))
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.concat(F.lit("part-"), text(k)).alias("id"), F.col("p_name").alias("title"), F.lit("tool").alias("entity_type"), (F.col("p_size") / 50).alias("confidence"), F.array("p_brand", "p_type").alias("tags"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.array(F.lower("p_type"), F.concat(F.lit("item "), text(k % 10))).alias("aliases"), F.lit("maker").alias("role"))).alias("entities"),
        F.array(edge(F.concat(F.lit("supplier-"), text(k % 100)), "made-by", 0.7)).alias("relationships"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("semantic_hints"), temporal.alias("temporal"),
        F.concat(F.col("p_name"), F.lit(" made as "), F.lower("p_type"), F.lit(" for shop"), text(k % 7)).alias("body"),
    )
    return conform(pages)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown document for each part: k, source_path, body."""
    k = F.col("p_partkey")
    body = F.concat(
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("# "), F.col("p_name"), F.lit(" notes\n"))), F.lit("Made by [[Supplier "), text(k % 17), F.lit("]] and [[supplier "), text(k % 17), F.lit("]], see [["), F.col("p_brand"), F.lit("]].\n"),
        F.lit("```\n#hidden [[Nope]]\n```\nUse `[[code]]` here #Tag"), text(k % 5), F.lit(" #"), F.lower("p_type"), F.lit(" #tag"), text(k % 5), F.lit(" x\nSee https://example.com/p/"), text(k % 9), F.lit(". or (https://example.com/b)\n"),
    )
    path = F.concat(F.lit("/kb/"), F.col("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit("-"), text(k), F.lit(".md"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("k"), path.alias("source_path"), body.alias("body"), "p_name", "p_brand", "p_type", "p_size")


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of regions, nations, suppliers and customers with edges by id, by name, and to nothing."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<struct<target:string,type:string,strength:double>>")
    lit = lambda s: F.lit(s)

    def page(df: DataFrame, pid: Column, title: str, kind: str, confidence: Column, tags: Column, plain: Column, semantic: Column) -> DataFrame:
        entity = F.array(F.struct(F.col(title).alias("name"), F.array().cast("array<string>").alias("aliases"), lit(kind).alias("role")))
        return df.select(pid.alias("id"), F.col(title).alias("title"), lit(kind).alias("entity_type"), confidence.cast("double").alias("confidence"), tags.alias("tags"), entity.alias("entities"), plain.alias("relationships"), semantic.alias("semantic_relationships"))

    regions = page(t("region"), F.concat(lit("region-"), text("r_regionkey")), "r_name", "place", lit(0.9), F.array(lit("region")), none, none)
    nations = page(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.concat(lit("nation-"), text("n_nationkey")), "n_name", "place", lit(0.8), F.array(lit("nation"), F.concat(lit("group-"), text(F.col("n_nationkey") % 2))), F.array(edge(F.col("r_name"), "located_in", 0.9)), none)
    k = F.col("s_suppkey")
    suppliers = page(
        spread(t("supplier"), "s_suppkey"), F.concat(lit("supplier-"), text(k)), "s_name", "organization", lit(0.5) + (k % 5) / 10, F.array(lit("supplier"), F.concat(lit("tier-"), text(k % 4))),
        F.array(edge(F.concat(lit("nation-"), text("s_nationkey")), "based_in", 0.7), edge(F.concat(lit("nation-"), text("s_nationkey")), "based_in", 0.7), edge(F.concat(lit("nation-"), text("s_nationkey")), "ships_to", 0.2)),
        F.array(edge(F.concat(lit("Region "), text(k % 5)), "mentions", 0.5), edge(F.when(k % 10 == 0, F.concat(lit("Planet "), text(k % 7))).otherwise(""), "mentions", 0.5)),
    )
    c = F.col("c_custkey")
    customers = page(
        spread(t("customer"), "c_custkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.concat(lit("customer-"), text(c)), "c_name", "person", lit(0.6), F.array(F.lower("c_mktsegment")),
        F.concat(F.array(edge(F.col("n_name"), "lives_in", 0.6)), F.when(c % 50 == 0, F.array(edge(F.concat(lit("Unknown Corp "), text(c % 7)), "works_for", 0.3))).otherwise(none)), none,
    )
    return conform(regions.unionByName(nations).unionByName(suppliers).unionByName(customers))


#: Where the registered traversals start.
ROOT = "region-1"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the first parts: (id, content_hash, embedding); every seventh has the hash of an older content."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("part-"), text(v)).alias("id"), F.when(v % 7 == 0, F.lit("old")).otherwise(F.concat(F.lit("h-"), text(v))).alias("content_hash"), "embedding")


#: The query's vector in hybrid search, by rule.
QUERY_VECTOR = [((i * 7) % 11 - 5) / 10 for i in range(64)]
