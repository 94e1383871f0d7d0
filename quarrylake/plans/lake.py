"""The lake that the catalogue's queries search: text columns of the tables, and slices of base tables with known unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import domains as D
from ..operators import expand as E

LAKE = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}
#: Base tables and the columns that a family of slices has.
FAMILIES = {
    "part____c3_0": ("part", ["p_name", "p_brand", "p_type"]), "part____c2_0": ("part", ["p_name", "p_brand"]), "part____c2_1": ("part", ["p_name", "p_type"]),
    "customer____c2_0": ("customer", ["c_name", "c_mktsegment"]), "orders____c2_0": ("orders", ["o_orderpriority", "o_orderstatus"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, dfs)


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, c, v of all text columns."""
    return union([D.cells(table(spark, sf_dir, t), t, cs) for t, cs in LAKE.items()])


def slice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, c, v of all slices; a slice is named family____j."""

    def family(name: str, base: str, columns: list[str]) -> DataFrame:
        rows = E.slices(table(spark, sf_dir, base), columns)
        return rows.unpivot(["j"], columns, "c", "v").select(F.concat(F.lit(f"{name}____"), F.col("j").cast("string")).alias("t"), "c", "v")

    return union([family(n, b, cs) for n, (b, cs) in FAMILIES.items()])


def truth(domains: DataFrame) -> DataFrame:
    """Unions that are right: columns of one name in slices of one base table."""
    k = domains.select("t", "c").distinct().withColumn("base", F.split("t", "____")[0])
    q, c = k.select(F.col("t").alias("qt"), F.col("c").alias("qc"), "base"), k.select(F.col("t").alias("ct"), F.col("c").alias("cc"), "base")
    return q.join(c, "base").filter("qt <> ct and qc = cc").select("qt", "qc", "ct", "cc")


def word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """A vector for each word, from the table of embeddings (its ids count from 0) by the word's hash."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vec"))
    n = vectors.agg(F.count("*").alias("_n"))
    return words.select("word").distinct().crossJoin(F.broadcast(n)).withColumn("_id", X.hash32(F.col("word")) % F.col("_n")).join(vectors, "_id").select("word", "vec")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, category: parts by type, nations by region."""
    part = table(spark, sf_dir, "part").select(F.lower("p_name").alias("entity"), F.lower("p_type").alias("category"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("entity"), F.lower("r_name").alias("category"))
    return part.unionAll(own).distinct()


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sub, super: categories, their kind, and what that is."""
    kinds = types(spark, sf_dir).select("category").distinct().select(F.col("category").alias("sub"), F.concat(F.lit("kind of "), F.substring("category", 1, 1)).alias("super"))
    return kinds.unionAll(kinds.select(F.col("super").alias("sub"), F.lit("thing").alias("super"))).distinct()
