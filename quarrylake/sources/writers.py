"""Writers: every result table has its columns and overwrites what was there before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import fresh

_PAIR = ["qt", "qc", "ct", "cc"]
#: The columns of each result table.
TABLES = {
    "attribute_scores": [*_PAIR, "measure", "score"],
    "attribute_percentiles": [*_PAIR, "measure", "score", "pct"],
    "table_alignments": [*_PAIR, "measure", "score"],
    "table_scores": ["qt", "ct", "c", "score", "difference"],
    "cdf": ["measure", "bin", "lower", "upper", "n", "acc", "pct", "total"],
    "cdf_per_c": ["c", "bin", "lower", "upper", "n", "acc", "pct", "total"],
    "annotations": ["t", "col_idx", "c", "class", "freq", "n_entities"],
    "entity_complement": ["qt", "ct", "ece", "sc", "score"],
    "cluster_scores": ["qt", "ct", "score"],
    "cluster_alignments": ["qt", "ct", "k", "qc", "cc", "score"],
    "stitching": ["qt", "ct", "k", "qc", "cc", "score", "total"],
    "search_results": [
        "qt", "ct", "n_query_columns", "n_query_text_columns", "n_candidate_columns", "n_candidate_text_columns", "query_col_idx", "qc", "candidate_col_idx", "cc", "jaccard", "hypergeometric", "ontology_jaccard",
        "ontology_hypergeometric", "cosine", "f_distribution", "t2", "sim", "kunionability", "k", "n", "expansion", "duration", "containment", "query_cardinality", "candidate_cardinality",
    ],
    "top_tables": ["qt", "ct", "c", "score", "minus", "pct", "plus", "rank"],
    "row_expansion": ["qt", "ct", "rows_before", "rows_after"],
    "column_expansion": [*_PAIR, "n_before", "added"],
    "matching": ["qt", "ct", "measure", "k", "score"],
    "labelled_pairs": ["a", "b", "label"],
    "labelled_vectors": ["id", "vec"],
    "coverage": ["t", "c", "n_values", "n_distinct", "known_values", "known_distinct"],
    "cardinalities": ["t", "c", "n_annotated", "n_unannotated", "n_entities"],
}


def checked(df: DataFrame, name: str) -> DataFrame:
    """What a table takes: columns that df lacks are null where most are optional (search_results); scores of clusters are positive, those of alignments finite; a domain without a class has one row of class -1."""
    if name == "search_results":
        df = df.withColumns({c: F.lit(None).cast("double") for c in TABLES[name] if c not in df.columns})
    if name == "cluster_scores":
        df = df.filter(F.col("score") > 0)
    if name == "cluster_alignments":
        df = df.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    if name == "annotations":
        df = df.withColumns({"class": F.coalesce("class", F.lit("-1")), "freq": F.coalesce("freq", F.lit(0)), "n_entities": F.coalesce("n_entities", F.lit(0))})
    return df.select(*TABLES[name])


def save(df: DataFrame, root: str, name: str) -> DataFrame:
    """df's columns of the table, written over it; read again."""
    out = checked(df, name)
    path = f"{root}/{name}.parquet"
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_domains(domains: DataFrame, root: str, files: int = 64) -> None:
    """Domain values in a folder for each of so many hash buckets of the table: one writer for each, whatever the number of tables."""
    bucket = F.pmod(F.xxhash64("t"), F.lit(files))
    domains.withColumn("bucket", bucket).repartition(files, "bucket").sortWithinPartitions("t", "c").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/domains.parquet")


def load_domains(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/domains.parquet").drop("bucket")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest(judgements: DataFrame, keys: list[str], order: str, ties: list[str] = []) -> DataFrame:
    """The last row of each key: what an upsert would leave. Of equally late ones the first by ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *ties)
    (r,) = fresh(judgements, "_rank")
    return judgements.withColumn(r, F.row_number().over(w)).filter(F.col(r) == 1).drop(r)
