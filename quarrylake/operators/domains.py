"""Column domains: the values of the text columns of a lake, with their types, frequencies and sizes.

Cells have the columns t (table), c (column) and v (value); a domain is a table's column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def cells(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row for each cell of the columns, from a single scan."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "c", "v").select(F.lit(name).alias("t"), "c", "v")


def domains(cells: DataFrame) -> DataFrame:
    """The different normalised values of each domain."""
    return cells.filter(X.keep_value(F.col("v"))).select("t", "c", F.lower(X.trimmed(F.col("v"))).alias("v")).distinct()


def words(domains: DataFrame) -> DataFrame:
    """The different words of each domain's values."""
    return domains.select("t", "c", F.explode(X.get_words(F.col("v"))).alias("v")).distinct()


def tokens(domains: DataFrame) -> DataFrame:
    """The different tokens of each domain's values of at most five."""
    return domains.select("t", "c", F.explode(X.tokens(F.col("v"))).alias("v")).distinct()


def value_freq(cells: DataFrame) -> DataFrame:
    return cells.filter(X.keep_value(F.col("v"))).groupBy("t", "c", F.lower(X.trimmed(F.col("v"))).alias("v")).agg(F.count("*").alias("freq"))


def sizes(cells: DataFrame) -> DataFrame:
    """Cardinality and size, from the frequencies, so that values are shuffled once and partly summed before."""
    return value_freq(cells).groupBy("t", "c").agg(F.count("*").alias("card"), F.sum("freq").alias("size"))


def types(cells: DataFrame) -> DataFrame:
    """numeric, text or unknown, by the majority of the values; a tie is text."""
    return (
        cells.groupBy("t", "c")
        .agg(F.sum(X.is_numeric(F.col("v")).cast("bigint")).alias("n_numeric"), F.sum((~X.is_numeric(F.col("v")) & X.is_text(F.col("v"))).cast("bigint")).alias("n_text"))
        .withColumn("col_type", F.when((F.col("n_numeric") == 0) & (F.col("n_text") == 0), "unknown").when(F.col("n_numeric") > F.col("n_text"), "numeric").otherwise("text"))
    )


def profile(cells: DataFrame) -> DataFrame:
    """Rows, values, different values and the mean length in bytes of each column."""
    v = F.col("v")
    return cells.groupBy("t", "c").agg(F.count("*").alias("n_rows"), F.count(v).alias("n_values"), F.countDistinct(v).alias("n_distinct"), F.round(F.avg(F.octet_length(v)), 6).alias("mean_bytes"))


def coverage(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values, different values, and those with a token that the vocabulary (word) has."""
    freq = value_freq(cells)
    known = freq.select("t", "c", "v", F.explode(X.tokens(F.col("v"))).alias("word")).join(vocabulary.select("word").distinct(), "word", "left_semi").select("t", "c", "v").distinct().withColumn("known", F.lit(True))
    own = freq.join(known, ["t", "c", "v"], "left")
    return own.groupBy("t", "c").agg(F.sum("freq").alias("n_values"), F.count("*").alias("n_distinct"), F.sum(F.when(F.col("known"), F.col("freq")).otherwise(0)).alias("known_values"), F.count("known").alias("known_distinct"))
