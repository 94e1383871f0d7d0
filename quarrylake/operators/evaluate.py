"""Precision, recall, average precision, and disagreement of rankings.

Results: qt, ct, rank (from 1). Truth: qt, ct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh


def judged(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results with correct: 0 or 1."""
    (y,) = fresh(results, "_right")
    return results.join(truth.select("qt", "ct").distinct().withColumn(y, F.lit(1)), ["qt", "ct"], "left").withColumn("correct", F.coalesce(y, F.lit(0)).cast("bigint")).drop(y)


def at_n(results: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """precision and recall at each n up to most, averaged over the queries; recall is over min(most, number of correct ones)."""
    w = Window.partitionBy("qt").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = judged(results, truth).filter(F.col("rank") <= most).withColumn("hits", F.sum("correct").over(w))
    n_true = truth.select("qt", "ct").distinct().groupBy("qt").agg(F.least(F.count("*"), F.lit(most)).alias("n_true"))
    return hits.join(n_true, "qt").groupBy(F.col("rank").alias("n")).agg(F.round(F.avg(F.col("hits") / F.col("rank")), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("n_true")), 6).alias("recall"), F.count("*").alias("queries"))


def average_precision(results: DataFrame, truth: DataFrame) -> DataFrame:
    """ap of each query with a correct result."""
    w = Window.partitionBy("qt").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = judged(results, truth).withColumn("hits", F.sum("correct").over(w)).filter("correct = 1")
    return hits.groupBy("qt").agg(F.round(F.avg(F.col("hits") / F.col("rank")), 6).alias("ap"), F.count("*").alias("n_correct"))


def mean_average_precision(results: DataFrame, truth: DataFrame) -> DataFrame:
    """The mean of ap over all queries with a result; those without a correct one count 0."""
    queries = results.select("qt").distinct()
    own = queries.join(average_precision(results, truth), "qt", "left")
    return own.agg(F.round(F.avg(F.coalesce("ap", F.lit(0.0))), 6).alias("map"), F.count("*").alias("queries"))


def header_precision(pairs: DataFrame) -> DataFrame:
    """Of each query table the share of column pairs whose headers are alike, letter case aside (a candidate's name may have the wildcards of LIKE)."""
    alike = F.expr("lower(qc) like lower(cc)").cast("bigint")
    return pairs.groupBy("qt").agg(F.count("*").alias("n"), F.sum(alike).alias("correct"), F.round(F.avg(alike), 6).alias("precision"))


def overall(pairs: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Precision and recall of all different pairs."""
    found, true = pairs.select(*on).distinct(), truth.select(*on).distinct()
    both = found.withColumn("f", F.lit(1)).join(true.withColumn("y", F.lit(1)), on, "full")
    hit, f, y = F.count(F.when(F.col("f").isNotNull() & F.col("y").isNotNull(), 1)), F.count("f"), F.count("y")
    return both.agg(hit.alias("correct"), f.alias("found"), y.alias("expected"), F.round(F.try_divide(hit, f), 6).alias("precision"), F.round(F.try_divide(hit, y), 6).alias("recall"))


def missing(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """How many of a's first n results b's first n lack, of each query."""
    top = lambda df: df.filter(F.col("rank") <= n).select("qt", "ct")
    lost = top(a).join(top(b), ["qt", "ct"], "left_anti").groupBy("qt").agg(F.count("*").alias("miss"))
    return top(a).select("qt").distinct().join(lost, "qt", "left").select("qt", F.coalesce("miss", F.lit(0)).alias("miss_num"))
