"""Clustering of web tables: TF-IDF cosine, mean lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measures import PAIR, sided


def idf(freq: DataFrame) -> DataFrame:
    """1 + ln(N / df), df counting every cell."""
    n = freq.groupBy("v").agg(F.sum("freq").alias("df"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("df").alias("total")))).select("v", "df", (1 + F.ln(F.col("total") / F.col("df"))).alias("idf"))


def tfidf(freq: DataFrame, by: tuple[str, ...] = ("t", "c")) -> DataFrame:
    """by, v, w: the share of a group's cells times idf."""
    own = freq.groupBy(*by, "v").agg(F.sum("freq").alias("f"))
    total = own.groupBy(*by).agg(F.sum("f").alias("n"))
    return own.join(total, list(by)).join(idf(freq), "v").select(*by, "v", (F.col("f") / F.col("n") * F.col("idf")).alias("w"))


def cosines(weights: DataFrame) -> DataFrame:
    """Cosine of the column pairs with a value in common."""
    norm = weights.groupBy("t", "c").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l2")).filter("l2 > 0")
    unit = weights.join(norm, ["t", "c"]).select("t", "c", "v", (F.col("w") / F.col("l2")).alias("w"))
    both = sided(unit, "q").join(sided(unit.withColumnRenamed("w", "x"), "c"), "v").filter("qt <> ct")
    return both.groupBy(*PAIR).agg(F.sum(F.col("w") * F.col("x")).alias("score"))


def table_cosines(freq: DataFrame) -> DataFrame:
    """Cosine of whole tables."""
    w = tfidf(freq, ("t",)).withColumn("c", F.lit(""))
    return cosines(w).select("qt", "ct", "score")


def mean_lengths(cells: DataFrame) -> DataFrame:
    return cells.groupBy("t", "c").agg(F.avg(F.octet_length("v")).alias("len"))


def length_distances(lengths: DataFrame) -> DataFrame:
    q, c = sided(lengths.withColumnRenamed("len", "ql"), "q"), sided(lengths.withColumnRenamed("len", "cl"), "c")
    return q.join(c, F.col("qt") != F.col("ct")).select(*PAIR, F.round(F.abs(F.col("ql") - F.col("cl")), 6).alias("distance"))
