"""Empirical distributions of scores, percentiles, and the ensemble of measures.

Scores are rounded to four digits first, so that a measure has at most 10,001
different ones, however many pairs there are: what is folded is a histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA = 0.1
BIN = "struct<lo:double,hi:double,n:bigint,acc:bigint,pct:double>"


def histogram(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by, F.round(F.least(F.col("score"), F.lit(1.0)), 4).alias("score")).agg(F.count("*").alias("n"))


def equi_depth(scores: DataFrame, bins: int, by: list[str] = ["measure"]) -> DataFrame:
    """Bins of about equal counts: by, bin, lower, upper, n, acc, pct.

    A bin takes scores until it has total / bins of them. Its percentile is the
    share of what lies before it. The last, unfinished bin ends at 1 with
    percentile 1.
    """
    rows = histogram(scores, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("score", "n"))).alias("h"), F.sum("n").alias("total"))
    depth = F.floor(F.col("total") / bins)
    start = F.struct(F.array().cast(f"array<{BIN}>").alias("done"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("acc"))

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["n"].alias("n"), (s["acc"] + s["n"]).alias("acc"), (s["acc"] / F.col("total")).alias("pct"))))

    def step(s: Column, x: Column) -> Column:
        full = s["n"] >= F.greatest(F.lit(1), depth)
        more = F.struct(s["done"].alias("done"), s["lo"].alias("lo"), x["score"].alias("hi"), (s["n"] + x["n"]).alias("n"), s["acc"].alias("acc"))
        new = F.struct(closed(s).alias("done"), s["hi"].alias("lo"), x["score"].alias("hi"), x["n"].alias("n"), (s["acc"] + s["n"]).alias("acc"))
        return F.when(full, new).otherwise(more)

    def finish(s: Column) -> Column:
        last = F.struct(s["lo"].alias("lo"), F.lit(1.0).alias("hi"), s["n"].alias("n"), (s["acc"] + s["n"]).alias("acc"), F.lit(1.0).alias("pct"))
        return F.concat(s["done"], F.array(last))

    folded = rows.select(*by, F.posexplode(F.aggregate("h", start, step, finish)).alias("bin", "b"))
    return folded.select(*by, F.col("bin").cast("bigint").alias("bin"), F.round("b.lo", 6).alias("lower"), F.round("b.hi", 6).alias("upper"), "b.n", "b.acc", F.round("b.pct", 6).alias("pct"))


def equi_width(scores: DataFrame, bins: int, by: list[str] = ["measure"]) -> DataFrame:
    """Bins of equal width that have scores: by, bin, n, acc, pct (the share up to the bin's end)."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("bigint")
    n = histogram(scores, by).groupBy(*by, at.alias("bin")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")
    every = F.sum("n").over(Window.partitionBy(*by))
    acc = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select(*by, "bin", "n", acc.alias("acc"), F.round(acc / every, 6).alias("pct"))


def width_percentile(scores: DataFrame, cdf: DataFrame, bins: int, by: list[str] = ["measure"]) -> DataFrame:
    """The percentile of each score by bins of equal width (a bin without scores has that of the last one below); 0 for scores that are not positive."""
    at = F.least(F.floor(F.least(F.col("score"), F.lit(1.0)) * bins), F.lit(bins - 1))
    table = cdf.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "pct"))).alias("_bins"))
    hit = F.filter("_bins", lambda b: b["bin"] <= at)
    pct = F.when((F.col("score") > 0) & (F.size(hit) > 0), F.element_at(hit, -1)["pct"]).otherwise(0.0)
    return scores.join(F.broadcast(table), by).withColumn("pct", pct).drop("_bins")


def tied_ensemble(percentiles: DataFrame, by: tuple[str, ...] = ("qt", "qc", "ct", "cc")) -> DataFrame:
    """Of each pair the highest (minus, plus) and the names of all measures that have it, in the order nl, set, sem."""
    order = F.when(F.col("measure") == "nl", 0).when(F.col("measure") == "set", 1).otherwise(2)
    rows = percentiles.groupBy(*by).agg(F.max(F.struct("minus", "plus")).alias("b"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "measure", "minus", "plus"))).alias("r"))
    ties = F.filter("r", lambda x: (x["minus"] == F.col("b.minus")) & (x["plus"] == F.col("b.plus")))
    return rows.select(*by, F.col("b.minus").alias("minus"), F.col("b.plus").alias("plus"), F.array_join(F.transform(ties, lambda x: x["measure"]), "+").alias("measures"))


def tables_of(cdf: DataFrame, by: list[str] = ["measure"]) -> DataFrame:
    """One row for each measure with its bins as a sorted array: as small as bins are, so it is broadcast."""
    return cdf.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("upper", "bin", "pct"))).alias("bins"))


def percentile(bins: Column, score: Column) -> Column:
    """The percentile of the first bin that reaches the score; 0 for scores that are not positive."""
    hit = F.filter(bins, lambda b: b["upper"] >= F.least(score, F.lit(1.0)))
    return F.when((score > 0) & (F.size(hit) > 0), F.get(hit, F.lit(0))["pct"]).otherwise(0.0)


def with_percentile(scores: DataFrame, cdf: DataFrame, by: list[str] = ["measure"]) -> DataFrame:
    """The percentile of each score, and those of the score less and more DELTA."""
    joined = scores.join(F.broadcast(tables_of(cdf, by)), by)
    s, b = F.round("score", 4), F.col("bins")
    return joined.withColumns({"pct": percentile(b, s), "plus": percentile(b, F.round(s + DELTA, 4)), "minus": percentile(b, F.round(F.greatest(s - DELTA, F.lit(0.0)), 4))}).drop("bins")


def ensemble(percentiles: DataFrame, by: tuple[str, ...] = ("qt", "qc", "ct", "cc")) -> DataFrame:
    """The measure with the highest (minus, plus) of each pair; of equal ones nl, then set, then sem."""
    order = F.when(F.col("measure") == "nl", 2).when(F.col("measure") == "set", 1).otherwise(0)
    best = F.max(F.struct("minus", "plus", order.alias("o"), "measure", "pct", "score")).alias("b")
    return percentiles.groupBy(*by).agg(best).select(*by, F.col("b.measure").alias("measure"), F.col("b.score").alias("raw"), F.col("b.pct").alias("pct"), F.col("b.minus").alias("minus"), F.col("b.plus").alias("plus"))
