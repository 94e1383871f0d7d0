"""One-to-one alignment of columns, and what is ranked by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("qt", "ct")


def greedy(pairs: DataFrame, by: tuple[str, ...] = BY, q: str = "qc", c: str = "cc", order: Column | None = None, score: str = "score") -> DataFrame:
    """The best pair whose two sides are free, again and again: by, k (from 1), q, c, score.

    order: the best come first; ties by q, then c. A group is folded inside one
    expression: it holds the column pairs of two tables.
    """
    order = -F.col(score) if order is None else order
    rows = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(q).alias("q"), F.col(c).alias("c"), F.col(score).cast("double").alias("s")))).alias("_r"))
    empty = F.filter("_r", lambda r: F.lit(False))
    taken = F.aggregate("_r", empty, lambda acc, x: F.when(F.exists(acc, lambda a: (a["q"] == x["q"]) | (a["c"] == x["c"])), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select(*by, F.posexplode(taken).alias("k", "x")).select(*by, (F.col("k") + 1).cast("bigint").alias("k"), F.col("x.q").alias(q), F.col("x.c").alias(c), F.col("x.s").alias(score))


def c_unionability(aligned: DataFrame, by: tuple[str, ...] = BY, score: str = "score") -> DataFrame:
    """For each c, the product of the c best scores, and by how much it falls from the one before."""
    upto = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    product = F.exp(F.sum(F.ln(score)).over(upto))
    rows = aligned.filter(F.col(score) > 0).select(*by, F.col("k").alias("c"), product.alias("p"))
    before = F.coalesce(F.lag("p").over(Window.partitionBy(*by).orderBy("c")), F.lit(1.0))
    return rows.select(*by, "c", F.round("p", 6).alias("score"), F.round(before - F.col("p"), 6).alias("difference"))


def best_c(scores: DataFrame, by: tuple[str, ...] = BY, value: str = "score") -> DataFrame:
    """The c of the highest value, the largest of equal ones."""
    return scores.groupBy(*by).agg(F.max(F.struct(value, "c")).alias("b")).select(*by, F.col("b.c").alias("c"), F.col(f"b.{value}").alias(value))


def steepest_c(scores: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The c with the least fall of the score, the least of equal ones."""
    return scores.groupBy(*by).agg(F.min(F.struct("difference", "c")).alias("b")).select(*by, F.col("b.c").alias("c"), F.col("b.difference").alias("difference"))


def top_n(tables: DataFrame, n: int, value: str = "score") -> DataFrame:
    """The n best candidates of each query table: rank from 1; ties by name."""
    rank = F.row_number().over(Window.partitionBy("qt").orderBy(F.desc(value), "ct"))
    return tables.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n)


def k_alignment(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The score of the k-th aligned pair, for each k up to most."""
    return greedy(pairs).filter(F.col("k") <= most)


def completed(pairs: DataFrame, k: int, n: int) -> DataFrame:
    """Tables that reach k aligned columns, the n with the best k-th score of each query."""
    return top_n(greedy(pairs).filter(F.col("k") == k).select("qt", "ct", "score"), n)


def stitched(pairs: DataFrame) -> DataFrame:
    """Aligned pairs with their table's total score."""
    best = pairs.groupBy("qt", "ct", "qc", "cc").agg(F.max("score").alias("score"))
    return greedy(best).withColumn("total", F.sum("score").over(Window.partitionBy("qt", "ct")))


def size_cluster_scores(lengths: DataFrame) -> DataFrame:
    """How far apart the columns' mean lengths of two tables lie, merged from both ends: m - 1 steps (m columns in the smaller table), each adding the larger of the gaps between one table's longest open column and the other's shortest, whose pointer moves on. lengths: t, c, len; a table's columns are one array."""
    tables = lengths.groupBy("t").agg(F.array_sort(F.collect_list("len")).alias("l"))
    both = tables.select(F.col("t").alias("qt"), F.col("l").alias("a")).join(tables.select(F.col("t").alias("ct"), F.col("l").alias("b")), F.col("qt") != F.col("ct"))
    steps = F.least(F.size("a"), F.size("b")) - 1
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("sum"))

    def step(s: Column, _: Column) -> Column:
        x = F.abs(F.get("a", F.size("a") - 1 - s["i"]) - F.get("b", s["j"]))
        y = F.abs(F.get("b", F.size("b") - 1 - s["j"]) - F.get("a", s["i"]))
        return F.when(x < y, F.struct(s["i"].alias("i"), (s["j"] + 1).alias("j"), (s["sum"] + y).alias("sum"))).otherwise(F.struct((s["i"] + 1).alias("i"), s["j"].alias("j"), (s["sum"] + x).alias("sum")))

    walk = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["sum"])).otherwise(0.0)
    return both.select("qt", "ct", F.round(walk, 6).alias("score"))


def k_unionable(edges: DataFrame, k: int) -> DataFrame:
    """Whether k columns of two tables can be matched (soft), and whether all columns of the query that have an edge are (hard): qt, ct, soft, hard."""
    nodes = edges.groupBy("qt", "ct").agg(F.countDistinct("qc").alias("nodes"))
    return matching(edges).join(nodes, ["qt", "ct"]).select("qt", "ct", (F.col("matched") >= k).alias("soft"), ((F.col("matched") >= k) & (F.col("matched") == F.col("nodes"))).alias("hard"))


def matching(edges: DataFrame) -> DataFrame:
    """The size of the largest one-to-one matching of the columns of two tables: qt, ct, matched."""
    import pandas as pd

    def largest(g: pd.DataFrame) -> pd.DataFrame:
        near = {q: sorted(set(x)) for q, x in g.groupby("qc").cc}
        owner: dict[str, str] = {}

        def place(q: str, seen: set[str]) -> bool:
            for c in near[q]:
                if c not in seen:
                    seen.add(c)
                    if c not in owner or place(owner[c], seen):
                        owner[c] = q
                        return True
            return False

        n = sum(place(q, set()) for q in sorted(near))
        return pd.DataFrame({"qt": [g.qt.iat[0]], "ct": [g.ct.iat[0]], "matched": [n]})

    return edges.select("qt", "ct", "qc", "cc").groupBy("qt", "ct").applyInPandas(largest, "qt string, ct string, matched bigint")
