"""Similarity of column pairs.

Pairs have the columns qt, qc (query table and column) and ct, cc (candidate).
Overlaps are counted by an equi-join on the value, so that pairs without a common
value never meet; sizes are joined afterwards, one row for each domain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine, distance, dot, same_domain_probability, strict_domain_probability

PAIR = ("qt", "qc", "ct", "cc")


def sided(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({"t": f"{side}t", "c": f"{side}c"})


def all_pairs(keys: DataFrame) -> DataFrame:
    """Column pairs of different tables; keys (t, c) is one row for each domain."""
    k = keys.select("t", "c")
    return sided(k, "q").join(sided(k, "c"), F.col("qt") != F.col("ct"))


def overlaps(domains: DataFrame) -> DataFrame:
    """shared, nq, nc of the pairs of different tables with a value in common."""
    d = domains.select("t", "c", "v")
    shared = sided(d, "q").join(sided(d, "c"), "v").filter("qt <> ct").groupBy(*PAIR).agg(F.count("*").alias("shared"))
    n = d.groupBy("t", "c").agg(F.count("*").alias("n"))
    return shared.join(sided(n, "q").withColumnRenamed("n", "nq"), ["qt", "qc"]).join(sided(n, "c").withColumnRenamed("n", "nc"), ["ct", "cc"])


def jaccard(domains: DataFrame) -> DataFrame:
    return overlaps(domains).select(*PAIR, "nq", "nc", F.round(F.col("shared") / (F.col("nq") + F.col("nc") - F.col("shared")), 6).alias("score"))


def containment(domains: DataFrame) -> DataFrame:
    return overlaps(domains).select(*PAIR, F.round(F.col("shared") / F.col("nq"), 6).alias("score"))


def hypergeometric(jaccards: DataFrame) -> DataFrame:
    return jaccards.select(*PAIR, F.round(same_domain_probability(F.col("score"), F.col("nq"), F.col("nc")), 6).alias("score"))


def strict_hypergeometric(jaccards: DataFrame) -> DataFrame:
    return jaccards.select(*PAIR, F.round(strict_domain_probability(F.col("score"), F.col("nq"), F.col("nc")), 6).alias("score"))


def dot_products(histograms: DataFrame, n1: float, n2: float, m1: float, m2: float) -> DataFrame:
    """The sum over common classes of f_q^n1 / |q|^m1 * f_c^n2 / |c|^m2, |q| the number of a domain's entities; histograms: t, c, class, freq, n."""
    own = lambda p, m: F.pow("freq", F.lit(p)) / F.pow("n", F.lit(m))
    q = sided(histograms.select("t", "c", "class", own(n1, m1).alias("x")), "q")
    c = sided(histograms.select("t", "c", "class", own(n2, m2).alias("y")), "c")
    return q.join(c, "class").filter("qt <> ct").groupBy(*PAIR).agg(F.round(F.sum(F.col("x") * F.col("y")), 8).alias("score"))


def best_of_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """The highest cosine, and the greatest distance, of the vectors of two groups: a, b, cosine, distance. Each has few vectors (components, centres); a, b: g, vec."""
    x, y = a.select(F.col("g").alias("a"), F.col("vec").alias("x")), b.select(F.col("g").alias("b"), F.col("vec").alias("y"))
    both = x.join(y, F.col("a") < F.col("b"))
    return both.groupBy("a", "b").agg(F.round(F.max(cosine(F.col("x"), F.col("y"))), 6).alias("cosine"), F.round(F.max(distance(F.col("x"), F.col("y"))), 6).alias("distance"))


def component_means(values: DataFrame, by: list[str], vector: str, weight=None) -> DataFrame:
    """Sum, mean and population variance of each component of the vectors of a group, in one pass: by, i, total, mean, var, n."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = values.select(*by, w.alias("_w"), F.posexplode(vector).alias("i", "_x")).withColumn("_x", F.col("_x").cast("double"))
    out = x.groupBy(*by, "i").agg(F.sum(F.col("_w") * F.col("_x")).alias("total"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("squares"), F.sum("_w").alias("n"))
    mean = F.col("total") / F.col("n")
    return out.select(*by, F.col("i").cast("bigint").alias("i"), "total", mean.alias("mean"), (F.col("squares") / F.col("n") - mean * mean).alias("var"), "n")


def moments(vectors: DataFrame, by: str, vector: str, dims: int) -> DataFrame:
    """by, n, s (sums) and q (sums of products) of each group's vectors, packed as doubles.

    Each task sums its own in matrix products; what is shuffled is a row for each group
    and task. Vectors of another length, or with a null or NaN, are left out.
    """
    kind = vectors.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*held.values()))
            return pa.RecordBatch.from_arrays([pa.array(list(held), key), pa.array(cols[0], pa.int64()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols[1:])], names=names)

        for b in batches:
            key = b.schema.field(0).type
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            group = b.column(0).dictionary_encode()
            at = group.indices.fill_null(len(group.dictionary)).to_numpy()
            by_ = np.argsort(at, kind="stable")
            ends = np.flatnonzero(np.r_[np.diff(at[by_]) != 0, True]) + 1
            for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                rows = x[by_[lo:hi]]
                g = b.column(0)[int(by_[lo])].as_py()
                n, s, q = held.get(g, (0, 0.0, 0.0))
                held[g] = n + len(rows), s + rows.sum(axis=0), q + rows.T @ rows
            if len(held) * dims * dims > 1 << 23:
                yield out()
                held = {}
        if held:
            yield out()

    def merge(t: pa.Table) -> pa.Table:
        total = lambda c: np.sum([np.frombuffer(x.as_buffer()) for x in t.column(c)], axis=0).tobytes()
        return pa.table({by: t.column(by)[:1], "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64()), "s": pa.array([total("s")], pa.binary()), "q": pa.array([total("q")], pa.binary())})

    names = [by, "n", "s", "q"]
    schema = f"`{by}` {kind}, n bigint, s binary, q binary"
    slim = vectors.select(by, F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    return slim.mapInArrow(partial, schema).groupBy(by).applyInArrow(merge, schema)


def covariance(n: int, s: bytes, q: bytes) -> np.ndarray:
    """The population's covariance matrix."""
    mean = np.frombuffer(s) / n
    return np.frombuffer(q).reshape(len(mean), -1) / n - np.outer(mean, mean)


def covariances(moments_: DataFrame, by: str) -> DataFrame:
    """by, i <= j, cov (6 digits)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, r in enumerate(b.to_pylist()):
                m = covariance(r["n"], r["s"], r["q"])
                i, j = np.triu_indices(len(m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(i), k))), pa.array(i), pa.array(j), pa.array(np.round(m[i, j], 6) + 0.0)], names=[by, "i", "j", "cov"])

    return moments_.mapInArrow(spell, f"`{by}` {moments_.schema[by].dataType.simpleString()}, i bigint, j bigint, cov double")


def components(moments_: DataFrame, by: str, k: int, biased: bool = False) -> DataFrame:
    """The k leading principal components: by, k, i, x (4 digits; the greatest entry is positive), share (of the variance); biased adds the sum of the vectors to each."""

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, r in enumerate(b.to_pylist()):
                w, v = np.linalg.eigh(covariance(r["n"], r["s"], r["q"]))
                w, v = np.maximum(w[::-1], 0), v[:, ::-1][:, :k]
                v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
                x = v.T + (np.frombuffer(r["s"]) if biased else 0.0)
                m, n = x.shape
                share = w[:m] / w.sum() if w.sum() > 0 else np.zeros(m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(m * n, row))), pa.array(np.repeat(np.arange(m), n)), pa.array(np.tile(np.arange(n), m)), pa.array(np.round(x.ravel(), 4)), pa.array(np.repeat(np.round(share, 6), n))], names=[by, "k", "i", "x", "share"])

    return moments_.mapInArrow(leading, f"`{by}` {moments_.schema[by].dataType.simpleString()}, k bigint, i bigint, x double, share double")


def gathered(components: DataFrame, by: list[str]) -> DataFrame:
    """Components as arrays again: mean, var, n."""
    rows = components.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "mean", "var"))).alias("_r"), F.max("n").alias("n"))
    return rows.select(*by, F.col("_r.mean").alias("mean"), F.col("_r.var").alias("var"), "n")


def mean_cosine(means: DataFrame) -> DataFrame:
    """Cosine of the mean vectors of all pairs of different tables; means: t, c, mean."""
    q, c = (sided(means.select("t", "c", F.col("mean").alias(f"{s}m")), s) for s in ("q", "c"))
    return q.join(c, F.col("qt") != F.col("ct")).select(*PAIR, F.round(cosine(F.col("qm"), F.col("cm")), 6).alias("score")).filter("score is not null")


def hotelling(a_mean, a_var, a_n, b_mean, b_var, b_n):
    """Hotelling's T2 with a pooled diagonal variance; one is added to the variances if any is tiny."""
    pooled = F.zip_with(a_var, b_var, lambda x, y: ((a_n - 1) * x + (b_n - 1) * y) / (a_n + b_n - 2) * (1 / a_n + 1 / b_n))
    tiny = F.exists(pooled, lambda v: v < 1e-4)
    square = F.zip_with(a_mean, b_mean, lambda x, y: (x - y) * (x - y))
    return dot(square, F.transform(pooled, lambda v: F.when(tiny, 1 / (v + 1)).otherwise(1 / v)))


def f_statistic(t2, a_n, b_n, dims):
    n = a_n + b_n - 1
    return (n - dims) / F.abs(dims * (n - 1)) * t2


def all_measures(sets: DataFrame, sems: DataFrame, nls: DataFrame) -> DataFrame:
    """One row for each pair and measure (set, sem, nl): scores up to 1; those that are zero are left out."""
    named = [df.select(*PAIR, F.lit(m).alias("measure"), F.least(F.col("score"), F.lit(1.0)).alias("score")) for m, df in (("set", sets), ("sem", sems), ("nl", nls))]
    return named[0].unionByName(named[1]).unionByName(named[2]).filter("score <> 0")


def best_measure(measures: DataFrame) -> DataFrame:
    """The highest score of each pair and the measures that have it, in the order set, nl, sem."""
    order = F.when(F.col("measure") == "set", 0).when(F.col("measure") == "nl", 1).otherwise(2)
    rows = measures.groupBy(*PAIR).agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "measure", F.col("score").alias("s")))).alias("_r"))
    top = F.filter("_r", lambda r: r["s"] == F.col("score"))
    return rows.select(*PAIR, "score", F.array_join(F.transform(top, lambda r: r["measure"]), "+").alias("measures"))
