"""Search for tables that can be appended to a query table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..operators import align as A
from ..operators import annotate as O
from ..operators import cdf as C
from ..operators import domains as D
from ..operators import measures as M
from ..operators import sketches as S
from . import lake as L
from .store import kept, stored

BINS = 20
TOP = 10


#: The tables that the slices, their classes and their vectors come from.
BASES = ("part", "customer", "orders", "nation", "region", "embeddings")


def slice_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value frequencies of all slices, written once: every measure begins with them."""
    return kept(spark, sf_dir, "freq", BASES, lambda: D.value_freq(L.slice_cells(spark, sf_dir)))


def class_domains(spark: SparkSession, sf_dir: str, domains: DataFrame) -> DataFrame:
    """t, c, v: the classes of each domain's entities."""
    types = L.types(spark, sf_dir)
    matches = O.find_entities(domains.select("v").distinct(), O.inverted_index(types))
    return O.classes(domains, matches, types).select("t", "c", F.col("class").alias("v"))


def embedded_values(spark: SparkSession, sf_dir: str, freq: DataFrame) -> DataFrame:
    """t, c, v, freq, i, x: the components of each value's vector, the sum of its tokens'."""
    from ..functions import text as X

    tokens = freq.select("v").distinct().select("v", F.explode(X.tokens(F.col("v"))).alias("word"))
    vectors = L.word_vectors(spark, sf_dir, tokens)
    parts = tokens.join(vectors, "word").select("v", F.posexplode("vec").alias("i", "x")).groupBy("v", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return freq.join(parts, "v").select("t", "c", "v", "freq", F.col("i").cast("bigint").alias("i"), "x")


def mean_vectors(spark: SparkSession, sf_dir: str, freq: DataFrame) -> DataFrame:
    """t, c, mean (array) of the values' vectors; frequencies weigh the values.

    A column's mean is a weighted sum of its words' vectors, so no value's vector is
    spelt out: the words of a column are counted, and a row for each word meets its
    vector. Sums combine before the shuffle, a row for each column and task.
    """
    from ..functions import text as X

    vectors = L.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vec"))
    count = vectors.agg(F.count("*").alias("_n"), F.max(F.size("vec")).alias("_dims"))
    dims = count.first()["_dims"] or 0
    words = freq.select("t", "c", "v", "freq", F.explode(X.tokens(F.col("v"))).alias("word")).crossJoin(F.broadcast(count.select("_n"))).withColumn("_id", X.hash32(F.col("word")) % F.col("_n"))
    hits = words.join(vectors.select("_id"), "_id", "left_semi")
    total = hits.groupBy("t", "c", "v").agg(F.max("freq").alias("freq")).groupBy("t", "c").agg(F.sum("freq").cast("double").alias("_total"))
    weights = hits.groupBy("t", "c", "_id").agg(F.sum("freq").cast("double").alias("_w"))
    sums = [F.sum(F.col("_w") * F.get("vec", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dims)]
    own = weights.join(vectors, "_id").groupBy("t", "c").agg(F.max(F.size("vec")).alias("_m"), *sums).join(total, ["t", "c"])
    return own.filter("_m > 0").select("t", "c", F.slice(F.array(*(F.col(f"_s{i}") / F.col("_total") for i in range(dims))).cast("array<double>"), F.lit(1), F.col("_m")).alias("mean"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of all column pairs of the slices: qt, qc, ct, cc, measure, score."""

    def build() -> DataFrame:
        freq = slice_freq(spark, sf_dir)
        dom = freq.select("t", "c", "v")
        sems = M.jaccard(stored(class_domains(spark, sf_dir, dom), "classes"))
        nls = M.mean_cosine(kept(spark, sf_dir, "means", BASES, lambda: mean_vectors(spark, sf_dir, freq)))
        return M.all_measures(M.jaccard(dom), sems, nls)

    return kept(spark, sf_dir, "measures", BASES, build)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = measures(spark, sf_dir)
    return C.ensemble(C.with_percentile(scores, C.equi_depth(scores, BINS)))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-to-one alignment of all table pairs by percentile; raw scores break ties."""
    pairs = ensemble(spark, sf_dir).filter("pct > 0")
    return A.greedy(pairs, order=F.struct(-F.col("minus"), -F.col("plus"), -F.col("raw")), score="pct")


def c_percentiles(scores: DataFrame, bins: int = BINS) -> DataFrame:
    """The percentile of each table pair's c-unionability among all pairs' of that c, with those of the score a little less and more; scores: qt, ct, c, score."""
    return C.with_percentile(scores.select("qt", "ct", "c", "score"), C.equi_depth(scores, bins, ["c"]), ["c"])


def ranked_tables(percentiles: DataFrame, n: int = TOP) -> DataFrame:
    """The n best tables for each table. Of a pair's numbers of columns c the one with the highest upper percentile counts, the largest of equal ones; pairs whose percentile there is 0 go; the best have the highest lower percentile, then the highest upper one, then the first name."""
    best = percentiles.groupBy("qt", "ct").agg(F.max(F.struct("plus", "c", "minus", "pct", "score")).alias("b")).select("qt", "ct", "b.*").filter("pct > 0")
    rank = F.row_number().over(Window.partitionBy("qt").orderBy(F.desc("minus"), F.desc("plus"), "ct"))
    return best.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n).select("qt", "ct", "c", "score", "minus", "pct", "plus", "rank")


def top_tables(spark: SparkSession, sf_dir: str, n: int = TOP) -> DataFrame:
    """The n best tables for each table, over columns aligned by the ensemble of measures."""
    scores = stored(A.c_unionability(aligned(spark, sf_dir), score="pct"), "c-scores")
    return ranked_tables(c_percentiles(scores), n)


def lsh_tables(domains: DataFrame, threshold: float = 0.5, n: int = TOP, hashes: int = S.HASHES) -> DataFrame:
    """The same by sketches alone, for a lake of any size: candidates by a band join, scored by estimated Jaccard, aligned and ranked."""
    sketch = stored(S.signatures(domains, hashes), "signatures")
    k, l = S.recalling_bands(threshold, hashes)
    pairs = S.candidates(sketch, k, l)
    q, c = (sketch.select(F.col("t").alias(f"{s}t"), F.col("c").alias(f"{s}c"), F.col("sig").alias(f"{s}s")) for s in ("q", "c"))
    scored = pairs.join(q, ["qt", "qc"]).join(c, ["ct", "cc"]).select(*M.PAIR, F.round(S.estimated_jaccard(F.col("qs"), F.col("cs")), 6).alias("score"))
    return A.top_n(A.best_c(A.c_unionability(A.greedy(scored))), n)


def band_measures(spark: SparkSession, sf_dir: str, hashes: int = S.HASHES, threshold: float = 0.5) -> DataFrame:
    """The measures of the pairs that bands bring together: of values' sketches, of classes' sketches, or of mean vectors' hyperplanes. Every step is an equi-join, so no pair of columns is met that shares no band; sets are compared by their sketches."""
    freq = slice_freq(spark, sf_dir)
    dom = freq.select("t", "c", "v")
    means = kept(spark, sf_dir, "means", BASES, lambda: mean_vectors(spark, sf_dir, freq))
    sketch = {name: stored(S.signatures(x, hashes), "signatures") for name, x in (("set", dom), ("sem", class_domains(spark, sf_dir, dom)))}
    k, l = S.recalling_bands(threshold, hashes)
    named = stored(means.withColumn("id", F.xxhash64("t", "c")), "named-means")
    near = S.cosine_candidates(named, "id", "mean", 8, 8).join(named.select("id", F.col("t").alias("qt"), F.col("c").alias("qc")), "id").join(named.select(F.col("id").alias("other"), F.col("t").alias("ct"), F.col("c").alias("cc")), "other")
    pairs = [S.candidates(x, k, l) for x in sketch.values()] + [near.filter("qt <> ct").select(*M.PAIR)]
    pairs = stored(pairs[0].unionAll(pairs[1]).unionAll(pairs[2]).distinct(), "pairs")

    def sides(x: DataFrame, column: str) -> DataFrame:
        q, c = (x.select(F.col("t").alias(f"{s}t"), F.col("c").alias(f"{s}c"), F.col(column).alias(f"{s}x")) for s in "qc")
        return pairs.join(q, ["qt", "qc"]).join(c, ["ct", "cc"])

    scored = [sides(x, "sig").select(*M.PAIR, F.lit(name).alias("measure"), F.round(S.estimated_jaccard(F.col("qx"), F.col("cx")), 6).alias("score")) for name, x in sketch.items()]
    scored.append(sides(means, "mean").select(*M.PAIR, F.lit("nl").alias("measure"), F.least(F.round(cosine(F.col("qx"), F.col("cx")), 6), F.lit(1.0)).alias("score")))
    return stored(scored[0].unionAll(scored[1]).unionAll(scored[2]).filter("score <> 0"), "band-measures")


def band_tables(spark: SparkSession, sf_dir: str, n: int = TOP) -> DataFrame:
    """The n best tables for each table, for a lake of any size: the search by the ensemble over the pairs that bands bring together."""
    scores = band_measures(spark, sf_dir)
    pairs = C.ensemble(C.with_percentile(scores, C.equi_depth(scores, BINS))).filter("pct > 0")
    best = A.greedy(pairs, order=F.struct(-F.col("minus"), -F.col("plus"), -F.col("raw")), score="pct")
    return ranked_tables(c_percentiles(stored(A.c_unionability(best, score="pct"), "c-scores")), n)
