import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrylake.operators import align as A
from quarrylake.operators import annotate as O
from quarrylake.operators import cdf as C
from quarrylake.operators import domains as D
from quarrylake.operators import evaluate as V
from quarrylake.operators import expand as E
from quarrylake.operators import measures as M
from quarrylake.operators import sketches as S


def domain(spark, sets):
    return spark.createDataFrame([(t, c, v) for (t, c), vs in sets.items() for v in vs], "t string, c string, v string")


def test_jaccard_and_containment(spark):
    cells = domain(spark, {("x", "a"): ["aaa", "aaa", "aaa", "bbb"], ("y", "b"): ["BBB", "ccc", "ccc", "ddd"]})
    d = D.domains(cells)
    assert M.jaccard(d).filter("qt = 'x'").first().score == 0.25
    assert M.containment(d).filter("qt = 'x'").first().score == 0.5


def test_types(spark):
    cells = domain(spark, {("x", "n"): ["1", "2.5", "abc"], ("x", "t"): ["ab", "1"], ("x", "u"): ["-", None]})
    assert {r.c: r.col_type for r in D.types(cells).collect()} == {"n": "numeric", "t": "text", "u": "unknown"}


@pytest.mark.parametrize("hashes,t,cosine,want", [(256, 0.3, False, (4, 64)), (256, 0.5, False, (6, 42)), (256, 0.7, False, (10, 25)), (64, 0.5, False, (4, 14)), (256, 0.7, True, (13, 19)), (256, 0.9, True, (23, 11))])
def test_optimal_bands(hashes, t, cosine, want):
    assert S.optimal_bands(t, hashes, cosine) == want


def test_minhash_error_and_recall(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    sets = {(f"t{k}", "c"): r.sample(base, 200) for k in range(8)} | {("copy", "c"): base[:200], ("copy2", "c"): base[:200]}
    d = domain(spark, sets)
    sig = {(x.t, x.c): x.sig for x in S.signatures(d, 256).collect()}
    for a, b in itertools.combinations(sets, 2):
        exact = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
        assert abs(sum(x == y for x, y in zip(sig[a], sig[b])) / 256 - exact) < 3 / 16
    found = {(x.qt, x.ct) for x in S.candidates(S.signatures(d, 64), 4, 14).collect()}
    assert {("copy", "copy2"), ("copy2", "copy")} <= found


def test_greedy(spark):
    pairs = spark.createDataFrame([("q", "c", *p) for p in (("1", "1", 0.9), ("1", "2", 0.8), ("2", "1", 0.85), ("2", "3", 0.2), ("3", "2", 0.7))], "qt string, ct string, qc string, cc string, score double")
    got = [(r.k, r.qc, r.cc) for r in A.greedy(pairs).orderBy("k").collect()]
    assert got == [(1, "1", "1"), (2, "3", "2"), (3, "2", "3")]
    c = {r.c: r.score for r in A.c_unionability(A.greedy(pairs)).collect()}
    assert c == {1: 0.9, 2: 0.63, 3: 0.126}
    assert A.matching(pairs).first().matched == 3


def test_best_c(spark):
    df = spark.createDataFrame([("q", "c", i + 1, v, 1 - v) for i, v in enumerate([0.99496, 0.99892, 0.99925, 0.999999])], "qt string, ct string, c int, score double, difference double")
    assert A.best_c(df).first().c == 4
    tied = spark.createDataFrame([("q", "c", 1, 0.5, 0.5), ("q", "c", 2, 0.5, 0.0)], df.schema)
    assert A.best_c(tied).first().c == 2


def test_cdf(spark):
    scores = spark.createDataFrame([("m", i / 100) for i in range(1, 101)], "measure string, score double")
    cdf = C.equi_depth(scores, 10).orderBy("bin").collect()
    assert [r.n for r in cdf] == [10] * 10 and cdf[-1].upper == 1.0 and cdf[-1].pct == 1.0
    got = C.with_percentile(scores, C.equi_depth(scores, 10)).orderBy("score").collect()
    assert all(a.pct <= b.pct for a, b in zip(got, got[1:])) and all(r.minus <= r.pct <= r.plus for r in got)
    assert C.equi_width(scores, 10).agg(F.max("pct")).first()[0] == 1.0


def test_hotelling_of_equal_groups(spark):
    df = spark.createDataFrame([Row(m=[1.0, 2.0], v=[0.5, 0.1], n=10.0)])
    assert df.select(M.hotelling(F.col("m"), F.col("v"), F.col("n"), F.col("m"), F.col("v"), F.col("n"))).first()[0] == 0


def test_entities_and_closure(spark):
    types = spark.createDataFrame([("new york", "city"), ("york", "city"), ("blue whale", "animal")], "entity string, category string")
    index = O.inverted_index(types)
    values = spark.createDataFrame([("York, New",), ("york",), ("whale",)], "v string")
    assert {(r.v, r.entity) for r in O.find_entities(values, index).collect()} == {("York, New", "new york"), ("york", "york")}
    assert O.find_entities(values, index, strict=False).filter("v = 'whale'").first().entity == "blue whale"
    assert O.ranked_entities(values, index).filter("v = 'york' and rank = 1").first().entity == "york"
    up = O.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "sub string, super string"))
    assert {(r.sub, r["super"]): r.depth for r in up.collect()}[("a", "d")] == 3


def test_expansion(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "w string, n int")
    assert E.row_expansion(a, b, {"k": "n", "v": "w"}).first() == (2, 3)
    assert E.union_append(a, b, {"v": "w"}).filter("k is null").count() == 2
    same = spark.createDataFrame([("s", "c", "s", "c")], "qt string, qc string, ct string, cc string")
    assert E.column_expansion(domain(spark, {("s", "c"): ["aa", "bb"]}), same).first().added == 0


def test_evaluation(spark):
    results = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abcd")], "qt string, ct string, rank int")
    truth = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z")], "qt string, ct string")
    at = {r.n: (r.precision, r.recall) for r in V.at_n(results, truth, 4).collect()}
    assert at[1] == (1.0, 0.333333) and at[3] == (0.666667, 0.666667)
    assert V.average_precision(results, truth).first().ap == round((1 + 2 / 3) / 2, 6)
    other = results.withColumn("rank", 5 - F.col("rank"))
    assert V.missing(results, other, 2).first().miss_num == 2


def test_topk_and_simhash(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.standard_normal((60, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(a.vec_id, a["rank"]): a.other for a in S.topk_cosine(df, "vec_id", "embedding", 3, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert all(got[(i, k + 1)] == j for i in range(60) for k, j in enumerate(np.argsort(-s[i])[:3]))
    b = {a.vec_id: a.bucket for a in S.simhash(df, "vec_id", "embedding").collect()}
    assert len(b) == 60 and all(len(v) == 16 for v in b.values())
