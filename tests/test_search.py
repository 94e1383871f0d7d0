"""Properties of the searches and of what has no SQL, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.operators import align as A
from quarrylake.operators import domains as D
from quarrylake.operators import expand as E
from quarrylake.operators import measures as M
from quarrylake.operators import sketches as S
from quarrylake.plans import lake as L
from quarrylake.plans import search as P


def vectors(spark, n=200, dims=6, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dims)) @ np.random.default_rng(seed + 1).standard_normal((dims, dims)) + 3
    rows = [(k % 3 if k % 7 else None, v.tolist()) for k, v in enumerate(x)]
    return rows, spark.createDataFrame(rows + [(0, None), (1, [1.0]), (2, [float("nan")] * dims)], "g int, v array<double>")


def test_covariance_and_components(spark):
    rows, df = vectors(spark)
    m = M.moments(df.repartition(4), "g", "v", 6)
    cov = {(r.g, r.i, r.j): r["cov"] for r in M.covariances(m, "g").collect()}
    pcs, biased = ({(r.g, r.k, r.i): (r.x, r.share) for r in M.components(m, "g", 2, b).collect()} for b in (False, True))
    for g in (0, 1, 2, None):
        x = np.array([v for k, v in rows if k == g])
        want = np.cov(x.T, bias=True)
        assert all(abs(cov[g, i, j] - want[i, j]) < 2e-6 for i in range(6) for j in range(i, 6))
        _, s, vt = np.linalg.svd(x - x.mean(axis=0))
        for k in range(2):
            got = np.array([pcs[g, k, i][0] for i in range(6)])
            assert np.allclose(np.abs(got), np.abs(vt[k]), atol=2e-4) and got[np.abs(got).argmax()] > 0
            assert abs(pcs[g, k, 0][1] - s[k] ** 2 / (s**2).sum()) < 2e-6
            assert np.allclose([biased[g, k, i][0] for i in range(6)], got + x.sum(axis=0), atol=2e-3)
    assert M.components(M.moments(df.limit(0), "g", "v", 6), "g", 2).count() == 0


def test_lsh_search_recall(spark):
    """Of the pairs at or above the threshold, 0.9 at least are found."""
    r = random.Random(4)
    words = [f"word{i}" for i in range(4000)]
    sets = {}
    for k in range(60):
        base = r.sample(words, 60)
        n = r.choice([20, 25, 30])
        sets[f"a{k}", "c"], sets[f"b{k}", "c"] = base, base[: 60 - n] + r.sample(words, n)
    dom = spark.createDataFrame([(t, c, v) for (t, c), vs in sets.items() for v in set(vs)], "t string, c string, v string")
    exact = {(x.qt, x.ct) for x in M.jaccard(dom).filter("score >= 0.5").collect()}
    k, l = S.recalling_bands(0.5, 64)
    found = {(x.qt, x.ct) for x in S.candidates(S.signatures(dom, 64), k, l).collect()}
    assert len(exact) >= 30 and len(exact & found) >= 0.9 * len(exact)
    assert {(x.qt, x.ct) for x in P.lsh_tables(dom).collect()} <= found


def test_search_picks_c_by_percentile(spark):
    """Among all pairs of a c, a product that is high for that c beats the higher product of fewer columns."""
    rows = [("q", f"x{k}", 1, 0.5 + k / 100, 0.0) for k in range(40)] + [("q", f"x{k}", 2, 0.01 * k, 0.0) for k in range(40)]
    scores = spark.createDataFrame(rows, "qt string, ct string, c bigint, score double, difference double")
    top = {r.ct: r for r in P.ranked_tables(P.c_percentiles(scores, 10), 40).collect()}
    assert top["x39"].c == 2 and top["x39"].score == 0.39 and top["x39"].pct == 1.0
    assert all(r.pct > 0 and r.minus <= r.pct <= r.plus for r in top.values())
    by = sorted(top.values(), key=lambda r: (-r.minus, -r.plus, r.ct))
    assert [r.rank for r in by] == list(range(1, len(by) + 1))


def test_size_clusters(spark):
    def plain(a, b):
        a, b, i, j, total = sorted(a), sorted(b), 0, 0, 0.0
        for _ in range(min(len(a), len(b)) - 1):
            x, y = abs(a[len(a) - 1 - i] - b[j]), abs(b[len(b) - 1 - j] - a[i])
            total += max(x, y)
            i, j = (i, j + 1) if x < y else (i + 1, j)
        return round(total, 6)

    r = random.Random(1)
    tables = {f"t{k}": [r.randrange(50) / 2 for _ in range(r.randrange(1, 6))] for k in range(8)}
    df = spark.createDataFrame([(t, f"c{i}", x) for t, xs in tables.items() for i, x in enumerate(xs)], "t string, c string, len double")
    assert {(x.qt, x.ct): x.score for x in A.size_cluster_scores(df).collect()} == {(a, b): plain(tables[a], tables[b]) for a, b in itertools.permutations(tables, 2)}


def test_k_unionable(spark):
    edges = [("q", "c", "1", "a"), ("q", "c", "2", "a"), ("q", "c", "2", "b"), ("q", "d", "1", "a"), ("q", "d", "2", "a")]
    got = {r.ct: (r.soft, r.hard) for r in A.k_unionable(spark.createDataFrame(edges, "qt string, ct string, qc string, cc string"), 2).collect()}
    assert got == {"c": (True, True), "d": (False, False)}


def test_base_tables(spark):
    rows = [("a", 9, ["x", "y", "z"]), ("b", 8, ["X", "y", "z"]), ("c", 7, ["p", "q", "r"]), ("d", 99, ["s", "t", "u"]), ("e", 5, ["v"])]
    df = spark.createDataFrame(rows, "t string, n_rows bigint, header array<string>")
    assert E.base_tables(df, rows=50, columns=2, edits=2) == ["a", "c"]


def test_cosine_bands(spark):
    x = np.random.default_rng(2).standard_normal((80, 64))
    x[40:] = x[:40] + 0.05 * np.random.default_rng(3).standard_normal((40, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {(r.vec_id, r.other) for r in S.cosine_candidates(df, "vec_id", "embedding", 8, 5).collect()}
    assert sum((k, k + 40) in found for k in range(40)) >= 36
    deep = {(r.vec_id, r.other): r.depth for r in S.cosine_forest(df, "vec_id", "embedding", 12, 4, 8).collect()}
    assert sum((k, k + 40) in deep for k in range(40)) >= 36 and min(deep.values()) >= 8 and max(deep.values()) <= 12


@pytest.mark.parametrize("rows", [[], [("t", "c", None)], [("t", "c", "one two")], [("t", "c", "one two"), ("u", "c", "one two"), ("u", "c", "one two"), (None, None, "x y z w v u")]])
def test_odd_domains(spark, rows):
    """Nulls, repeated rows and empty tables give what they must, and no error."""
    cells = spark.createDataFrame(rows, "t string, c string, v string")
    dom = D.domains(cells)
    assert M.jaccard(dom).count() == (2 if len(rows) > 2 else 0)
    assert D.words(dom).count() >= 0 and D.tokens(dom).filter(F.col("v").isNull()).count() == 0
    assert S.signatures(dom, 8).count() == len({(t, c) for t, c, v in rows if v})
    assert A.top_n(A.completed(M.jaccard(dom), 1, 5).select("qt", "ct", "score"), 1).count() == (2 if len(rows) > 2 else 0)


def test_clashing_names(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "_own int, _rank string")
    assert E.row_expansion(a, a, {"_own": "_own", "_rank": "_rank"}).first() == (2, 2)
    assert E.slices(a, ["_own", "_rank"]).count() == 2
    assert E.stratified(a, "_own", F.col("_rank"), 0.5).columns == ["_own", "_rank"]


def test_band_search(spark):
    """It finds all columns that are much alike, and ranks slices of one base table first."""
    d = "/root/testdata/sf0.001"
    met = {(r.qt, r.qc, r.ct, r.cc) for r in P.band_measures(spark, d).collect()}
    exact = {(r.qt, r.qc, r.ct, r.cc) for r in P.measures(spark, d).filter("(measure in ('set', 'sem') and score >= 0.5) or (measure = 'nl' and score >= 0.9)").collect()}
    assert exact and len(exact & met) >= 0.9 * len(exact)
    first = {(r.qt, r.ct) for r in P.band_tables(spark, d).filter("rank = 1").collect()}
    assert len(first) >= 3 and first <= {(r.qt, r.ct) for r in L.truth(P.slice_freq(spark, d)).collect()}


def shuffled(spark, df):
    """Rows of df, and how many bytes its stages shuffle."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gw = spark.sparkContext._gateway
        none = gw.jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gw.new_array(gw.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return df().collect(), total() - before


def test_band_pairs_stay_where_they_are(spark):
    """What is shuffled are bands, not their pairs; ids that come twice give no pair twice, and the deepest band counts."""
    x = np.repeat(np.random.default_rng(4).standard_normal((1, 64)), 400, axis=0)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist()), (7, (-x[7]).tolist()), (8, (x[8] + 0.1).tolist()), (900, (-x[0]).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4).cache()
    want = {(a, b) for a in range(400) for b in range(400) if a != b} | {(7, 900), (900, 7)}
    got, moved = shuffled(spark, lambda: S.cosine_candidates(df, "vec_id", "embedding", 8, 5))
    assert sorted((r.vec_id, r.other) for r in got) == sorted(want) and moved < 400_000
    got, moved = shuffled(spark, lambda: S.cosine_forest(df, "vec_id", "embedding", 12, 4, 8))
    assert {(r.vec_id, r.other) for r in got} == want and len(got) == len(want) and {r.depth for r in got} == {12} and moved < 400_000


def test_topk_blocks_stay_where_they_are(spark):
    """The pairs of blocks are not shuffled; equal scores go by id across blocks, and vectors without a length have no neighbour."""
    x = np.random.default_rng(5).standard_normal((600, 64))
    x[300:] = x[:300]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(1000, [0.0] * 64)], "vec_id bigint, embedding array<double>").cache()
    got, moved = shuffled(spark, lambda: S.topk_cosine(df, "vec_id", "embedding", 3, block=16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert {(r.vec_id, r["rank"]): r.other for r in got} == {(i, k + 1): int(j) for i in range(600) for k, j in enumerate(np.lexsort((np.arange(600), -s[i]))[:3])}
    assert moved < 3_000_000


def test_mean_vectors(spark, tmp_path):
    """Frequencies weigh the values; a word that comes twice in a value counts twice; no value's vector is spelt out."""
    import hashlib

    x = np.random.default_rng(6).standard_normal((50, 64))
    spark.createDataFrame([(k + (k > 40), v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    vec = {k + (k > 40): v.astype("f4").astype(float) for k, v in enumerate(x)}
    rows = [("t", c, f"word{k} word{k} {c}{k}", k % 5 + 1) for k in range(3000) for c in "ab"] + [("t", "a", "x " * 9, 7)]
    total, sums = {}, {}
    for t, c, v, n in rows[:-1]:
        hits = [vec[i] for i in (int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 50 for w in v.split()) if i in vec]
        if hits:
            total[c], sums[c] = total.get(c, 0) + n, sums.get(c, 0) + n * sum(hits)
    freq = spark.createDataFrame(rows, "t string, c string, v string, freq bigint").cache()
    got, moved = shuffled(spark, lambda: P.mean_vectors(spark, str(tmp_path), freq))
    assert sorted(r.c for r in got) == ["a", "b"] and moved < 600_000
    assert all(np.allclose(r["mean"], sums[r.c] / total[r.c], atol=1e-9) for r in got)
