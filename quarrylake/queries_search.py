"""More of the catalogue: searches by each measure, sketches of tokens and classes, samples, and what is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import text as X
from .operators import align as A
from .operators import annotate as O
from .operators import cdf as C
from .operators import domains as D
from .operators import evaluate as V
from .operators import expand as E
from .operators import measures as M
from .operators import sketches as S
from .operators import webtables as W
from .plans import lake as L
from .plans import search as P
from .plans import sql as Q
from .plans.store import stored
from .queries import _SARMA, HASHES, _signature, domain_classes, matches, r6, register, slice_domains

H = Q.hash32

# Text and vectors


@register("web_transform", r"""select v, lower(regexp_replace(regexp_replace(replace(replace(v, '(', ''), ')', ''), '^\s+|\s+$', '', 'g'), '^\p{P}+|\p{P}+$', '', 'g')) w from (select distinct p_name || '_(' || p_brand || ')' v from part)""")
def web_transform(s, d):
    return L.table(s, d, "part").select(F.concat("p_name", F.lit("_("), "p_brand", F.lit(")")).alias("v")).distinct().select("v", X.web_transform(F.col("v")).alias("w"))


@register("tokens_of_all_lengths", rf"select item_id, unnest({Q.tokens('text')}) w from benchmark")
def tokens_of_all_lengths(s, d):
    return L.table(s, d, "benchmark").select("item_id", F.explode(X.tokens(F.col("text"), None)).alias("w"))


@register("set_algebra", f"select p_partkey, array_to_string(list_sort(list_distinct(a)), ' ') u, array_to_string(list_sort(list_intersect(a, b)), ' ') i, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: not list_contains(b, x))), ' ') x from (select p_partkey, {Q.get_words('p_name')} a, {Q.get_words('p_type')} b from part)")
def set_algebra(s, d):
    a, b = X.get_words(F.col("p_name")), X.get_words(F.col("p_type"))
    flat = lambda x: F.array_join(F.array_sort(x), " ")
    return L.table(s, d, "part").select("p_partkey", flat(F.array_distinct(a)).alias("u"), flat(F.array_intersect(a, b)).alias("i"), flat(F.array_except(a, b)).alias("x"))


@register("finite_vectors", "select vec_id, len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 finite from (select vec_id, embedding from embeddings union all select -1 - vec_id, list_append(embedding, 'nan'::float) from embeddings)")
def finite_vectors(s, d):
    v = L.table(s, d, "embeddings").select("vec_id", "embedding")
    broken = v.select((-1 - F.col("vec_id")).alias("vec_id"), F.concat("embedding", F.array(F.lit(float("nan")).cast("float"))).alias("embedding"))
    return v.unionAll(broken).select("vec_id", N.finite(F.col("embedding")).alias("finite"))


@register("column_ids", "select page_id, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) || '_c' || (page_id % 7) id, nullif(regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1), '') t, page_id % 7 c from pages")
def column_ids(s, d):
    p = L.table(s, d, "pages").select("page_id", X.column_id(F.col("url"), F.col("page_id") % 7).alias("id"))
    t, c = X.parsed_column_id(F.col("id"))
    return p.select("page_id", "id", t.alias("t"), c.alias("c"))


@register("self_union", "select qt, ct, bool_and(lower(qc) = lower(cc)) self_union from jal group by qt, ct")
def self_union(s, d):
    return A.greedy(M.jaccard(slice_domains(s, d))).groupBy("qt", "ct").agg(F.bool_and(F.lower("qc") == F.lower("cc")).alias("self_union"))


# Domains


@register("table_profile", "select t, count(*) // count(distinct c) n_rows, count(distinct c) n_columns, count(distinct (c, v)) n_distinct from lake group by t")
def table_profile(s, d):
    own = L.lake(s, d).groupBy("t", "c").agg(F.count("*").alias("rows"), F.countDistinct(F.struct("v")).alias("n"))
    return own.groupBy("t").agg(F.max("rows").alias("n_rows"), F.count("*").alias("n_columns"), F.sum("n").alias("n_distinct"))


@register("text_column_counts", "select a.t qt, b.t ct, a.n nq, b.n nc, a.n * b.n pairs from (select t, count(distinct c) n from dom where regexp_matches(v, '[a-zA-Z]{2,}') group by t) a join (select t, count(distinct c) n from dom where regexp_matches(v, '[a-zA-Z]{2,}') group by t) b on a.t < b.t")
def text_column_counts(s, d):
    n = D.domains(L.lake(s, d)).filter(X.is_text(F.col("v"))).groupBy("t").agg(F.countDistinct("c").alias("n"))
    q, c = n.select(F.col("t").alias("qt"), F.col("n").alias("nq")), n.select(F.col("t").alias("ct"), F.col("n").alias("nc"))
    return q.join(c, F.col("qt") < F.col("ct")).withColumn("pairs", F.col("nq") * F.col("nc"))


@register("score_histogram", f"select bin, count(*) n from (select least(floor(score * 50), 49)::bigint bin from meas order by {H("concat_ws('|', measure, qt, qc, ct, cc)")}, measure, qt, qc, ct, cc limit 500) group by bin")
def score_histogram(s, d):
    """Of 500 pairs at random (by a hash), a tenth as many bins."""
    m = P.measures(s, d)
    some = m.orderBy(X.hash32(F.concat_ws("|", "measure", "qt", "qc", "ct", "cc")), "measure", *M.PAIR).limit(500)
    return some.groupBy(F.least(F.floor(F.col("score") * 50), F.lit(49)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@register("minhash_tokens", _signature("ltok"), ltok="select distinct t, c, unnest(w) v from (select t, c, " + Q.tokens("v") + " w, len(string_split(" + Q.normalised("v") + ", ' ')) n from dom) where n <= 5")
def minhash_tokens(s, d):
    return S.signatures(D.tokens(D.domains(L.lake(s, d))), HASHES)


@register("minhash_classes", _signature("classes"))
def minhash_classes(s, d):
    return S.signatures(domain_classes(s, d).select("t", "c", F.col("class").alias("v")), HASHES)


_ONT = {"known": "select distinct t, c, unnest(w) v from (select t, c, " + Q.tokens("v") + " w, len(string_split(" + Q.normalised("v") + ", ' ')) n from sdom where v not in (select v from matches)) where n <= 5"}


@register("ontology_domains", f"select coalesce(o.t, n.t, x.t) t, coalesce(o.c, n.c, x.c) c, o.sig ont, n.sig no_ont, x.sig val, coalesce(o.card, 0)::bigint ont_card, coalesce(n.card, 0)::bigint no_ont_card, coalesce(x.card, 0)::bigint val_card from ({_signature('sdom')}) x full join ({_signature('classes')}) o on o.t = x.t and o.c = x.c full join ({_signature('known')}) n on n.t = x.t and n.c = x.c", **_ONT)
def ontology_domains(s, d):
    """Of each domain the signatures of its classes, of the tokens of what no entity matches, and of its values, with their cardinalities."""
    dom = slice_domains(s, d)
    m = matches(s, d, dom)
    sets = {"ont": O.classes(dom, m, L.types(s, d)).select("t", "c", F.col("class").alias("v")), "no_ont": D.tokens(O.unannotated(dom, m)), "val": dom}
    out = None
    for name, x in sets.items():
        sig = S.signatures(x, HASHES).withColumnsRenamed({"sig": name, "card": f"{name}_card"})
        out = sig if out is None else out.join(sig, ["t", "c"], "full")
    return out.fillna(0, [f"{n}_card" for n in sets])


@register("strict_value_embedding", "select distinct v from vtok where v not in (select v from vtok where word not in (select word from vocab))", vocab=f"select distinct unnest({Q.get_words('p_name')}) word from part")
def strict_value_embedding(s, d):
    """Values all of whose tokens the vocabulary has, so that they have a vector in the strict sense."""
    known = L.table(s, d, "part").select(F.explode(X.get_words(F.col("p_name"))).alias("word")).distinct()
    tokens = slice_domains(s, d).select("v").distinct().select("v", F.explode(X.tokens(F.col("v"))).alias("word"))
    return tokens.select("v").distinct().join(tokens.join(known, "word", "left_anti").select("v"), "v", "left_anti")


@register("domain_sum_embedding", "select t, c, i, round(sum(freq * x), 4) total, round(sum(x), 4) unweighted from sfreq join vcomp using (v) group by all")
def domain_sum_embedding(s, d):
    e = P.embedded_values(s, d, P.slice_freq(s, d))
    return e.groupBy("t", "c", "i").agg(F.round(F.sum(F.col("freq") * F.col("x")), 4).alias("total"), F.round(F.sum("x"), 4).alias("unweighted"))


@register("class_histogram_up", "select t, c, super as class, count(*) n from (select distinct t, c, entity, super from (select distinct t, c, entity from sdom join matches using (v)) join types using (entity) join (select distinct * from taxonomy) on category = sub) group by all")
def class_histogram_up(s, d):
    """Entities of each domain by the classes above theirs."""
    dom = slice_domains(s, d)
    up = L.types(s, d).join(O.parents(L.taxonomy(s, d)), F.col("category") == F.col("sub")).select("entity", F.col("super").alias("category"))
    return O.classes(dom, matches(s, d, dom), up).withColumnRenamed("freq", "n")


@register("entity_counts", "select t, c, entity, count(*) n from sdom join matches using (v) group by all")
def entity_counts(s, d):
    """How many values of a domain an entity stands for."""
    dom = slice_domains(s, d)
    return dom.join(matches(s, d, dom), "v").groupBy("t", "c", "entity").agg(F.count("*").alias("n"))


@register("class_counts", "select t, c, category as class, sum(n)::bigint n from (select t, c, entity, count(*) n from sdom join matches using (v) group by all) join types using (entity) group by all")
def class_counts(s, d):
    """Values of a domain by the classes of their entities."""
    return entity_counts(s, d).join(L.types(s, d), "entity").groupBy("t", "c", F.col("category").alias("class")).agg(F.sum("n").alias("n"))


_ENT = {"ents": "select distinct t, c, entity v from sdom join matches using (v)", "onts": "select distinct t, c, v from classes", "onts2": "select distinct t, c, super v from onts join taxonomy on v = sub union select t, c, v from onts"}


@register("shared_entities", "select distinct a.t qt, a.c qc, b.t ct, b.c cc from ents a join ents b on lower(a.v) = lower(b.v) and a.t <> b.t", **_ENT)
def shared_entities(s, d):
    e = entity_counts(s, d).select("t", "c", F.lower("entity").alias("v"))
    return M.overlaps(e.distinct()).select(*M.PAIR)


@register("entity_jaccard", Q.jaccards("ents"), **_ENT)
def entity_jaccard(s, d):
    return M.jaccard(entity_counts(s, d).select("t", "c", F.col("entity").alias("v")))


@register("ontology_plus_jaccard", Q.jaccards("onts2"), **_ENT)
def ontology_plus_jaccard(s, d):
    """Jaccard of the classes and those above them."""
    own = domain_classes(s, d).select("t", "c", F.col("class").alias("v"))
    up = own.join(O.parents(L.taxonomy(s, d)), F.col("v") == F.col("sub")).select("t", "c", F.col("super").alias("v"))
    return M.jaccard(own.unionAll(up).distinct())


@register("coverage_summary", "select count(*) n_domains, count(*) filter (n_annotated > 0) n_with_entities, sum(n_annotated)::bigint n_annotated, sum(n_unannotated)::bigint n_unannotated, round(avg(n_annotated / (n_annotated + n_unannotated)), 6) mean_share from annotated")
def coverage_summary(s, d):
    dom = slice_domains(s, d)
    a = O.partial_annotation(dom, matches(s, d, dom))
    return a.agg(F.count("*").alias("n_domains"), F.count(F.when(F.col("n_annotated") > 0, 1)).alias("n_with_entities"), F.sum("n_annotated").alias("n_annotated"), F.sum("n_unannotated").alias("n_unannotated"), r6(F.avg(F.col("n_annotated") / (F.col("n_annotated") + F.col("n_unannotated")))).alias("mean_share"))


@register("entropy_change", "select a.p_brand a, b.p_brand b, round(m.e - a.e, 6) change from (select p_brand, sum(-p * ln(p)) e from shares group by p_brand) a join (select p_brand from shares group by p_brand) b on a.p_brand < b.p_brand join (select x, y, sum(-n / t * ln(n / t)) e from (select x, y, p_type, sum(n) n, any_value(t)::double t from (select g.x, g.y, p.p_type, p.n, sum(p.n) over (partition by g.x, g.y) t from (select a.p_brand x, b.p_brand y from brands a join brands b on a.p_brand < b.p_brand) g join (select p_brand, p_type, count(*) n from part group by all) p on p.p_brand in (g.x, g.y)) group by all) group by all) m on m.x = a.p_brand and m.y = b.p_brand", brands="select distinct p_brand from part", shares="select p_brand, p_type, n / sum(n) over (partition by p_brand)::double p from (select p_brand, p_type, count(*) n from part group by all)")
def entropy_change(s, d):
    """The entropy of the classes of two groups together less that of the first alone."""
    h = L.table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    of = lambda df, by: O.distribution(df, by, "n").groupBy(*by).agg(F.sum(N.entropy(F.col("p"))).alias("e"))
    own = of(h, ["p_brand"])
    groups = own.select(F.col("p_brand").alias("a"), F.col("e").alias("ea")).join(own.select(F.col("p_brand").alias("b")), F.col("a") < F.col("b"))
    both = groups.withColumn("p_brand", F.explode(F.array("a", "b"))).join(h, "p_brand").groupBy("a", "b", "p_type").agg(F.sum("n").alias("n"))
    return of(both, ["a", "b"]).join(groups, ["a", "b"]).select("a", "b", r6(F.col("e") - F.col("ea")).alias("change"))


# Measures


@register("strict_hypergeom", """select qt, qc, ct, cc, round(case when k = least(nq, nc) and nq <> nc then 0.0 else coalesce(list_sum(list_transform(range(0, k), lambda i: exp(lgamma(nq + 1) - lgamma(i + 1) - lgamma(nq - i + 1) + lgamma(nc + 1) - lgamma(nc - i + 1) - lgamma(i + 1) - lgamma(nq + nc + 1) + lgamma(nc + 1) + lgamma(nq + 1)))), 0.0) end, 6) score
    from (select *, least(floor(score * (nq + nc) / (1 + score)), nq, nc)::bigint k from jac)""")
def strict_hypergeom(s, d):
    return M.strict_hypergeometric(M.jaccard(slice_domains(s, d)))


@register("sem_probability", """select qt, qc, ct, cc, round(list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(nq + 1) - lgamma(i + 1) - lgamma(nq - i + 1) + lgamma(nc + 1) - lgamma(nc - i + 1) - lgamma(i + 1) - lgamma(nq + nc + 1) + lgamma(nc + 1) + lgamma(nq + 1)))), 6) score
    from (select *, least(floor(score * (nq + nc) / (1 + score)), nq, nc)::bigint k from sem)""")
def sem_probability(s, d):
    return M.hypergeometric(M.jaccard(domain_classes(s, d).select("t", "c", F.col("class").alias("v"))))


_HIST = {"hist": "select t, c, v as class, freq, n from classes join (select t, c, count(distinct entity) n from sdom join matches using (v) join (select distinct entity from types) using (entity) group by all) using (t, c)"}
for _name, (_a, _b, _m, _n) in {"class_dot_product": (1, 1, 1, 0), "class_dot_squares": (2, 2, 2, 2), "class_dot_d": (2, 2, 1, 1)}.items():

    @register(_name, f"select a.t qt, a.c qc, b.t ct, b.c cc, round(sum(a.freq ** {_a} / a.n ** {_m} * b.freq ** {_b} / b.n ** {_n}), 8) score from hist a join hist b on a.class = b.class and a.t <> b.t group by all", **_HIST)
    def class_dot_product(s, d, p=(_a, _b, _m, _n)):
        dom = slice_domains(s, d)
        m = matches(s, d, dom)
        n = dom.join(m, "v").join(L.types(s, d).select("entity").distinct(), "entity").groupBy("t", "c").agg(F.countDistinct("entity").alias("n"))
        return M.dot_products(O.classes(dom, m, L.types(s, d)).join(n, ["t", "c"]), *map(float, p))


@register("closest_vectors", "select a.g a, b.g b, round(max(list_cosine_similarity(a.v, b.v)), 6) cosine, round(max(list_distance(a.v, b.v)), 6) distance from vecs a join vecs b on a.g < b.g group by all", vecs="select label g, list(m order by i) v from (select label, vec_id % 3 part, i, avg(embedding[i]::double) m from embeddings, unnest(range(1, 65)) u(i) group by all) group by label, part")
def closest_vectors(s, d):
    """Of the vectors of two groups (here three means of each label's) the highest cosine and the greatest distance."""
    v = L.table(s, d, "embeddings").withColumn("part", F.col("vec_id") % 3)
    m = M.gathered(M.component_means(v, ["label", "part"], "embedding"), ["label", "part"]).select(F.col("label").alias("g"), F.col("mean").alias("vec"))
    return M.best_of_vectors(m, m)


@register("sum_cosine", "select a.label a, b.label b, round(list_cosine_similarity(a.v, b.v), 6) score from (select label, list(total order by i) v from embm group by label) a join (select label, list(total order by i) v from embm group by label) b on a.label < b.label")
def sum_cosine(s, d):
    """Cosine of the sums of vectors."""
    t = M.component_means(L.table(s, d, "embeddings"), ["label"], "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "total"))).alias("r")).select("label", F.col("r.total").alias("v"))
    return t.select(F.col("label").alias("a"), F.col("v").alias("x")).join(t.select(F.col("label").alias("b"), F.col("v").alias("y")), F.col("a") < F.col("b")).select("a", "b", r6(N.cosine(F.col("x"), F.col("y"))).alias("score"))


@register("four_measures", "select qt, qc, ct, cc, measure, score from meas union all select qt, qc, ct, cc, 'semset', 0.0::double from sem")
def four_measures(s, d):
    """All measures of all pairs; the one of classes and values together is 0 where there are classes."""
    m = P.measures(s, d)
    return m.unionByName(m.filter("measure = 'sem'").withColumns({"measure": F.lit("semset"), "score": F.lit(0.0)}))


@register("ensemble_ties", "select qt, qc, ct, cc, any_value(minus) minus, any_value(plus) plus, string_agg(measure, '+' order by case measure when 'nl' then 0 when 'set' then 1 else 2 end) measures from (select * from pcts qualify rank() over (partition by qt, qc, ct, cc order by minus desc, plus desc) = 1) group by all")
def ensemble_ties(s, d):
    m = P.measures(s, d)
    return C.tied_ensemble(C.with_percentile(m, C.equi_depth(m, P.BINS)))


@register("width_lookup", "select qt, qc, ct, cc, m.measure, m.score, case when m.score > 0 then coalesce((select arg_max(w.pct, w.bin) from ew w where w.measure = m.measure and w.bin <= least(floor(m.score * 20), 19)), 0.0) else 0.0 end pct from meas m", ew="select measure, bin, round(sum(n) over (partition by measure order by bin) / sum(n) over (partition by measure)::double, 6) pct from (select measure, least(floor(score * 20), 19)::bigint bin, sum(n)::bigint n from (select measure, round(least(score, 1.0), 4) score, count(*) n from meas group by all) group by all)")
def width_lookup(s, d):
    m = P.measures(s, d)
    return C.width_percentile(m, C.equi_width(m, 20), 20).select(*M.PAIR, "measure", "score", "pct")


@register("one_measure_percentile", "select qt, qc, ct, cc, score, minus, pct, plus from pcts where measure = 'sem'")
def one_measure_percentile(s, d):
    m = P.measures(s, d)
    return C.with_percentile(m, C.equi_depth(m, P.BINS)).filter("measure = 'sem'").select(*M.PAIR, "score", "minus", "pct", "plus")


# Search by one measure


def completed_sql(pairs: str, ks: str = "2") -> tuple[str, dict[str, str]]:
    return f"select k, qt, ct, score, row_number() over (partition by k, qt order by score desc, ct) rank from xal where k in ({ks}) qualify rank <= 10", Q.greedy("xal", pairs)


def sweep(pairs: DataFrame, ks: tuple[int, ...] = (2,), n: int = 10) -> DataFrame:
    """The n best tables with k aligned columns of each query, for each k: k, qt, ct, score (of the k-th pair), rank."""
    rank = F.row_number().over(Window.partitionBy("k", "qt").orderBy(F.desc("score"), "ct"))
    return A.greedy(pairs).filter(F.col("k").isin(*ks)).select("k", "qt", "ct", "score").withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n)


_SET, _SETC = completed_sql("jac", "1, 2, 3")
_SEM, _SEMC = completed_sql("sem", "1, 2")
_NL, _NLC = completed_sql("nlp", "1, 2, 3")


@register("set_search", _SET, **_SETC)
def set_search(s, d):
    return sweep(M.jaccard(slice_domains(s, d)), (1, 2, 3))


@register("ont_search", _SEM, **_SEMC)
def ont_search(s, d):
    return sweep(M.jaccard(domain_classes(s, d).select("t", "c", F.col("class").alias("v"))), (1, 2))


@register("emb_search", _NL, nlp="select * from nl where score > 0", **_NLC)
def emb_search(s, d):
    means = P.mean_vectors(s, d, P.slice_freq(s, d))
    return sweep(M.mean_cosine(stored(means, "means")).filter("score > 0"), (1, 2, 3))


@register("band_search")
def band_search(s, d):
    return P.band_tables(s, d)


@register("two_forest_candidates", f"select distinct qt, qc, ct, cc from ({{0}} union all {{1}})".replace("{0}", "select a.t qt, a.c qc, b.t ct, b.c cc from b1 a join b1 b on a.band = b.band and a.h = b.h and a.t <> b.t").replace("{1}", "select a.t, a.c, b.t, b.c from b2 a join b2 b on a.band = b.band and a.h = b.h and a.t <> b.t"), sig1=_signature("classes"), sig2=_signature("known"), b1="select t, c, j band, sig[2 * j + 1:2 * j + 2] h from sig1, unnest(range(16)) u(j)", b2="select t, c, j band, sig[2 * j + 1:2 * j + 2] h from sig2, unnest(range(16)) u(j)", **_ONT)
def two_forest_candidates(s, d):
    """Pairs that the classes' sketches or those of what has no entity bring together."""
    dom = slice_domains(s, d)
    m = matches(s, d, dom)
    sets = O.classes(dom, m, L.types(s, d)).select("t", "c", F.col("class").alias("v")), D.tokens(O.unannotated(dom, m))
    a, b = (S.candidates(stored(S.signatures(x, HASHES), "signatures"), 2, 16) for x in sets)
    return a.unionAll(b).distinct()


def _bits(k: int, l: int) -> str:
    sign = H("b || '|' || i")
    return f"select vec_id, b // {k} band, string_agg(bit, '' order by b) head from (select vec_id, b, case when sum(embedding[i + 1]::double * case when {sign} % 2 = 1 then 1 else -1 end) >= 0 then '1' else '0' end bit from embeddings, unnest(range({k * l})) x(b), unnest(range(64)) y(i) group by vec_id, b) group by vec_id, b // {k}"


@register("cosine_lsh", "select distinct a.vec_id, b.vec_id other from vb a join vb b on a.band = b.band and a.head = b.head and a.vec_id <> b.vec_id", vb=_bits(8, 5))
def cosine_lsh(s, d):
    return S.cosine_candidates(L.table(s, d, "embeddings"), "vec_id", "embedding", 8, 5)


@register("cosine_forest", "select a.vec_id, b.vec_id other, max(case " + " ".join(f"when a.head[1:{n}] = b.head[1:{n}] then {n}" for n in range(12, 7, -1)) + " end)::bigint depth from vb a join vb b on a.band = b.band and a.head[1:8] = b.head[1:8] and a.vec_id <> b.vec_id group by all", vb=_bits(12, 4))
def cosine_forest(s, d):
    return S.cosine_forest(L.table(s, d, "embeddings"), "vec_id", "embedding", 12, 4, 8)


@register("limited_index", "select distinct a.vec_id, b.vec_id other from vb a join vb b on a.band = b.band and a.head = b.head and a.vec_id <> b.vec_id where a.vec_id in (select vec_id from embeddings order by vec_id limit 200) and b.vec_id in (select vec_id from embeddings order by vec_id limit 200)", vb=_bits(8, 5))
def limited_index(s, d):
    """An index of the first vectors only, as its growth is measured."""
    return S.cosine_candidates(L.table(s, d, "embeddings").orderBy("vec_id").limit(200), "vec_id", "embedding", 8, 5)


@register("preview_search", "select a.qt, a.ct, a.k, a.qc, a.cc, a.score jaccard, bool_and(lower(a.qc) = lower(a.cc)) over (partition by a.qt, a.ct) self_union from jal a")
def preview_search(s, d):
    """Aligned pairs with their exact similarity, and whether the table is the query's own kind."""
    al = A.greedy(M.jaccard(slice_domains(s, d)))
    return al.select("qt", "ct", "k", "qc", "cc", F.col("score").alias("jaccard"), F.bool_and(F.lower("qc") == F.lower("cc")).over(Window.partitionBy("qt", "ct")).alias("self_union"))


@register("column_search", "select qt, qc, ct, cc, n.score cosine, coalesce(j.score, 0.0) jaccard, coalesce(o.score, 0.0) containment, row_number() over (partition by qt, qc order by n.score desc, ct, cc) rank from nl n left join jac j using (qt, qc, ct, cc) left join cont o using (qt, qc, ct, cc) where n.score is not null qualify rank <= 5", cont="select a.t qt, a.c qc, b.t ct, b.c cc, round(count(*) / any_value(n)::double, 6) score from sdom a join sdom b on a.v = b.v and a.t <> b.t join (select t, c, count(*) n from sdom group by all) n1 on n1.t = a.t and n1.c = a.c group by a.t, a.c, b.t, b.c")
def column_search(s, d):
    """The nearest columns of each column by their mean vectors, with Jaccard and containment of the values."""
    freq = P.slice_freq(s, d)
    dom = freq.select("t", "c", "v")
    near = M.mean_cosine(stored(P.mean_vectors(s, d, freq), "means")).withColumnRenamed("score", "cosine")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qt", "qc").orderBy(F.desc("cosine"), "ct", "cc")).cast("bigint")).filter("rank <= 5")
    out = near
    for name, x in (("jaccard", M.jaccard(dom)), ("containment", M.containment(dom))):
        out = out.join(x.select(*M.PAIR, F.col("score").alias(name)), list(M.PAIR), "left").fillna(0.0, [name])
    return out


# Alignment and clusters


@register("octopus_text_cluster", "select qt, ct, max(score) score from cosal group by qt, ct")
def octopus_text_cluster(s, d):
    return A.greedy(W.cosines(W.tfidf(P.slice_freq(s, d))).withColumn("score", r6("score"))).groupBy("qt", "ct").agg(F.max("score").alias("score"))


_WALK = "case when abs(a[len(a) - i] - b[j + 1]) < abs(b[len(b) - j] - a[i + 1]) then {} else {} end"


@register("octopus_size_cluster", "select qt, ct, round(s, 6) score from walk_w where step = m - 1", sl="select t, list(len order by len) l from lens group by t", walk_w=f"select p.t qt, q.t ct, p.l a, q.l b, least(len(p.l), len(q.l)) m, 0 step, 0 i, 0 j, 0.0::double s from sl p join sl q on p.t <> q.t union all select qt, ct, a, b, m, step + 1, {_WALK.format('i', 'i + 1')}, {_WALK.format('j + 1', 'j')}, s + greatest(abs(a[len(a) - i] - b[j + 1]), abs(b[len(b) - j] - a[i + 1])) from walk_w where step < m - 1")
def octopus_size_cluster(s, d):
    return A.size_cluster_scores(W.mean_lengths(L.slice_cells(s, d)))


@register("k_unionable")
def k_unionable(s, d):
    return A.k_unionable(M.jaccard(slice_domains(s, d)).filter("score > 0.1"), 2)


@register("bucketized_sarma_score", "select qt, ct, round(ece * sc, 8) score from ece join sc using (qt, ct) where ece > 0 and ece * sc <> 0 and exists (select 1 from lab a join lab b on a.v = b.v where a.t = ece.qt and b.t = ece.ct)", **_SARMA)
def bucketized_sarma_score(s, d):
    """Only tables with a label in common, a column's name or class, are scored."""
    from .queries import _complement, _consistency

    dom = slice_domains(s, d)
    labels = dom.select("t", F.col("c").alias("v")).unionAll(domain_classes(s, d).select("t", F.col("class").alias("v"))).distinct()
    pairs = labels.select(F.col("t").alias("qt"), "v").join(labels.select(F.col("t").alias("ct"), "v"), "v").filter("qt <> ct").select("qt", "ct").distinct()
    both = _complement(s, d, dom).filter("ece > 0").join(pairs, ["qt", "ct"], "left_semi").join(_consistency(s, d, dom), ["qt", "ct"])
    return both.filter("ece * sc <> 0").select("qt", "ct", F.round(F.col("ece") * F.col("sc"), 8).alias("score"))


# Joins


@register("case_blind_join", "select p_partkey, b from part join (select distinct upper(p_brand) b from part where p_size > 25) on lower(p_brand) = lower(b)")
def case_blind_join(s, d):
    p = L.table(s, d, "part")
    b = p.filter("p_size > 25").select(F.upper("p_brand").alias("b")).distinct()
    return p.join(b, F.lower("p_brand") == F.lower("b")).select("p_partkey", "b")


@register("truth_with_enough_columns", "select qt, ct, s.c, g.c true_c from cs s join gc g using (qt, ct) where s.c >= g.c", gc="select qt, ct, count(*) c from truth group by all")
def truth_with_enough_columns(s, d):
    """Results that align at least as many columns as the truth of the pair has."""
    scores = A.c_unionability(P.aligned(s, d), score="pct").select("qt", "ct", "c")
    true = L.truth(slice_domains(s, d)).groupBy("qt", "ct").agg(F.count("*").alias("true_c"))
    return scores.join(true, ["qt", "ct"]).filter("c >= true_c")


# Expansion, samples, evaluation


@register("combined_expansion", """select qt, ct, count(*) as columns, sum(added)::bigint added, (select count(*) from srow y where y.t = x.ct and y.r not in (select r from srow z where z.t = x.qt)) rows_added
    from (select qt, ct, (select count(*) from sdom y where y.t = j.ct and y.c = j.cc and y.v not in (select v from sdom x where x.t = j.qt and x.c = j.qc)) added from jal j) x group by qt, ct""", srow="select t, string_agg(v, '|' order by c) r from (select distinct t, c, v from sdom where c <> 'p_name') group by t, v")
def combined_expansion(s, d):
    dom = slice_domains(s, d)
    rows = dom.filter("c <> 'p_name'").groupBy("t", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.col("v")), "|").alias("row")).select("t", "row")
    return E.combined_expansion(dom, A.greedy(M.jaccard(dom)), rows)


@register("query_sample", f"select t from (select distinct t from annotated where n_entities > 0) order by {H('t')}, t limit 8")
def query_sample(s, d):
    """Tables with an entity, at random by a hash."""
    dom = slice_domains(s, d)
    return O.partial_annotation(dom, matches(s, d, dom)).filter("n_entities > 0").select("t").distinct().orderBy(X.hash32(F.col("t")), "t").limit(8)


@register("strata_sample", f"select t, stratum from (select t, case when bool_or(n_entities > 0) and bool_or(n_unannotated > 0) then 'ont+emb' when bool_or(n_entities > 0) then 'ont' else 'emb' end stratum from annotated group by t having count(*) >= 2) qualify row_number() over (partition by stratum order by {H('t')}, t) <= greatest(1, floor(count(*) over (partition by stratum) * 0.5))")
def strata_sample(s, d):
    """Half of the tables of each stratum: those with entities, with values of none, and with both."""
    dom = slice_domains(s, d)
    a = O.partial_annotation(dom, matches(s, d, dom)).groupBy("t").agg(F.count("*").alias("n"), F.bool_or(F.col("n_entities") > 0).alias("ont"), F.bool_or(F.col("n_unannotated") > 0).alias("emb")).filter("n >= 2")
    stratum = F.when(F.col("ont") & F.col("emb"), "ont+emb").when(F.col("ont"), "ont").otherwise("emb")
    return E.stratified(a.select("t", stratum.alias("stratum")), "stratum", F.col("t"), 0.5)


_ORDER = f"select n_nationkey i, n_regionkey l, row_number() over (order by {H('n_nationkey::varchar')}, n_nationkey) r from nation"


@register("negative_pairs", "select least(a.i, b.i) a, greatest(a.i, b.i) b from perm a join perm b on a.r < b.r and a.l <> b.l order by a.r, b.r limit (select count(*) from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey)", perm=_ORDER)
def negative_pairs(s, d):
    """As many pairs without a common class as there are with one."""
    n = L.table(s, d, "nation")
    return E.other_class_pairs(n, "n_nationkey", "n_regionkey", E.same_class_pairs(n, "n_nationkey", "n_regionkey").count())


@register("base_tables")
def base_tables(s, d):
    """Tables of the lake to make a benchmark from."""
    cols = L.lake(s, d).groupBy("t", "c").agg(F.count("*").alias("n")).groupBy("t").agg(F.max("n").alias("n_rows"), F.array_sort(F.collect_list("c")).alias("header"))
    return s.createDataFrame([(t, i + 1) for i, t in enumerate(E.base_tables(cols, columns=2, edits=2, rows=10**9))], "t string, place int")


@register("mean_average_precision", 'select round(avg(coalesce(ap, 0)), 6) "map", count(*) queries from (select distinct qt from topn) left join (select qt, avg(hits / rank) ap from (select qt, rank, y.ct is not null ok, sum(case when y.ct is null then 0 else 1 end) over (partition by r.qt order by rank) hits from topn r left join truth_t y using (qt, ct)) where ok group by qt) using (qt)')
def mean_average_precision(s, d):
    return V.mean_average_precision(P.top_tables(s, d), L.truth(slice_domains(s, d)))


@register("precision_by_k", """select k, round(avg(case when y.ct is null then 0.0 else 1.0 end), 6) "precision", count(*) results from (select k, qt, ct, row_number() over (partition by k, qt order by score desc, ct) rank from jal where k <= 3 qualify rank <= 10) x left join truth_t y using (qt, ct) group by k""")
def precision_by_k(s, d):
    dom = slice_domains(s, d)
    top = sweep(M.jaccard(dom), (1, 2, 3))
    return V.judged(top, L.truth(dom)).groupBy("k").agg(r6(F.avg("correct")).alias("precision"), F.count("*").alias("results"))


@register("header_precision", 'select qt, count(*) n, sum((lower(qc) like lower(cc))::int)::bigint correct, round(avg((lower(qc) like lower(cc))::int), 6) "precision" from jal group by qt')
def header_precision(s, d):
    return V.header_precision(A.greedy(M.jaccard(slice_domains(s, d))))


@register("attribute_cdf", "select bin, n, sum(n) over (order by bin)::bigint acc, round(sum(n) over (order by bin) / sum(n) over ()::double, 6) pct from (select least(floor(round(least(score, 1.0), 4) * 20), 19)::bigint bin, count(*) n from jac group by 1)")
def attribute_cdf(s, d):
    """Bins of equal width over all pairs of one measure."""
    scores = M.jaccard(slice_domains(s, d)).withColumn("measure", F.lit("set"))
    return C.equi_width(scores, 20).drop("measure")
