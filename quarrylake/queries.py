"""The catalogue: a query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
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
from .plans.store import kept, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
HASHES = 32


def register(name: str, sql: str | None = None, **more: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = Q.query(sql, more)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def slice_domains(s: SparkSession, d: str) -> DataFrame:
    return P.slice_freq(s, d).select("t", "c", "v")


def matches(s: SparkSession, d: str, dom: DataFrame) -> DataFrame:
    """The entities of the slices' values."""
    return kept(s, d, "matches", P.BASES, lambda: O.find_entities(dom.select("v").distinct(), O.inverted_index(L.types(s, d))))


# Domains


@register("domain_values", "select * from dom")
def domain_values(s, d):
    return D.domains(L.lake(s, d))


@register(
    "domain_type",
    """select t, c, sum(n)::bigint n_numeric, sum(x)::bigint n_text, case when sum(n) = 0 and sum(x) = 0 then 'unknown' when sum(n) > sum(x) then 'numeric' else 'text' end col_type
    from (select t, c, regexp_full_match(v, '\\d+(\\.\\d+)?')::int n, (not regexp_full_match(v, '\\d+(\\.\\d+)?') and regexp_matches(v, '[a-zA-Z]{2,}'))::int x
    from (select * from lake union all select 'part', 'p_size', p_size::varchar from part union all select 'customer', 'c_custkey', c_custkey::varchar from customer)) group by t, c""",
)
def domain_type(s, d):
    more = [D.cells(L.table(s, d, t), t, [c]) for t, c in (("part", "p_size"), ("customer", "c_custkey"))]
    return D.types(L.union([L.lake(s, d), *more]))


@register("value_freq", f"select t, c, lower({Q.trimmed('v')}) v, count(*) freq from lake where strlen({Q.trimmed('v')}) > 2 group by all")
def value_freq(s, d):
    return D.value_freq(L.lake(s, d))


@register("domain_card_size", f"select t, c, count(distinct lower({Q.trimmed('v')})) card, count(*) size from lake where strlen({Q.trimmed('v')}) > 2 group by all")
def domain_card_size(s, d):
    return D.sizes(L.lake(s, d))


@register("column_profile", "select t, c, count(*) n_rows, count(v) n_values, count(distinct v) n_distinct, round(avg(strlen(v)), 6) mean_bytes from lake group by t, c")
def column_profile(s, d):
    return D.profile(L.lake(s, d))


@register("vocabulary_coverage", f"""select t, c, sum(freq)::bigint n_values, count(*) n_distinct, sum(case when k then freq else 0 end)::bigint known_values, count(*) filter (k) known_distinct
    from (select *, v in (select v from vtok join (select distinct unnest({Q.get_words('p_name')}) word from part) using (word)) k from sfreq) group by all""")
def vocabulary_coverage(s, d):
    words = L.table(s, d, "part").select(F.explode(X.get_words(F.col("p_name"))).alias("word"))
    return D.coverage(L.slice_cells(s, d), words)


# Words


@register("words_from_line", "select w, count(*) n from (select unnest(regexp_split_to_array(lower(text), '[^a-z ]')) w from documents) group by w")
def words_from_line(s, d):
    return L.table(s, d, "documents").select(F.explode(X.words_from_line(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@register("get_words", f"select p_partkey, unnest({Q.get_words('p_name')}) w from part union all select item_id, unnest({Q.get_words('text')}) from benchmark")
def get_words(s, d):
    a = L.table(s, d, "part").select("p_partkey", F.explode(X.get_words(F.col("p_name"))).alias("w"))
    return a.unionAll(L.table(s, d, "benchmark").select("item_id", F.explode(X.get_words(F.col("text"))).alias("w")))


@register("tokenized_values", f"select v, unnest(w) w from (select v, {Q.tokens('v')} w, len(string_split({Q.normalised('v')}, ' ')) n from (select distinct p_name v from part union select text from benchmark union select c_name from customer)) where n <= 5")
def tokenized_values(s, d):
    v = [L.table(s, d, t).select(F.col(c).alias("v")) for t, c in (("part", "p_name"), ("benchmark", "text"), ("customer", "c_name"))]
    return L.union(v).distinct().select("v", F.explode(X.tokens(F.col("v"))).alias("w"))


@register("entity_words", f"select entity, count(*) words_count from (select entity, unnest({Q.entity_words('entity')}) w from (select distinct p_name || '_(' || p_brand || ')' entity from part)) group by entity")
def entity_words(s, d):
    e = L.table(s, d, "part").select(F.concat("p_name", F.lit("_("), "p_brand", F.lit(")")).alias("entity")).distinct()
    return e.select("entity", F.explode(X.entity_words(F.col("entity"))).alias("w")).groupBy("entity").agg(F.count("*").alias("words_count"))


_BIGRAMS = "list_transform(range(0, greatest(0, strlen({v}) - 1)), lambda i: substr(hex(encode(lower({v}))), (2 * i + 1)::int, 4))"


@register("dice_pairs", f"""select a, b, round(2.0 * len(list_filter(y, lambda g: list_contains(x, g))) / nullif(len(x) + len(y), 0), 6) dice from
    (select p.v a, q.v b, {_BIGRAMS.format(v='p.v')} x, {_BIGRAMS.format(v='q.v')} y from (select distinct p_name v from part) p, (select distinct p_name v from part) q)""")
def dice_pairs(s, d):
    v = L.table(s, d, "part").select("p_name").distinct()
    return v.select(F.col("p_name").alias("a")).crossJoin(v.select(F.col("p_name").alias("b"))).select("a", "b", r6(X.dice(F.col("a"), F.col("b"))).alias("dice"))


@register("value_consistency", f"""select a.t qt, b.t ct, round(avg(dice), 6) consistency from (select distinct t, v from sdom where c = 'p_type') a join (select distinct t, v from sdom where c = 'p_type') b on a.t <> b.t
    join (select p.v x1, q.v y1, 2.0 * len(list_filter({_BIGRAMS.format(v='q.v')}, lambda g: list_contains({_BIGRAMS.format(v='p.v')}, g))) / nullif(strlen(p.v) + strlen(q.v) - 2, 0) dice
    from (select distinct v from sdom where c = 'p_type') p, (select distinct v from sdom where c = 'p_type') q) on x1 = a.v and y1 = b.v where dice > 0 group by all""")
def value_consistency(s, d):
    v = slice_domains(s, d).filter("c = 'p_type'").select("t", "v")
    return v.select(F.col("t").alias("qt"), F.col("v").alias("x")).join(v.select(F.col("t").alias("ct"), F.col("v").alias("y")), F.col("qt") != F.col("ct")).withColumn("dice", X.dice(F.col("x"), F.col("y"))).filter("dice > 0").groupBy("qt", "ct").agg(r6(F.avg("dice")).alias("consistency"))


@register("cell_to_entity", """select page_id, regexp_extract(html, '<a href="[^"]*/([^"/]*)"', 1) entity from pages""")
def cell_to_entity(s, d):
    return L.table(s, d, "pages").select("page_id", X.cell_entity(F.col("html")).alias("entity"))


# Sets and sketches


@register("jaccard_exact", "select * from jac")
def jaccard_exact(s, d):
    return M.jaccard(slice_domains(s, d))


@register("lake_jaccard", Q.jaccards("lwords"))
def lake_jaccard(s, d):
    return M.jaccard(D.words(D.domains(L.lake(s, d))))


@register("containment_exact", "select a.t qt, a.c qc, b.t ct, b.c cc, round(count(*) / any_value(n)::double, 6) score from sdom a join sdom b on a.v = b.v and a.t <> b.t join (select t, c, count(*) n from sdom group by all) n1 on n1.t = a.t and n1.c = a.c group by a.t, a.c, b.t, b.c")
def containment_exact(s, d):
    return M.containment(slice_domains(s, d))


def _signature(dom: str, n: int = HASHES) -> str:
    least = ", ".join(f"min((a + {i} * b) % {S.PRIME})" for i in range(n))
    return f"select t, c, [{least}] sig, count(*) card from (select t, c, {Q.hash32('v')} a, {Q.hash32('v', 1)} b from {dom}) group by all"


def signatures(s, d):
    return S.signatures(slice_domains(s, d), HASHES)


@register("minhash_signature", _signature("dom"))
def minhash_signature(s, d):
    return S.signatures(D.domains(L.lake(s, d)), HASHES)


@register("minhash_jaccard", f"select a.t qt, a.c qc, b.t ct, b.c cc, round(len(list_filter(range(1, {HASHES + 1}), lambda i: a.sig[i] = b.sig[i])) / {HASHES}::double, 6) score from sig a join sig b on a.t <> b.t", sig=_signature("sdom"))
def minhash_jaccard(s, d):
    k = stored(signatures(s, d), "signatures")
    return M.sided(k.withColumnRenamed("sig", "x").drop("card"), "q").join(M.sided(k.withColumnRenamed("sig", "y").drop("card"), "c"), F.col("qt") != F.col("ct")).select(*M.PAIR, r6(S.estimated_jaccard(F.col("x"), F.col("y"))).alias("score"))


_K, _L = 4, 8
_BANDS = f"select t, c, j band, sig[{_K} * j + 1:{_K} * j + {_K}] h from sig, unnest(range({_L})) u(j)"


@register("lsh_candidates", "select distinct a.t qt, a.c qc, b.t ct, b.c cc from bands a join bands b on a.band = b.band and a.h = b.h and a.t <> b.t", sig=_signature("sdom"), bands=_BANDS)
def lsh_candidates(s, d):
    return S.candidates(stored(signatures(s, d), "signatures"), _K, _L)


@register(
    "lsh_forest_depth",
    f"select a.t qt, a.c qc, b.t ct, b.c cc, max(case {' '.join(f'when a.h[1:{k}] = b.h[1:{k}] then {k}' for k in range(_K, 0, -1))} end)::bigint depth from bands a join bands b on a.band = b.band and a.h[1] = b.h[1] and a.t <> b.t group by all",
    sig=_signature("sdom"), bands=_BANDS,
)
def lsh_forest_depth(s, d):
    return S.forest_depths(stored(signatures(s, d), "signatures"), _K, _L)


@register("novelty_filter", "select j.qt, j.qc, j.ct, j.cc from wjac j anti join (select a.t qt, a.c qc, b.t ct, b.c cc from bands a join bands b on a.band = b.band and a.h = b.h and a.t <> b.t) l using (qt, qc, ct, cc)", wjac=Q.jaccards("lwords"), sig=_signature("lwords"), bands=_BANDS)
def novelty_filter(s, d):
    words = stored(D.words(D.domains(L.lake(s, d))), "words")
    return M.jaccard(words).join(S.candidates(S.signatures(words, HASHES), _K, _L), list(M.PAIR), "left_anti").select(*M.PAIR)


@register("lsh_search")
def lsh_search(s, d):
    return P.lsh_tables(slice_domains(s, d))


_COMB = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@register("hypergeom_prob", f"""select qt, qc, ct, cc, round(list_sum(list_transform(range(0, k + 1), lambda i: exp({_COMB.format(n='nq', k='i')} + {_COMB.format(n='nc', k='(nc - i)')} - ({_COMB.format(n='(nq + nc)', k='nc')})))), 6) score
    from (select *, least(floor(score * (nq + nc) / (1 + score)), nq, nc)::bigint k from jac)""")
def hypergeom_prob(s, d):
    return M.hypergeometric(M.jaccard(slice_domains(s, d)))


# Embeddings


def components(s, d):
    return M.component_means(L.table(s, d, "embeddings"), ["label"], "embedding")


for _name, _col in (("embedding_sum", "total"), ("embedding_mean", "mean"), ("embedding_var", "var")):
    register(_name, f"select label, i, round({_col}, 5) {_col} from embm")(lambda s, d, c=_col: components(s, d).select("label", "i", F.round(c, 5).alias(c)))


@register("embedding_covariance", "select a.label, a.i, b.i j, round(covar_pop(a.x, b.x), 6) + 0.0 cov from (select vec_id, label, i - 1 i, embedding[i]::double x from embeddings, unnest(range(1, 65)) u(i)) a join (select vec_id, i - 1 i, embedding[i]::double x from embeddings, unnest(range(1, 65)) u(i)) b on a.vec_id = b.vec_id and a.i <= b.i group by all")
def embedding_covariance(s, d):
    return M.covariances(M.moments(L.table(s, d, "embeddings"), "label", "embedding", 64), "label")


def groups(s, d):
    return M.gathered(components(s, d), ["label"])


@register("embedding_cosine", "select a.label a, b.label b, round(list_cosine_similarity(a.mean, b.mean), 6) score from embg a join embg b on a.label < b.label")
def embedding_cosine(s, d):
    g = groups(s, d)
    return g.select(F.col("label").alias("a"), F.col("mean").alias("x")).join(g.select(F.col("label").alias("b"), F.col("mean").alias("y")), F.col("a") < F.col("b")).select("a", "b", r6(N.cosine(F.col("x"), F.col("y"))).alias("score"))


_POOLED = "list_transform(range(1, 65), lambda i: ((a.n - 1) * a.var[i] + (b.n - 1) * b.var[i]) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))"


@register("hotelling_t2", f"""select a, b, round(t2, 4) t2, round(abs((n - 1) - 64) * sign((n - 1) - 64) / abs(64 * ((n - 1) - 1)) * t2, 6) f from (select a, b, n, list_sum(list_transform(range(1, 65), lambda i: d2[i] * case when list_min(v) < 1e-4 then 1 / (v[i] + 1) else 1 / v[i] end)) t2
    from (select a.label a, b.label b, a.n + b.n n, {_POOLED} v, list_transform(range(1, 65), lambda i: (a.mean[i] - b.mean[i]) ** 2) d2 from embg a join embg b on a.label < b.label))""")
def hotelling_t2(s, d):
    g = groups(s, d)
    a, b = (g.select(F.col("label").alias(k), F.col("mean").alias(f"{k}m"), F.col("var").alias(f"{k}v"), F.col("n").alias(f"{k}n")) for k in "ab")
    t2 = M.hotelling(F.col("am"), F.col("av"), F.col("an"), F.col("bm"), F.col("bv"), F.col("bn"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("t", t2).select("a", "b", F.round("t", 4).alias("t2"), r6(M.f_statistic(F.col("t"), F.col("an"), F.col("bn"), F.lit(64))).alias("f"))


@register("embedding_topk", "select a.vec_id, b.vec_id other, round(list_cosine_similarity(a.v, b.v), 6) score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.vec_id) rank from e a join e b on a.vec_id <> b.vec_id qualify rank <= 5", e="select vec_id, embedding::double[] v from embeddings")
def embedding_topk(s, d):
    return S.topk_cosine(L.table(s, d, "embeddings"), "vec_id", "embedding")


@register("simhash_buckets", f"select vec_id, string_agg(bit, '' order by b) bucket from (select vec_id, b, case when sum(embedding[i + 1]::double * case when {Q.hash32(chr(39) + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} % 2 = 1 then 1 else -1 end) >= 0 then '1' else '0' end bit from embeddings, unnest(range(16)) x(b), unnest(range(64)) y(i) group by vec_id, b) group by vec_id")
def simhash_buckets(s, d):
    return S.simhash(L.table(s, d, "embeddings"), "vec_id", "embedding")


@register("value_embedding", "select v, i, round(x, 5) x from vcomp")
def value_embedding(s, d):
    e = P.embedded_values(s, d, P.slice_freq(s, d))
    return e.select("v", "i", F.round("x", 5).alias("x")).distinct()


@register("domain_embedding", "select t, c, i, round(mean, 5) mean from vmean")
def domain_embedding(s, d):
    m = P.mean_vectors(s, d, P.slice_freq(s, d))
    return m.select("t", "c", F.posexplode("mean").alias("i", "mean")).select("t", "c", F.col("i").cast("bigint").alias("i"), F.round("mean", 5).alias("mean"))


@register("nl_unionability", "select * from nl")
def nl_unionability(s, d):
    return M.mean_cosine(P.mean_vectors(s, d, P.slice_freq(s, d)))


@register("pca_components")
def pca_components(s, d):
    """The two leading components of each label's vectors."""
    return M.components(M.moments(L.table(s, d, "embeddings"), "label", "embedding", 64), "label", 2)


@register("biased_pca_components")
def biased_pca_components(s, d):
    return M.components(M.moments(L.table(s, d, "embeddings"), "label", "embedding", 64), "label", 2, biased=True)


# Ontology


@register("class_histogram", "select p_brand, p_type, count(*) n from part group by all")
def class_histogram(s, d):
    return L.table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


_SHARES = "select p_brand, p_type, n / sum(n) over (partition by p_brand)::double p from (select p_brand, p_type, count(*) n from part group by all)"


@register("entropy", "select p_brand, round(sum(-p * ln(p)), 6) entropy, round(sum(-p * ln(p)) / nullif(ln(count(*)), 0), 6) normalised from shares group by p_brand", shares=_SHARES)
def entropy(s, d):
    e = F.sum(N.entropy(F.col("p")))
    return O.distribution(class_histogram(s, d), ["p_brand"], "n").groupBy("p_brand").agg(r6(e).alias("entropy"), r6(F.try_divide(e, F.ln(F.count("*")))).alias("normalised"))


@register("kl_divergence", "select a.p_brand a, g.b, round(sum(case when q.p is null then 'inf'::double else a.p * ln(a.p / q.p) end), 6) kl from shares a join (select distinct p_brand b from shares) g on a.p_brand <> g.b left join shares q on q.p_brand = g.b and q.p_type = a.p_type group by all", shares=_SHARES)
def kl_divergence(s, d):
    return O.divergence(O.distribution(class_histogram(s, d), ["p_brand"], "n"), "p_brand", "p_type").select("a", "b", r6("kl").alias("kl"))


@register("entity_match", "select v, entity from matches")
def entity_match(s, d):
    return matches(s, d, slice_domains(s, d))


@register("entity_match_loose", "select distinct v, entity from vwords join idx using (word)")
def entity_match_loose(s, d):
    return O.find_entities(slice_domains(s, d), O.inverted_index(L.types(s, d)), strict=False)


@register("fts_rank", f"select v, entity, row_number() over (partition by v order by total, entity) rank from (select v, entity, total from (select v, len(w) n, unnest(w) word from (select v, list_distinct({Q.get_words('v')}) w from (select distinct v from sdom))) join (select distinct * from idx) using (word) group by v, entity, n, total having count(*) = n) qualify rank <= 3")
def fts_rank(s, d):
    return O.ranked_entities(slice_domains(s, d), O.inverted_index(L.types(s, d)))


@register("partial_annotation", "select * from annotated")
def partial_annotation(s, d):
    dom = slice_domains(s, d)
    return O.partial_annotation(dom, matches(s, d, dom))


@register("domain_classes", "select t, c, v as class, freq from classes")
def domain_classes(s, d):
    dom = slice_domains(s, d)
    return O.classes(dom, matches(s, d, dom), L.types(s, d))


@register("taxonomy_parents", "select distinct sub, super from taxonomy")
def taxonomy_parents(s, d):
    return O.parents(L.taxonomy(s, d))


@register("taxonomy_closure", "select sub, super, min(depth)::bigint depth from up_w group by all", up_w="select sub, super, 1 depth from taxonomy union all select u.sub, t.super, u.depth + 1 from up_w u join taxonomy t on t.sub = u.super")
def taxonomy_closure(s, d):
    return O.closure(L.taxonomy(s, d))


@register("ancestors", "select entity, category as class from types union select entity, super from types join taxonomy on category = sub")
def ancestors(s, d):
    return O.ancestors(L.types(s, d), L.taxonomy(s, d))


@register("subject_column", "select t, min(c) subject from annotated where n_entities > 0 group by t")
def subject_column(s, d):
    return O.subject_column(partial_annotation(s, d))


@register("sem_unionability", "select * from sem")
def sem_unionability(s, d):
    return M.jaccard(domain_classes(s, d).select("t", "c", F.col("class").alias("v")))


_SARMA = {
    "ecl": "select distinct t, entity, category as class from sdom join matches using (v) join types using (entity) join (select t, min(c) c from annotated where n_entities > 0 group by t) using (t, c)",
    "ecn": "select t, count(distinct entity)::double n from ecl group by t",
    "ecf": "select t, class, count(*) f from ecl group by all",
    "ecq": "select a.t qt, b.t ct, a.class, (a.f / an.n) ** 2 x, b.f, bn.n, (select count(*) from ecl x where x.t = b.t and x.class = a.class and x.entity in (select entity from ecl y where y.t = a.t)) common from ecf a join ecf b on a.class = b.class and a.t <> b.t join ecn an on an.t = a.t join ecn bn on bn.t = b.t",
    "ece": "select qt, ct, sum(x * ((f - common) / n) ** 2) ece from ecq group by all",
    "lab": "select t, c, c v from sdom union select t, c, v from classes",
    "labj": Q.jaccards("lab"),
    **Q.greedy("labal", "labj"),
    "sc": "select qt, ct, sum(score) / (any_value(nq) + any_value(nc) - count(*)) sc from labal join (select t qt, count(distinct c) nq from sdom group by t) using (qt) join (select t ct, count(distinct c) nc from sdom group by t) using (ct) group by all",
}


def _complement(s, d, dom):
    m = matches(s, d, dom)
    types = L.types(s, d)
    subject = O.subject_column(O.partial_annotation(dom, m)).withColumnRenamed("subject", "c")
    own = dom.join(m, "v").join(subject, ["t", "c"]).join(types, "entity").select("t", "entity", F.col("category").alias("class")).distinct()
    return O.entity_complement(own)


def _consistency(s, d, dom):
    labels = dom.select("t", "c", F.col("c").alias("label")).unionAll(O.classes(dom, matches(s, d, dom), L.types(s, d)).select("t", "c", F.col("class").alias("label")))
    counts = dom.groupBy("t").agg(F.countDistinct("c").alias("n"))
    return O.schema_consistency(A.greedy(O.label_similarity(labels)), counts)


@register("sarma_ece", "select qt, ct, round(ece, 8) ece from ece", **_SARMA)
def sarma_ece(s, d):
    return _complement(s, d, slice_domains(s, d)).select("qt", "ct", F.round("ece", 8).alias("ece"))


@register("sarma_schema", "select qt, ct, round(sc, 6) sc from sc", **_SARMA)
def sarma_schema(s, d):
    return _consistency(s, d, slice_domains(s, d)).select("qt", "ct", r6("sc").alias("sc"))


@register("sarma_score", "select qt, ct, round(ece * sc, 8) score from ece join sc using (qt, ct) where ece > 0 and ece * sc <> 0", **_SARMA)
def sarma_score(s, d):
    dom = slice_domains(s, d)
    return _complement(s, d, dom).filter("ece > 0").join(_consistency(s, d, dom), ["qt", "ct"]).filter("ece * sc <> 0").select("qt", "ct", F.round(F.col("ece") * F.col("sc"), 8).alias("score"))


# Measures, percentiles, ranking


@register("all_measures", "select * from meas")
def all_measures(s, d):
    return P.measures(s, d)


@register("best_measure", "select qt, qc, ct, cc, any_value(m) score, string_agg(measure, '+' order by case measure when 'set' then 0 when 'nl' then 1 else 2 end) measures from (select *, max(score) over (partition by qt, qc, ct, cc) m from meas) where score = m group by qt, qc, ct, cc")
def best_measure(s, d):
    return M.best_measure(P.measures(s, d))


@register("cdf_equidepth", "select * from cdf")
def cdf_equidepth(s, d):
    return C.equi_depth(P.measures(s, d), P.BINS)


@register("cdf_equidepth_per_c", "select measure::bigint c, bin, lower, upper, n, acc, pct from ccdf")
def cdf_equidepth_per_c(s, d):
    return C.equi_depth(A.c_unionability(P.aligned(s, d), score="pct"), P.BINS, ["c"])


@register("c_percentiles", "select qt, ct, c, score, minus, pct, plus from cpct")
def c_percentiles(s, d):
    return P.c_percentiles(A.c_unionability(P.aligned(s, d), score="pct"))


@register("cdf_equiwidth", "select measure, bin, n, sum(n) over (partition by measure order by bin)::bigint acc, round(sum(n) over (partition by measure order by bin) / sum(n) over (partition by measure)::double, 6) pct from (select measure, least(floor(score * 20), 19)::bigint bin, sum(n)::bigint n from (select measure, round(least(score, 1.0), 4) score, count(*) n from meas group by all) group by all)")
def cdf_equiwidth(s, d):
    return C.equi_width(P.measures(s, d), 20)


@register("percentile_lookup", "select qt, qc, ct, cc, measure, score, pct from pcts")
def percentile_lookup(s, d):
    m = P.measures(s, d)
    return C.with_percentile(m, C.equi_depth(m, P.BINS)).select(*M.PAIR, "measure", "score", "pct")


@register("perturbed", "select qt, qc, ct, cc, measure, minus, pct, plus from pcts")
def perturbed(s, d):
    m = P.measures(s, d)
    return C.with_percentile(m, C.equi_depth(m, P.BINS)).select(*M.PAIR, "measure", "minus", "pct", "plus")


@register("ensemble", "select * from ens")
def ensemble(s, d):
    return P.ensemble(s, d)


@register("greedy_alignment", "select * from jal")
def greedy_alignment(s, d):
    return A.greedy(M.jaccard(slice_domains(s, d)))


@register("k_alignment", "select qt, ct, score, row_number() over (partition by qt order by score desc, ct) rank from jal where k = 2 qualify rank <= 10")
def k_alignment(s, d):
    return A.completed(M.jaccard(slice_domains(s, d)), 2, 10)


@register("c_unionability", "select * from jcs")
def c_unionability(s, d):
    return A.c_unionability(greedy_alignment(s, d))


@register("pick_best_c", "select qt, ct, c, score from jcs qualify row_number() over (partition by qt, ct order by score desc, c desc) = 1")
def pick_best_c(s, d):
    return A.best_c(c_unionability(s, d))


@register("pick_steepest_c", "select qt, ct, c, difference from jcs qualify row_number() over (partition by qt, ct order by difference, c) = 1")
def pick_steepest_c(s, d):
    return A.steepest_c(c_unionability(s, d))


@register("topn_unionable", "select * from topn")
def topn_unionable(s, d):
    return P.top_tables(s, d)


@register("stitching", "select *, round(sum(score) over (partition by qt, ct), 6) total from jal")
def stitching(s, d):
    return A.stitched(M.jaccard(slice_domains(s, d))).withColumn("total", r6("total"))


@register("bipartite_matching")
def bipartite_matching(s, d):
    return A.matching(M.jaccard(slice_domains(s, d)))



@register("header_edit_distance")
def header_edit_distance(s, d):
    h = slice_domains(s, d).groupBy("t").agg(F.array_sort(F.collect_set("c")).alias("h"))
    return h.select(F.col("t").alias("a"), F.col("h").alias("x")).join(h.select(F.col("t").alias("b"), F.col("h").alias("y")), F.col("a") < F.col("b")).select("a", "b", X.edit_steps(F.col("x"), F.col("y")).cast("bigint").alias("edits"))


# Web tables


def freq(s, d):
    return P.slice_freq(s, d)


@register("idf", "select v, df, round(idf, 6) idf from idf")
def idf(s, d):
    return W.idf(freq(s, d)).select("v", "df", r6("idf").alias("idf"))


@register("tfidf_cosine", "select * from cosv")
def tfidf_cosine(s, d):
    return W.cosines(W.tfidf(freq(s, d))).withColumn("score", r6("score"))


@register("octopus_text_align", "select * from cosal")
def octopus_text_align(s, d):
    return A.greedy(tfidf_cosine(s, d))


@register("octopus_table_score", "select a.t qt, b.t ct, round(sum(a.w * b.w), 6) score from tu a join tu b on a.v = b.v and a.t <> b.t group by all", tu="select t, v, w / sqrt(sum(w * w) over (partition by t)) w from (select t, v, sum(freq) / any_value(n)::double * any_value(idf) w from (select *, sum(freq) over (partition by t) n from sfreq) join idf using (v) group by all)")
def octopus_table_score(s, d):
    return W.table_cosines(freq(s, d)).withColumn("score", r6("score"))


@register("octopus_size_align", "select * from szal")
def octopus_size_align(s, d):
    return A.greedy(W.length_distances(W.mean_lengths(L.slice_cells(s, d))), order=F.col("distance"), score="distance")


@register("octopus_size_score", "select qt, ct, round(-sum(distance), 6) score from szal group by qt, ct")
def octopus_size_score(s, d):
    return octopus_size_align(s, d).groupBy("qt", "ct").agg(r6(-F.sum("distance")).alias("score"))


# Expansion and benchmarks


def _halves(s, d):
    c = L.table(s, d, "customer").select("c_nationkey", "c_mktsegment", F.col("c_custkey"))
    return c.filter("c_custkey % 3 <> 0").drop("c_custkey"), c.filter("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


_MATCH = {"c_nationkey": "nation", "c_mktsegment": "segment"}


@register("row_expansion", "select count(distinct case when q then (c_nationkey, c_mktsegment) end) rows_before, count(distinct (c_nationkey, c_mktsegment)) rows_after from (select c_nationkey, c_mktsegment, c_custkey % 3 <> 0 q from customer)")
def row_expansion(s, d):
    return E.row_expansion(*_halves(s, d), _MATCH)


@register("column_expansion", "select qt, qc, ct, cc, (select count(*) from sdom x where x.t = j.qt and x.c = j.qc) n_before, (select count(*) from sdom y where y.t = j.ct and y.c = j.cc and y.v not in (select v from sdom x where x.t = j.qt and x.c = j.qc)) added from jal j")
def column_expansion(s, d):
    dom = slice_domains(s, d)
    return E.column_expansion(dom, A.greedy(M.jaccard(dom)))


@register("union_append", "select c_nationkey, c_mktsegment from customer")
def union_append(s, d):
    return E.union_append(*_halves(s, d), _MATCH)


@register("benchmark_slices", "select t, c, count(*) n_rows, count(distinct v) n_distinct from slices group by all")
def benchmark_slices(s, d):
    return L.slice_cells(s, d).groupBy("t", "c").agg(F.count("*").alias("n_rows"), F.countDistinct("v").alias("n_distinct"))


@register("stratified_sample", f"select doc_id, lang from documents qualify row_number() over (partition by lang order by {Q.hash32('doc_id::varchar')}, doc_id) <= greatest(1, floor(count(*) over (partition by lang) * 0.1))")
def stratified_sample(s, d):
    return E.stratified(L.table(s, d, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 0.1)


@register("labelled_pairs", "select a.n_nationkey a, b.n_nationkey b, a.n_regionkey from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def labelled_pairs(s, d):
    return E.same_class_pairs(L.table(s, d, "nation"), "n_nationkey", "n_regionkey")


# Evaluation


@register("precision_recall_at_n", "select n, round(avg(hits / n), 6) \"precision\", round(avg(hits / n_true), 6) recall, count(*) queries from hit join (select qt, least(count(*), 10) n_true from truth_t group by qt) using (qt) group by n", hit="select qt, rank n, sum(case when y.ct is null then 0 else 1 end) over (partition by r.qt order by rank) hits from topn r left join truth_t y using (qt, ct)")
def precision_recall_at_n(s, d):
    return V.at_n(P.top_tables(s, d), L.truth(slice_domains(s, d)), 10)


@register("map_at_n", "select qt, round(avg(hits / rank), 6) ap, count(*) n_correct from (select qt, rank, y.ct is not null ok, sum(case when y.ct is null then 0 else 1 end) over (partition by r.qt order by rank) hits from topn r left join truth_t y using (qt, ct)) where ok group by qt")
def map_at_n(s, d):
    return V.average_precision(P.top_tables(s, d), L.truth(slice_domains(s, d)))


@register("overall_pr", "select count(*) filter (f and y) correct, count(*) filter (f) found, count(*) filter (y) expected, round(count(*) filter (f and y) / nullif(count(*) filter (f), 0), 6) \"precision\", round(count(*) filter (f and y) / nullif(count(*) filter (y), 0), 6) recall from (select coalesce(f, false) f, coalesce(y, false) y from (select distinct qt, qc, ct, cc, true f from jal) full join (select distinct qt, qc, ct, cc, true y from truth) using (qt, qc, ct, cc))")
def overall_pr(s, d):
    dom = slice_domains(s, d)
    return V.overall(A.greedy(M.jaccard(dom)), L.truth(dom), list(M.PAIR))


@register("ranking_miss", "select qt, count(*) filter (o is null) miss_num from (select a.qt, b.ct o from topn a left join (select qt, ct from (select qt, ct, row_number() over (partition by qt order by score desc, ct) rank from (select qt, ct, c, score from jcs qualify row_number() over (partition by qt, ct order by score desc, c desc) = 1)) where rank <= 3) b using (qt, ct) where a.rank <= 3) group by qt")
def ranking_miss(s, d):
    return V.missing(P.top_tables(s, d), A.top_n(pick_best_c(s, d), 10), 3)


@register("correct_alignments", "select qt, ct, count(distinct qc) scores_c from jal join (select * from truth) using (qt, qc, ct, cc) group by qt, ct")
def correct_alignments(s, d):
    dom = slice_domains(s, d)
    return A.greedy(M.jaccard(dom)).join(L.truth(dom), list(M.PAIR)).groupBy("qt", "ct").agg(F.countDistinct("qc").alias("scores_c"))


@register("response_time_pct", "select event_type, round(quantile_cont(value, 0.1), 6) p10, round(quantile_cont(value, 0.9), 6) p90 from events group by event_type")
def response_time_pct(s, d):
    return L.table(s, d, "events").groupBy("event_type").agg(r6(F.percentile("value", 0.1)).alias("p10"), r6(F.percentile("value", 0.9)).alias("p90"))
