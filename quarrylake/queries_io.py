"""The catalogue's readers and writers: what is written to the shared folder is read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import align as A
from .operators import annotate as O
from .operators import cdf as C
from .operators import domains as D
from .operators import expand as E
from .operators import measures as M
from .operators import webtables as W
from .plans import lake as L
from .plans import search as P
from .plans import sql as Q
from .plans.store import shared_dir, stored
from .queries import _SARMA, _complement, _consistency, domain_classes, matches, r6, register, slice_domains
from .sources import readers as R
from .sources import writers as K


def lines(df: DataFrame, what: str) -> str:
    """A folder of text with the one column of df."""
    path = shared_dir(df.sparkSession, what)
    df.write.text(path)
    return path


def csv_folder(s: SparkSession, d: str) -> str:
    """Two tables with different headers, in several files each."""
    root = shared_dir(s, "csv")
    for t, cs in (("part", ["p_partkey", "p_name", "p_brand"]), ("customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])):
        L.table(s, d, t).select(*cs).write.option("header", "true").option("escape", '"').csv(f"{root}/{t}")
    return root


@register("csv_cells", "select c, col_idx, v, count(*) n from (select unnest(['p_partkey', 'p_name', 'p_brand']) c, unnest([0, 1, 2]) col_idx, unnest([p_partkey::varchar, p_name, p_brand]) v from part union all select unnest(['c_custkey', 'c_name', 'c_mktsegment']), unnest([0, 1, 2]), unnest([c_custkey::varchar, c_name, c_mktsegment]) from customer) group by all")
def csv_cells(s, d):
    cells = R.csv_cells(s, csv_folder(s, d)).filter("c <> 'c_acctbal'")
    return cells.groupBy("c", "col_idx", "v").agg(F.count("*").alias("n"))


@register("csv_numeric_columns", "select * from (values ('p_partkey', true), ('p_name', false), ('p_brand', false), ('c_custkey', true), ('c_name', false), ('c_mktsegment', false), ('c_acctbal', true)) v(c, is_numeric)")
def csv_numeric_columns(s, d):
    return R.numeric_columns(R.csv_cells(s, csv_folder(s, d))).groupBy("c").agg(F.bool_or("is_numeric").alias("is_numeric"))


@register("csv_two_headers", "select c, count(*) n from (select unnest(['p_partkey', 'p_name', 'p_brand']) c from part) group by c")
def csv_two_headers(s, d):
    root = shared_dir(s, "csv")
    p = L.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand")
    units = s.createDataFrame([("number", "text", "text")], p.schema)
    units.unionAll(p).coalesce(1).write.option("header", "true").csv(root)
    return R.csv_cells(s, root, skip_rows=1).groupBy("c").agg(F.count("*").alias("n"))


@register("web_table_cells", "select p_partkey::varchar t, unnest([0, 1]) col_idx, unnest(['name', 'brand']) c, 0 as row, unnest([p_name, p_brand]) v from part")
def web_table_cells(s, d):
    text = lambda x: F.struct(x.alias("text"))
    rows = L.table(s, d, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("tableId"), F.array(F.array(text(F.lit("wide"))), F.array(text(F.lit("name")), text(F.lit("brand")))).alias("tableHeaders"), F.array(F.array(text(F.col("p_name")), text(F.col("p_brand")))).alias("tableData"))).alias("value"))
    return R.web_tables(s, lines(rows, "web"))


@register("web_table_entities", "select n_nationkey::varchar t, 0 col_idx, 'name' c, 0 as row, n_name v from nation")
def web_table_entities(s, d):
    cell = lambda html: F.struct(F.lit("x").alias("text"), html.alias("tdHtmlString"))
    link = F.concat(F.lit('<a href="http://www.wikipedia.org/wiki/'), F.col("n_name"), F.lit('">x</a>'))
    rows = L.table(s, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("tableId"), F.array(F.array(F.struct(F.lit("name").alias("text")))).alias("tableHeaders"), F.array(F.array(cell(link))).alias("tableData"))).alias("value"))
    return R.web_tables(s, lines(rows, "web"), entities=True)


@register("lake_lists", "select 'r' || r_regionkey repo, n_name dataset, 'x.csv' as file from nation join region on n_regionkey = r_regionkey")
def lake_lists(s, d):
    n = L.table(s, d, "nation").select(F.concat_ws(" ", F.concat(F.lit("r"), "n_regionkey"), F.col("n_name"), F.lit("x.csv")).alias("value"))
    return R.lake_list(s, lines(n.unionAll(s.createDataFrame([("not a line of three words",), ("",)], "value string")), "list"))


@register("query_lists", "select n_name t from nation")
def query_lists(s, d):
    return R.query_list(s, lines(L.table(s, d, "nation").select(F.concat(F.lit("  "), "n_name").alias("value")).unionAll(s.createDataFrame([("",)], "value string")), "list"))


@register("crawled_lake", "select 'repo' repo, n_name dataset, 'x.csv' as file from nation where n_regionkey <> 0")
def crawled_lake(s, d):
    """Folders with metadata.json, of a lake that is written first: a file for each nation."""
    root = shared_dir(s, "crawl") + "/lake"
    own = L.table(s, d, "nation").select("n_name", "n_regionkey")

    def write(batches):
        from pyarrow import fs as pafs

        for b in batches:
            for r in b.to_pylist():
                fs, base = pafs.FileSystem.from_uri(root)
                for name in ["x.csv", *(["metadata.json"] if r["n_regionkey"] else [])]:
                    fs.create_dir(f"{base}/repo/{r['n_name']}", recursive=True)
                    with fs.open_output_stream(f"{base}/repo/{r['n_name']}/{name}") as f:
                        f.write(b"a\n1\n")
            yield b

    own.mapInArrow(write, own.schema).write.format("noop").mode("overwrite").save()
    return R.crawl(s, root)


@register("ontology_file", "select entity, category from types")
def ontology_file(s, d):
    t = L.types(s, d)
    return R.ontology(s, lines(t.select(F.concat(F.lit("<id>\t<"), F.upper("entity"), F.lit(">\t<"), "category", F.lit(">")).alias("value")), "ontology"))


@register("paired_file", "select entity, category as class from types")
def paired_file(s, d):
    return R.paired(s, lines(L.types(s, d).select(F.concat_ws("|", F.upper("entity"), F.col("category")).alias("value")), "pairs"), ("entity", "class"))


@register("xml_cells", "select r.r_regionkey::int col, r.r_name as name, n.n_name entity from region r join nation n on n.n_regionkey = r.r_regionkey")
def xml_cells(s, d):
    """Ground truth of one table: a column for each region, its nations as cells."""
    n, r = L.table(s, d, "nation"), L.table(s, d, "region")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = n.withColumn("row", place).groupBy("row").pivot("n_regionkey", list(range(5))).agg(F.first("n_name"))
    names = [str(i) for i in range(5)]
    row = F.concat(F.lit("<row>"), *(F.concat(F.lit("<entity>"), F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit("</entity>")) for c in names), F.lit("</row>"))
    cells = rows.agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", row.alias("x")))).getField("x"), "").alias("cells"))
    heads = r.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<colAnnos col="'), "r_regionkey", F.lit('"><anno name="'), "r_name", F.lit('" value="1"/></colAnnos>')))), "").alias("heads"))
    doc = heads.crossJoin(cells).select(F.concat(F.lit("<tableAnnotations><columnAnnotations>"), "heads", F.lit("</columnAnnotations><cellAnnotatoons>"), "cells", F.lit("</cellAnnotatoons></tableAnnotations>")).alias("value"))
    return R.xml_column_entities(s, lines(doc, "xml")).filter("entity <> ''").select("col", "name", "entity")


@register("sampled_rows", "select 500 as n, 500 as n_distinct")
def sampled_rows(s, d):
    x = R.sampled(L.table(s, d, "orders").select("o_orderkey"), 500)
    return x.agg(F.count("*").cast("int").alias("n"), F.countDistinct("o_orderkey").cast("int").alias("n_distinct"))


@register("vector_files", "select vec_id::varchar t, list_transform(embedding, lambda x: x::double) v from embeddings")
def vector_files(s, d):
    """Files of big-endian numbers, one for each vector."""
    root = shared_dir(s, "vectors")

    def write(batches):
        import numpy as np
        from pyarrow import fs as pafs

        for b in batches:
            for r in b.to_pylist():
                fs, base = pafs.FileSystem.from_uri(root)
                fs.create_dir(base, recursive=True)
                with fs.open_output_stream(f"{base}/{r['vec_id']}") as f:
                    f.write(np.array(r["embedding"]).astype(">f8").tobytes())
            yield b

    own = L.table(s, d, "embeddings").select("vec_id", "embedding")
    own.mapInArrow(write, own.schema).write.format("noop").mode("overwrite").save()
    return R.vectors(s, root)


@register("copied_tables", "select p_brand, count(*) n, 2 as stores from part group by p_brand")
def copied_tables(s, d):
    p, root = L.table(s, d, "part"), shared_dir(s, "stores")
    for k in (0, 1):
        p.filter(F.col("p_partkey") % 2 == k).select("p_partkey", "p_brand").write.parquet(f"{root}/{k}/part.parquet")
    got = R.copied(s, [f"{root}/{k}" for k in (0, 1)], "part").withColumn("store", F.regexp_extract("store", r"/(\d)/part", 1))
    n = got.agg(F.countDistinct("store").cast("int").alias("stores"))
    return got.groupBy("p_brand").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))


@register("applied_to_tables", "select t, count(distinct c) n_columns, count(*) n_cells from slices group by t")
def applied_to_tables(s, d):
    import pandas as pd

    count = lambda g: pd.DataFrame({"t": [g.t.iat[0]], "n_columns": [g.c.nunique()], "n_cells": [len(g)]})
    return R.applied(L.slice_cells(s, d), count, "t string, n_columns bigint, n_cells bigint")


@register("stored_domains", "select * from sdom")
def stored_domains(s, d):
    root = shared_dir(s, "store")
    K.save_domains(slice_domains(s, d), root, 8)
    return K.load_domains(s, root).select("t", "c", "v")


def saved(s: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Written twice, as the second time overwrites the first, and read again."""
    root = shared_dir(s, "results")
    K.save(df.limit(1), root, name)
    return K.save(df, root, name)


@register("saved_attribute_scores", "select * from meas")
def saved_attribute_scores(s, d):
    return saved(s, P.measures(s, d), "attribute_scores")


@register("saved_attribute_percentiles", "select qt, qc, ct, cc, measure, score, pct from pcts")
def saved_attribute_percentiles(s, d):
    m = P.measures(s, d)
    return saved(s, C.with_percentile(m, C.equi_depth(m, P.BINS)), "attribute_percentiles")


@register("saved_table_alignments", "select qt, qc, ct, cc, measure, round(score, 6) score from al a join meas m using (qt, qc, ct, cc)")
def saved_table_alignments(s, d):
    """Of each aligned pair the score of every measure."""
    m = P.measures(s, d)
    al = A.greedy(C.ensemble(C.with_percentile(m, C.equi_depth(m, P.BINS))).filter("pct > 0"), order=F.struct(-F.col("minus"), -F.col("plus"), -F.col("raw")), score="pct")
    return saved(s, al.select(*M.PAIR).join(m, list(M.PAIR)), "table_alignments")


@register("saved_table_scores", "select qt, ct, c, score, difference from jcs")
def saved_table_scores(s, d):
    return saved(s, A.c_unionability(A.greedy(M.jaccard(slice_domains(s, d)))), "table_scores")


@register("saved_cdf", "select measure, bin, lower, upper, n, acc, pct, max(acc) over (partition by measure) total from cdf")
def saved_cdf(s, d):
    """The distributions of the measures, loaded again as a lookup takes them."""
    c = C.equi_depth(P.measures(s, d), P.BINS)
    return saved(s, c.withColumn("total", F.max("acc").over(Window.partitionBy("measure"))), "cdf")


@register("saved_cdf_per_c", "select measure::bigint c, bin, lower, upper, n, acc, pct, max(acc) over (partition by measure) total from ccdf")
def saved_cdf_per_c(s, d):
    c = C.equi_depth(A.c_unionability(P.aligned(s, d), score="pct"), P.BINS, ["c"])
    return saved(s, c.withColumn("total", F.max("acc").over(Window.partitionBy("c"))), "cdf_per_c")


@register("saved_annotations", "select t, (row_number() over (partition by t order by c) - 1)::bigint col_idx, c, n from (select t, c, count(*) n from (select t, c, 1 from classes union all select t, c, 1 from annotated where (t, c) not in (select t, c from classes)) group by t, c)")
def saved_annotations(s, d):
    """How many rows the table of annotations has of each domain: one for each class, or one of class -1."""
    dom = slice_domains(s, d)
    m = matches(s, d, dom)
    place = (F.row_number().over(Window.partitionBy("t").orderBy("c")) - 1).cast("bigint")
    own = O.partial_annotation(dom, m).select("t", "c", "n_entities", place.alias("col_idx"))
    rows = own.join(O.classes(dom, m, L.types(s, d)), ["t", "c"], "left")
    return saved(s, rows, "annotations").groupBy("t", "col_idx", "c").agg(F.count("*").alias("n"))


@register("saved_entity_complement", "select qt, ct, round(ece, 8) ece, round(sc, 6) sc, round(ece * sc, 8) score from ece join sc using (qt, ct) where ece > 0 and ece * sc <> 0", **_SARMA)
def saved_entity_complement(s, d):
    dom = slice_domains(s, d)
    x = _complement(s, d, dom).filter("ece > 0").join(_consistency(s, d, dom), ["qt", "ct"]).withColumn("score", F.col("ece") * F.col("sc")).filter("score <> 0")
    return saved(s, x.select("qt", "ct", F.round("ece", 8).alias("ece"), r6("sc").alias("sc"), F.round("score", 8).alias("score")), "entity_complement")


@register("saved_cluster_scores", "select qt, ct, max(score) score from cosal group by qt, ct having max(score) > 0")
def saved_cluster_scores(s, d):
    al = A.greedy(W.cosines(W.tfidf(P.slice_freq(s, d))).withColumn("score", r6("score")))
    return saved(s, al.groupBy("qt", "ct").agg(F.max("score").alias("score")), "cluster_scores")


@register("saved_cluster_alignments", "select * from cosal")
def saved_cluster_alignments(s, d):
    al = A.greedy(W.cosines(W.tfidf(P.slice_freq(s, d))).withColumn("score", r6("score")))
    broken = al.withColumn("score", F.lit(float("nan"))).unionAll(al.withColumn("score", F.lit(float("inf"))))
    return saved(s, al.unionAll(broken), "cluster_alignments")


@register("saved_stitching", "select *, round(sum(score) over (partition by qt, ct), 6) total from jal")
def saved_stitching(s, d):
    return saved(s, A.stitched(M.jaccard(slice_domains(s, d))).withColumn("total", r6("total")), "stitching")


@register("saved_search_results", "select qt, qc, ct, cc, j.score jaccard, coalesce(e.score, 0.0) ontology_jaccard, n.score cosine, j.nq query_cardinality, j.nc candidate_cardinality, row_number() over (partition by j.qt, j.ct order by j.score desc, j.qc, j.cc) k from jac j left join sem e using (qt, qc, ct, cc) left join nl n using (qt, qc, ct, cc)")
def saved_search_results(s, d):
    """The table of search results has its 26 columns; those that this search measures are compared."""
    dom = slice_domains(s, d)
    sem = M.jaccard(stored(domain_classes(s, d).select("t", "c", F.col("class").alias("v")), "classes")).select(*M.PAIR, F.col("score").alias("ontology_jaccard"))
    nl = M.mean_cosine(stored(P.mean_vectors(s, d, P.slice_freq(s, d)), "means")).select(*M.PAIR, F.col("score").alias("cosine"))
    rows = M.jaccard(dom).withColumnsRenamed({"score": "jaccard", "nq": "query_cardinality", "nc": "candidate_cardinality"}).join(sem, list(M.PAIR), "left").fillna(0.0, ["ontology_jaccard"]).join(nl, list(M.PAIR), "left")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("qt", "ct").orderBy(F.desc("jaccard"), "qc", "cc")).cast("bigint"))
    got = saved(s, rows, "search_results")
    assert len(got.columns) == 26
    return got.select("qt", "qc", "ct", "cc", "jaccard", "ontology_jaccard", "cosine", "query_cardinality", "candidate_cardinality", "k")


@register("saved_k_unionability", "select qt, ct, 'set' measure, k, score from jal where k <= 10")
def saved_k_unionability(s, d):
    return saved(s, A.k_alignment(M.jaccard(slice_domains(s, d))).withColumn("measure", F.lit("set")), "matching")


@register("saved_labelled_pairs", "select a.n_nationkey a, b.n_nationkey b, 1 as label from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey union all select a, b, 0 from (select least(a.i, b.i) a, greatest(a.i, b.i) b from perm a join perm b on a.r < b.r and a.l <> b.l order by a.r, b.r limit (select count(*) from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey))", perm=f"select n_nationkey i, n_regionkey l, row_number() over (order by {Q.hash32('n_nationkey::varchar')}, n_nationkey) r from nation")
def saved_labelled_pairs(s, d):
    n = L.table(s, d, "nation")
    yes = E.same_class_pairs(n, "n_nationkey", "n_regionkey").select("a", "b", F.lit(1).alias("label"))
    return saved(s, yes.unionAll(E.other_class_pairs(n, "n_nationkey", "n_regionkey", yes.count()).select("a", "b", F.lit(0).alias("label"))), "labelled_pairs")


@register("saved_labelled_vectors", "select vec_id id, list_transform(embedding, lambda x: x::double) vec from embeddings")
def saved_labelled_vectors(s, d):
    v = L.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return saved(s, v.unionAll(v).dropDuplicates(["id"]), "labelled_vectors")


@register("saved_top_tables", "select * from topn")
def saved_top_tables(s, d):
    return saved(s, P.top_tables(s, d), "top_tables")


@register("saved_column_expansion", "select qt, qc, ct, cc, (select count(*) from sdom x where x.t = j.qt and x.c = j.qc) n_before, (select count(*) from sdom y where y.t = j.ct and y.c = j.cc and y.v not in (select v from sdom x where x.t = j.qt and x.c = j.qc)) added from jal j")
def saved_column_expansion(s, d):
    dom = slice_domains(s, d)
    return saved(s, E.column_expansion(dom, A.greedy(M.jaccard(dom))), "column_expansion")


@register("saved_row_expansion", "select 'a' qt, 'b' ct, count(distinct case when c_custkey % 3 <> 0 then (c_nationkey, c_mktsegment) end) rows_before, count(distinct (c_nationkey, c_mktsegment)) rows_after from customer")
def saved_row_expansion(s, d):
    from .queries import _MATCH, _halves

    return saved(s, E.row_expansion(*_halves(s, d), _MATCH).select(F.lit("a").alias("qt"), F.lit("b").alias("ct"), "rows_before", "rows_after"), "row_expansion")


@register("saved_coverage", f"""select t, c, sum(freq)::bigint n_values, count(*) n_distinct, sum(case when k then freq else 0 end)::bigint known_values, count(*) filter (k) known_distinct
    from (select *, v in (select v from vtok join (select distinct unnest({Q.get_words('p_name')}) word from part) using (word)) k from sfreq) group by all""")
def saved_coverage(s, d):
    words = L.table(s, d, "part").select(F.explode(X.get_words(F.col("p_name"))).alias("word"))
    return saved(s, D.coverage(L.slice_cells(s, d), words), "coverage")


@register("saved_cardinalities", "select * from annotated")
def saved_cardinalities(s, d):
    dom = slice_domains(s, d)
    return saved(s, O.partial_annotation(dom, matches(s, d, dom)), "cardinalities")


@register("latest_judgements", "select l_orderkey, max_by(l_returnflag, l_linenumber) flag from lineitem group by l_orderkey")
def latest_judgements(s, d):
    """A line number may come twice in an order: the first in the files counts. Rows without a flag or a number don't, but their order stays."""
    at = F.when(F.col("l_returnflag").isNotNull(), F.col("l_linenumber"))
    rows = L.table(s, d, "lineitem").select("l_orderkey", at.alias("at"), "l_returnflag", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return K.latest(rows, ["l_orderkey"], "at", ["file", "row"]).select("l_orderkey", F.when(F.col("at").isNotNull(), F.col("l_returnflag")).alias("flag"))


@register("json_dump", "select entity, category from types")
def json_dump(s, d):
    path = shared_dir(s, "json")
    K.save_json(L.types(s, d), path)
    return s.read.schema("entity string, category string").json(path)


@register("ingested_sketches", "select t, c, list_sum(list_transform(sig, lambda x: x % 1000))::bigint total from sig", sig="select t, c, [" + ", ".join(f"min((a + {i} * b) % 4294967291)" for i in range(8)) + "] sig from (select t, c, " + Q.hash32("v") + " a, " + Q.hash32("v", 1) + " b from sdom) group by all")
def ingested_sketches(s, d):
    """Sketches of tables that came as a stream."""
    from .streaming import ingest as I

    root = shared_dir(s, "stream")
    cells = L.slice_cells(s, d)
    cells.write.parquet(f"{root}/in")
    I.ingest(s.readStream.schema(cells.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint", 8).awaitTermination()
    return I.sketches(s, f"{root}/out").select("t", "c", F.aggregate("sig", F.lit(0).cast("bigint"), lambda a, x: a + x % 1000).alias("total"))
