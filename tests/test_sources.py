import json
import sqlite3

import numpy as np
import pytest

from quarrylake.sources import readers as R
from quarrylake.sources import writers as W
from quarrylake.streaming import ingest as I


def test_crawl_and_lists(spark, tmp_path):
    for p in ("lake/r/d/metadata.json", "lake/r/d/x.csv", "lake/r/e/y.csv", "lake/.git/d/metadata.json", "lake/.git/d/z.csv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("a\n1\n")
    assert [tuple(r) for r in R.crawl(spark, f"{tmp_path}/lake").collect()] == [("r", "d", "x.csv")]
    (tmp_path / "list").write_text("a b c\nbad line here now\n\n")
    assert [tuple(r) for r in R.lake_list(spark, f"{tmp_path}/list").collect()] == [("a", "b", "c")]
    assert R.query_list(spark, f"{tmp_path}/list").count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,n\nheader2,x\n"Smith, J",1\nb,\n')
    got = {(r.c, r.col_idx, r.v) for r in R.csv_cells(spark, f"{tmp_path}/t.csv", 1).collect()}
    assert got == {("name", 0, "Smith, J"), ("name", 0, "b"), ("n", 1, "1"), ("n", 1, None)}


def test_web_tables(spark, tmp_path):
    rows = [{"tableId": 7, "tableHeaders": [[{"text": "wide"}], [{"text": "a"}, {"text": "b"}]], "tableData": [[{"text": "1", "tdHtmlString": '<a href="http://www.wikipedia.org/wiki/Rome">x</a>'}, {"text": "2"}]]}, {"tableId": 8, "tableHeaders": [], "tableData": []}]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, rows)))
    assert [(r.t, r.c, r.v) for r in R.web_tables(spark, f"{tmp_path}/w.json").orderBy("col_idx").collect()] == [("7", "a", "1"), ("7", "b", "2")]
    assert [r.v for r in R.web_tables(spark, f"{tmp_path}/w.json", True).orderBy("col_idx").collect()] == ["Rome", ""]


def test_xml_and_ontology(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<tableAnnotations><columnAnnotations><colAnnos col="2"><anno name="city" value="0.9"/><anno name="town" value="0.1"/></colAnnos></columnAnnotations></tableAnnotations>')
    assert sorted((r.col, r.name, r.value) for r in R.xml_annotations(spark, f"{tmp_path}/a.xml").collect()) == [(2, "city", "0.9"), (2, "town", "0.1")]
    (tmp_path / "o.tsv").write_text("<id1>\t<Rome>\t<City>\nParis\tcity\nbad\n")
    assert {tuple(r) for r in R.ontology(spark, f"{tmp_path}/o.tsv").collect()} == {("rome", "city"), ("paris", "city")}
    (tmp_path / "p").write_text("Rome|city|x\nnone\n")
    assert [tuple(r) for r in R.paired(spark, f"{tmp_path}/p", ("entity", "class")).collect()] == [("rome", "city|x")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "c", "k", 3, 5), ("a", 1, "d", None, None, None)], "t string, col_idx int, c string, class string, freq int, n_entities int")
    for _ in range(2):
        got = W.save(df, str(tmp_path), "annotations")
        assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "c", "k", 3, 5), ("a", 1, "d", "-1", 0, 0)]
    d = spark.createDataFrame([("a", "c", "v"), ("b", "c", "w")], "t string, c string, v string")
    W.save_domains(d, str(tmp_path), 4)
    assert W.load_domains(spark, str(tmp_path)).count() == 2
    j = spark.createDataFrame([("x", 1, "no"), ("x", 2, "yes")], "k string, at int, v string")
    assert W.latest(j, ["k"], "at").first().v == "yes"


def test_ingest(spark, tmp_path):
    d = spark.createDataFrame([("a", "c", "value one"), ("a", "c", "value two")], "t string, c string, v string")
    d.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    I.ingest(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", 8).awaitTermination()
    d.withColumns({"t": d.c}).write.mode("append").parquet(f"{tmp_path}/in")
    I.ingest(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", 8).awaitTermination()
    got = I.sketches(spark, f"{tmp_path}/out").collect()
    assert {(r.t, len(r.sig), r.card) for r in got} == {("a", 8, 2), ("c", 8, 2)}


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffa,b\n1,2\n3\n")
    (tmp_path / "b.csv").write_text('c,d,e\n7,8,9,10\n"x\ny",,\n')
    (tmp_path / "empty.csv").write_text("")
    got = {(r.t, r.c, r.col_idx, r.row): r.v for r in R.csv_cells(spark, str(tmp_path)).collect()}
    assert got == {("a", "a", 0, 0): "1", ("a", "b", 1, 0): "2", ("a", "a", 0, 1): "3", ("a", "b", 1, 1): None, ("b", "c", 0, 0): "7", ("b", "d", 1, 0): "8", ("b", "e", 2, 0): "9", ("b", "c", 0, 1): "x\ny", ("b", "d", 1, 1): None, ("b", "e", 2, 1): None}
    numeric = {(r.t, r.c): r.is_numeric for r in R.numeric_columns(R.csv_cells(spark, str(tmp_path))).collect()}
    assert numeric["a", "a"] and numeric["b", "c"] and numeric["b", "e"]
    with pytest.raises(Exception, match="no rows in"):
        R.csv_cells(spark, f"{tmp_path}/a.csv", skip_rows=2).collect()


def test_sqlite_and_vectors(spark, tmp_path):
    for k in range(2):
        with sqlite3.connect(tmp_path / f"{k}.db") as db:
            db.execute("create table s (t text, n int, x real)")
            db.executemany("insert into s values (?, ?, ?)", [("a", k, 0.5), (None, None, None)])
    got = R.sqlite_rows(spark, [f"{tmp_path}/{k}.db" for k in range(2)], "select t, n, x from s", "t string, n bigint, x double").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 0, 0.5), ("a", 1, 0.5), (None, None, None), (None, None, None)]))
    (tmp_path / "v").mkdir()
    (tmp_path / "v/one").write_bytes(np.array([1.5, -2.0]).astype(">f8").tobytes())
    (tmp_path / "v/none").write_bytes(b"")
    assert {r.t: list(r.v) for r in R.vectors(spark, f"{tmp_path}/v").collect()} == {"one": [1.5, -2.0]}  # an empty file has no row
    (tmp_path / "v/one").write_bytes(np.array([7, 2**64 - 1], np.uint64).astype(">u8").tobytes())
    assert {r.t: list(r.v) for r in R.vectors(spark, f"{tmp_path}/v", ">u8").collect()}["one"] == [7, -1]


def test_xml_cells(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<tableAnnotations><columnAnnotations><colAnnos col="1"><anno name="city" value="1"/></colAnnos></columnAnnotations><cellAnnotatoons><row><entity>x</entity><entity>Rome</entity></row><row><entity>y</entity><entity>Oslo</entity></row></cellAnnotatoons></tableAnnotations>')
    assert sorted((r.col, r.name, r.row, r.entity) for r in R.xml_column_entities(spark, f"{tmp_path}/a.xml").collect()) == [(1, "city", 0, "Rome"), (1, "city", 1, "Oslo")]


def test_latest_judgements_ties(spark, tmp_path):
    """Of equal line numbers the first in the files counts, whatever order tasks are read in; rows without a flag don't count."""
    from quarrylake import queries_io as Q

    kind = "l_orderkey long, l_linenumber int, l_returnflag string"
    rows = [[(k, 2, flag) for k in range(500)] for flag in "CBA"] + [[(k, 3, None) for k in range(500)] + [(-1, 1, None)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / str(i)).glob("*.parquet")).rename(tmp_path / f"lineitem.parquet/part-{i}.parquet")
    got = {r.l_orderkey: r.flag for r in Q.latest_judgements(spark, str(tmp_path)).collect()}
    assert got == {**{k: "C" for k in range(500)}, -1: None}
