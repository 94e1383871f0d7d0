"""The pipeline against its plain version, and the queries of this folder against their SQL."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarrylake.llm import packing, queries
from tools.compare import rows

from . import brute
from .test_operators import edited, frame, near_docs, prose

SF = Path("/root/testdata/sf0.001")


def test_pipeline_against_plain(spark, tmp_path):
    r = random.Random(20)
    items = [(i, prose(r, 25)) for i in range(5)]
    pool = [prose(r, 8) for _ in range(6)]
    docs = [(d, t) for d, t in near_docs(40)]
    docs += [(100 + i, prose(r, 30) + "\n" + edited(r, r.choice(pool), r.choice([0, 1, 2])) + "\n" + prose(r, 30)) for i in range(15)]
    docs += [(200 + i, prose(r, 10) + " " + items[i % 5][1] + " " + prose(r, 10)) for i in range(10)]
    docs += [(300, "again and again we say this " * 40), (301, None), (302, "")]
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x.n_tokens for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = brute.one_of_each(brute.without_lines(brute.unrepetitive(docs)))
    bad = {d for d, *_ in brute.contaminated(left, items)}
    want = {d: len(brute.words(t)) for d, t in left if d not in bad}
    assert got == want
    u, n = np.unique(list(want.values()), return_counts=True)
    bounds = packing.bounds(u, n, packing.BUCKETS)
    batches = {(x.bucket_len, x.doc_id): x.batch for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for b in bounds:
        own = sorted(d for d, k in want.items() if min(x for x in bounds if x >= k) == b)
        cap = max(1, packing.BUDGET // max(1, b))
        assert [batches[b, d] for d in own] == [i // cap for i in range(len(own))]


def test_stages_keep_the_columns(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_query(spark, name):
    df = entry.queries()[name](spark, str(SF))
    got = pd.DataFrame.from_records([r.asDict() for r in df.collect()], columns=df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) or name in ("op4_pii", "op7_toxicity")
        return
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(sql)
    want = pd.DataFrame.from_records(cur.fetchall(), columns=[c[0] for c in cur.description])
    assert rows(got) == rows(want)
