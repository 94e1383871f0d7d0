"""Every query of the catalogue against its SQL, over the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quarrylake import queries as Q
from quarrylake import queries_io, queries_search  # noqa: F401
from tools.compare import rows

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, str(SF))
    got = pd.DataFrame.from_records([r.asDict() for r in df.collect()], columns=df.columns)
    if name not in Q.ORACLE:
        assert len(got)
        return
    cur = con.execute(Q.ORACLE[name])
    want = pd.DataFrame.from_records(cur.fetchall(), columns=[c[0] for c in cur.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["quarrylake/llm", "tests/llm"], ["quarrylake/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        p = tmp_path / "copy" / name
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[2] == "False"
