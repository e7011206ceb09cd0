"""The operators' queries against their SQL, and the library without them."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from confluo.llm import queries

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(queries.sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()
    k = sorted(want.columns)
    assert sorted(got.columns) == k
    rows = lambda df: sorted(map(repr, df[k].astype(object).where(df[k].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_works_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
