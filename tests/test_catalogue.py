"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from grovekit.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_file_index_reaches_the_last_key(spark, tmp_path):
    keys = [0, 3999, 4000, 399_999, 400_000, 6_000_001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["file_index_range_join"](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.file, r.local) for r in got) == [(k, k // 4000, k % 4000) for k in keys]


def test_whole_attributes(spark):
    for name in ("gini_continuous", "entropy_continuous_mdl", "vfdt_replica_merge"):
        assert {r.attr for r in QUERIES[name](spark, SF).select("attr").distinct().collect()} == {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def test_loads_without_the_removable_parts(tmp_path):
    """Without grovekit/llm, tests/llm and corpus_pipeline.py, or without the first two only, the other queries are there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep in (True, False):
        to = tmp_path / str(keep)
        shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'split_top2' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(s) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={**os.environ, "PYTHONPATH": str(to)})
