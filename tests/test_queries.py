import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from vecframe.queries import REGISTRY, SQL

SF = "/root/testdata/sf0.001"
SLOW = {"kmeans_full", "kmeans_minibatch", "elbow", "pq_train"}


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = REGISTRY[name][0](spark, SF)
    found = oracle.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names))) for r in found.fetchall())
    assert sorted(str(tuple(r[n] for n in sorted(names))) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) - set(SQL) == SLOW


@pytest.mark.parametrize("name", ["knn_batch", "knn_batch_arrow", "knn_batch_all", "knn_batch_ip", "knn_batch_cosine", "ivf_batch", "ivf_trained", "sparse_batch_knn"])
def test_each_50th_row_of_the_table_is_a_query(spark, name):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    assert {r.qid for r in REGISTRY[name][0](spark, SF).collect()} == {i for i in ids if i % 50 == 0}


def test_the_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['vecframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
