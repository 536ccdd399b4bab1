"""The registered queries against their SQL, on the smallest driver tables."""

import collections
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from strandloom.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are missing")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem", "events", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    found = con.execute(ORACLE[name])
    names = [x[0] for x in found.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    types = {"BIGINT": "bigint", "INTEGER": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}
    assert {x[0]: types.get(str(x[1])) for x in found.description} == {c: "bigint" if t == "int" else t for c, t in df.dtypes}
    got = collections.Counter(str(tuple(r[n] for n in names)) for r in df.collect())
    assert got == collections.Counter(map(str, found.fetchall()))


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_folder():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('strandloom.llm') or name == 'corpus_pipeline':
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert 'kmer_count' in e.queries() and 'pipeline' not in e.queries() and 'kmer_count' in e.oracle_sql()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
