"""Every registered query against its SQL on the smallest test tables, and over two layouts."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
from tests.oracle_check import canonical, compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
ADDED = re.compile(r"op\d+_|pipeline$")  # tested in tests/llm
QUERIES = {k: q for k, q in contract.queries().items() if not ADDED.match(k)}
SQL = {k: q for k, q in contract.oracle_sql().items() if not ADDED.match(k)}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_sql_belongs_to_queries():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["gender_bias", "near_dup_members", "top_dup_clusters", "top_tokens"])
def test_layout_does_not_matter(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(13).write.parquet(path)
    here = canonical(QUERIES[name](spark, SF_DIR).toPandas())
    there = canonical(QUERIES[name](spark, str(tmp_path)).toPandas())
    assert here.equals(there)
