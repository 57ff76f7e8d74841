from __future__ import annotations

import subprocess
import sys

import pytest
from conftest import ROOT
from oracle import connect, difference

import __spark_entry__ as entry
from skytab.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_imports_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['skytab.llm'] = None; import __spark_entry__ as e; print('track_kinematics' in e.queries(), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "True []"
