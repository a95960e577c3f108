import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from opslens.plans import catalog, oracle
from tests.compare import compare, open_duckdb

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    msg, _, _ = compare(spark, open_duckdb(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_the_rest_stands_alone(tmp_path):
    """Without the folders of the training-data operators all other queries still register."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert not (copy / "opslens" / "llm").exists()
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), "False", str(len(oracle.SQL))], said.stderr
