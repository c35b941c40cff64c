"""Every catalogue query against its SQL, and the driver's contract."""

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

from docprov.plans.catalogue import QUERIES, SQL
from tests.compare import connection, difference


OPERATORS = [n for n in __import__("__spark_entry__").queries() if n.startswith("op")] if importlib.util.find_spec("docprov.llm") else []


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_a_planted_difference_is_seen(spark, con):
    assert difference(spark.createDataFrame([(1, 2.0)], "a long, b double"), con, "SELECT 1 AS a, 2.0::DOUBLE AS b") == ""
    assert difference(spark.createDataFrame([(1, 2.1)], "a long, b double"), con, "SELECT 1 AS a, 2.0::DOUBLE AS b")
    assert difference(spark.createDataFrame([(1, 2.0)], "a long, c double"), con, "SELECT 1 AS a, 2.0::DOUBLE AS b")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rankings_are_limited_before_they_are_numbered(spark, sf):
    plan = QUERIES["hybrid_rrf"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    windows = [i for i, line in enumerate(plan.splitlines()) if "Window [" in line]
    assert len(windows) >= 2 and plan.count("TakeOrderedAndProject") >= 3


def without(tmp_path, *gone):
    """A copy of the repository less some of its files and folders, and an environment that finds all but the original."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    lost = {os.path.join(root, g) for g in gone}
    skipped = {".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db"}
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in skipped or os.path.join(d, n) in lost])
    paths = [p for p in [*sys.path, *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p and os.path.realpath(p) != os.path.realpath(root) and not os.path.realpath(p).startswith(os.path.realpath(root) + os.sep)]
    return tmp_path / "copy", os.environ | {"PYTHONPATH": os.pathsep.join(dict.fromkeys(paths))}


LISTED = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'hybrid_rrf' in q; print(*sorted(n for n in q if n == 'pipeline' or n[:2] == 'op' and n[2].isdigit()))"


@pytest.mark.parametrize("gone", [("docprov/llm", "tests/llm"), ("docprov/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_llm_subpackage(tmp_path, gone):
    folder, env = without(tmp_path, *gone)
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert len(done.stdout.split()) == (0 if "docprov/llm" in gone else len(OPERATORS))
    if len(gone) == 2:
        command = [sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", "not without_the_llm and not what_it_needs and (test_text_helpers or test_round_trip or hybrid_rrf or entry)"]
        tests = subprocess.run(command, cwd=folder, env=env, capture_output=True, text=True)
        assert tests.returncode == 0, tests.stdout


def test_the_rest_works_where_the_llm_subpackage_lacks_what_it_needs(tmp_path):
    folder, env = without(tmp_path)
    if not (folder / "docprov/llm").exists():
        pytest.skip("no such subpackage here")
    (folder / "docprov/llm/common.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and not done.stdout.split(), done.stderr
