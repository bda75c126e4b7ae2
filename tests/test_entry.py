"""Every query with SQL agrees with it; the entry points hold without the optional folders."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    show = lambda v: "~" if v is None or v != v else repr(float(v)) if isinstance(v, float) or hasattr(v, "dtype") and "float" in str(v.dtype) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(NAMES) if not n.startswith("op") and n != "pipeline"))
def test_other_queries_give_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0 and all(not (isinstance(v, float) and math.isinf(v)) for v in df.first())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_rest_without_the_optional_folders(tmp_path):
    """The repository without the two folders: entry points hold, every other test is collected and those of the entry run."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "spark-warehouse", "metastore_db"))
    assert not (copy / "trajspark" / "llm").exists() and not (copy / "tests" / "llm").exists()
    env = os.environ | {"PYTHONPATH": str(copy)}
    core = len(entry.plans.QUERIES)
    code = f"import __spark_entry__ as e; q = e.queries(); assert len(q) == {core}, len(q); assert not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
    run = subprocess.run([sys.executable, "-m", "pytest", "tests/test_functions.py", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
