"""Every core query against its SQL on the smallest tables, and the package without its training-data part."""

import glob
import os
import subprocess
import sys

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

from lexloom.plans import queries as core

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(core.queries()[name](spark, FOLDER).toPandas()) == rows(duck.execute(core.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_runs(spark, name):
    assert core.queries()[name](spark, FOLDER).columns


def test_entry_works_without_the_training_part(tmp_path):
    code = "import sys; sys.modules['lexloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('p1_') for n in e.queries()); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert "fine" in done.stdout, done.stderr[-500:]
