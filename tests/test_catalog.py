"""Every query with SQL against that SQL, at the smallest size; the registry without the optional subpackage."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from certamap.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders".split()
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(v) if isinstance(v, (bool, str)) else repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    got = df.select(*cols).collect()
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want)


def test_flagship_uses_generated_code(spark):
    plan = catalog.scored(spark, SF).select("gci")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" not in catalog.placed(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_registry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name in ("certamap", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", f"{root}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "certamap" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalog.QUERIES) and out[2] == "False"
