"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from heronsift.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, (int, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    told = con.execute(registry.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in told.fetchall()), key=repr)
    assert found == wanted


@pytest.mark.parametrize("pipeline", [True, False])
def test_llm_part_may_be_absent(tmp_path, pipeline):
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copytree(f"{ROOT}/heronsift", tmp_path / "heronsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
