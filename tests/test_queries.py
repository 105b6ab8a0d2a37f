"""Every recording query against its SQL in DuckDB, over the smallest tables; and what the driver imports."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import strideflow.queries as queries

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(queries.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_counters_need_one_shuffle(spark):
    plan = queries.accumulate_u8(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan.replace("\n", " ")


def test_entry_imports_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("strideflow", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "strideflow").mkdir()
    for p in (ROOT / "strideflow").iterdir():
        if p.name != "llm":
            (tmp_path / "strideflow" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'roundtrip_records' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
