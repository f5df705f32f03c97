"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from check import TABLES, comparable

SF_DIR = "/root/testdata/sf0.001"
SQL = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registered.queries()))
def test_same_result(spark, duck, name):
    frame = registered.queries()[name](spark, SF_DIR)
    got = frame.toArrow().to_pandas(integer_object_nulls=True)
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(registered.queries())


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.columns == ["station_id", "parameter_name", "unit", "period_start", "mean", "min", "max", "n"]
    assert frame.count() > 0


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest stands by itself where those operators are not present."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(registered.__file__).parent
    for name in ("hourmark", "workload"):
        shutil.copytree(repo / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    made = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0 and made.stdout.split()[1] == "False", made.stderr
